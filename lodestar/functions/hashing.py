"""Hash-derived columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_fraction(value: Column, seed: int | str) -> Column:
    """A fraction in [0, 1) that depends on seed and value only: the first 8 bytes of SHA-256 of ``seed:value``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def short_id(prefix: str, value: Column, length: int = 16) -> Column:
    """``prefix_`` and the first hex digits of the SHA-1 of the lower-case value."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.lower(value)), 1, length))


def difference_hash(vector: Column, bits: int = 63) -> Column:
    """Bit i is set if element i is greater than element i + 1 (from 0), as a signed long."""
    signs = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.get(vector, i) > F.get(vector, i + 1), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(value: Column, count: int, bits: int) -> Column:
    """The value cut into ``count`` runs of bits, each with its number: values within count - 1 bits share one."""
    width, more = divmod(bits, count)
    out, at = [], 0
    for i in range(count):
        size = width + (i < more)
        out.append(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << size) - 1)).alias("part")))
        at += size
    return F.array(*out)


def list_digest(values: Column) -> Column:
    """An order-sensitive digest of a list of strings, a line each."""
    return F.sha2(F.concat(F.array_join(values, "\n"), F.lit("\n")), 256)


def fold(parts: list[Column]) -> Column:
    """The parts joined by ``|``; null counts as empty."""
    return reduce(lambda x, y: F.concat(x, F.lit("|"), y), [F.coalesce(p.cast("string"), F.lit("")) for p in parts])
