"""Near-duplicate pairs by Hamming distance and their components."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import hamming
from lodestar.sources.work import freed, written


#: Bands for wide searches: more of them make parts too short to tell codes apart.
BANDS = 4


def _masks(size: int, most: int) -> list[int]:
    """All numbers of ``size`` bits with at most ``most`` set."""
    return [sum(1 << i for i in places) for n in range(most + 1) for places in combinations(range(size), n)]


def _flipped(band: int, part: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(F.lit(band).alias("band"), part.bitwiseXOR(mask.cast("long")).alias("part"))


def _band_sizes(most: int, bits: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, distance) of each band: two codes within ``most`` bits are within some band's distance there.

    Were all bands further apart, the codes would differ in sum(distance + 1) = ``most`` + 1 bits.
    """
    count = most + 1 if most + 1 <= 2 * BANDS else BANDS
    spare, more_spare = divmod(most + 1 - count, count)
    width, more = divmod(bits, count)
    out, at = [], 0
    for i in range(count):
        size = width + (i < more)
        out.append((at, size, spare + (i < more_spare)))
        at += size
    return out


def hamming_candidates(df: DataFrame, key: str, code: str, most: int, bits: int = 64) -> DataFrame:
    """(a, ca, b, cb) with a < b of codes that are near in some band, once for each way they meet.

    A band's distance is split: one side sends its part with up to half of it
    in flipped bits, the other with up to the rest, and an equi-join brings together what meets half way.
    """
    rows = df.select(F.col(key).alias("k"), F.col(code).alias("c"))
    sides = []
    for half in (0, 1):
        sent = []
        for i, (at, size, distance) in enumerate(_band_sizes(most, bits)):
            masks = _masks(size, (distance + half) // 2)
            part = F.shiftrightunsigned("c", at).bitwiseAND(F.lit((1 << size) - 1))
            sent.append(F.transform(F.lit(masks), _flipped(i, part)))
        sides.append(rows.select("k", "c", F.explode(F.flatten(F.array(*sent))).alias("p")).select("k", "c", "p.band", "p.part"))
    left, right = (side.select(F.col("k").alias(n), F.col("c").alias(f"c{n}"), "band", "part") for side, n in zip(sides, "ab", strict=True))
    return left.join(right, ["band", "part"]).where("a < b").select("a", "ca", "b", "cb")


def hamming_pairs(df: DataFrame, key: str, code: str, most: int, bits: int = 64) -> DataFrame:
    """(a, b, distance) with a < b and distance <= most; exact at every distance.

    Up to ``most`` = 7 there are ``most`` + 1 bands, one of which must be equal;
    beyond, ``BANDS`` wide ones, of which one must be near. Candidates too far apart go inside the join.
    """
    close = hamming(F.col("ca"), F.col("cb"))
    found = hamming_candidates(df, key, code, most, bits).where(close <= most)
    return found.select("a", "b", close.alias("distance")).distinct()


def linked(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``links`` (a, b: bigint) that has a link to another, a row each.

    A round points all greater neighbours of a node to its least neighbour,
    then all smaller ones; the links shrink to stars in O(log² n) rounds, each
    written to the shared folder and freed after the next. The minima are
    pre-aggregated and the joins can be split on a hot node.
    """
    stars = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b")))
        older, stars = stars, written(small.distinct(), "stars")
        freed(older)
        told = stars.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == before:
            break
        before = told
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over the edges (a, b), for every row of ``nodes`` (node)."""
    found = linked(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    named = nodes.join(found.withColumnsRenamed({"node": "_node", "component": "_component"}), F.col("node") == F.col("_node"), "left")
    return named.select("node", F.coalesce("_component", "node").alias("component"))
