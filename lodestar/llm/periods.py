"""Periodic runs of words by bit-parallel lags.

The words of a text are numbered, and each bit of the numbers is a plane: one
big integer with a bit a word. For a lag q, a plane XOR itself shifted by q
marks the places where the bit differs from that q words on, and the OR of all
planes marks the mismatches. Stretches of at least max(24, 3 q) - q places
without a mismatch are isolated by ANDs with shifts that double; such a
stretch and the q words after it are a run of period q. Lags go upwards, and a
run that a smaller lag has found is left out: its smallest period is that one.

Short texts share the integers, of ``TOGETHER`` words: a mask that loses one
place a lag at each text's end keeps them apart. Most lags end after
``FIRST_PLANES`` planes, when no stretch is long enough any more. In texts of
more words only lags that can hold a run are tried: for q from Q to 2 Q - 1, the
distances between neighbouring occurrences of the same 2 Q - 1 words (named
by doubling, no hashes). At the first word of a run of smallest period q these
recur after q words and, two periods of one stretch having a common divisor,
no sooner. So time is close to linear in long texts too.

The job is a map over the documents; nothing is shuffled.

Defined cases: a null text has no words; a text without a run has an empty
list and keeps its words; rows stay as they are, repeated ids included; an
input without rows gives no rows; other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrowtext import Words, chunks, exact_ids, joined
from lodestar.llm.shared import bounded_batches

#: Words of the shortest run, and periods that a run holds at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Words of the texts that share integers.
TOGETHER = 1 << 15
FIRST_PLANES = 4

_BLANKS = r"[\x20\x09-\x0D]+"
_BLANK_CHARACTERS = " \t\n\x0b\f\r"


def _integer(bits: np.ndarray) -> int:
    """Bit i of the integer is ``bits[i]``."""
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _stretches(equal: int, length: int) -> int:
    """A bit where ``length`` set bits of ``equal`` begin."""
    have = 1
    while have < length and equal:
        step = min(have, length - have)
        equal &= equal >> step
        have += step
    return equal


def _bounds(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each stretch of set bits."""
    data = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
    held = np.flatnonzero(data)
    places = np.flatnonzero(np.unpackbits(data[held], bitorder="little"))
    places = held[places >> 3] * 8 + (places & 7)
    new = np.flatnonzero(np.diff(places) > 1) + 1
    return places[np.append(0, new)], places[np.append(new, len(places)) - 1]


def likely_lags(ids: np.ndarray) -> Iterator[int]:
    """Lags, ascending, that hold every run of the text; few others."""
    names, size = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while LEAST_PERIODS * size <= len(ids):
        two = names[: len(names) - size + 1] * (len(ids) + 1) + names[size - 1 :]  # 2 * size - 1 words
        order = np.argsort(two, kind="stable")
        distance = np.diff(order)[np.diff(two[order]) == 0]
        yield from np.unique(distance[(distance >= size) & (distance < 2 * size)]).tolist()
        if len(names) <= size:
            break
        names = np.unique(names[:-size] * (len(ids) + 1) + names[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2


def _runs(texts: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs of the texts, each an array of word numbers."""
    sizes = np.array([len(x) for x in texts])
    begin = np.append(0, np.cumsum(sizes + 1))
    ids, inside = np.zeros(begin[-1], np.int64), np.ones(begin[-1], np.uint8)
    for at, text in zip(begin, texts, strict=False):
        ids[at : at + len(text)] = text
    inside[begin[1:] - 1] = 0
    planes = [_integer(ids >> b & 1) for b in range(int(ids.max(initial=0)).bit_length())]
    most = int(sizes.max()) // LEAST_PERIODS
    one = len(texts) == 1 and most * LEAST_PERIODS > TOGETHER
    first, rest = planes[:FIRST_PLANES], planes[FIRST_PLANES:]
    valid, seen, out = _integer(inside), set(), []
    for q in likely_lags(texts[0]) if one else range(1, most + 1):
        # the places whose word q on is of the same text
        valid = (1 << int(sizes[0]) - q) - 1 if one else valid & valid >> 1
        length = max(LEAST_WORDS, LEAST_PERIODS * q) - q
        differs = 0
        for plane in first:
            differs |= plane ^ plane >> q
        if not _stretches(valid ^ valid & differs, length):
            continue
        for plane in rest:
            differs |= plane ^ plane >> q
        equal = valid ^ valid & differs
        long = _stretches(equal, length)
        if not long:
            continue
        for start, last in zip(*(x.tolist() for x in _bounds(long)), strict=True):
            end = last + length + q
            if (start, end) not in seen:
                seen.add((start, end))
                text = int(np.searchsorted(begin, start, "right")) - 1
                out.append((text, start - int(begin[text]), end - start, q))
    return out


def text_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text (an array of word numbers), by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, x in enumerate(texts) if len(x) >= LEAST_WORDS), key=lambda i: len(texts[i]))
    group, held = [], 0
    for k, i in enumerate(order):
        group.append(i)
        held += len(texts[i])
        if k + 1 == len(order) or held + len(texts[order[k + 1]]) > TOGETHER:
            for text, *run in _runs([texts[j] for j in group]):
                found[group[text]].append(tuple(run))
            group, held = [], 0
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs: array of (start, length, period) by start and period, collapsed) for each row.

    ``collapsed``: the words, by single spaces, without those that some run holds after its first period.
    """
    bounded_batches(docs.sparkSession)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch.rename_columns([key, "text"])):
                words = Words(part.column(1))
                ids = exact_ids(words)
                found = text_runs([ids[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
                gone = np.zeros(len(words), bool)
                for first, told in zip(words.first.tolist(), found, strict=False):
                    for start, length, period in told:
                        gone[first + start + period : first + start + length] = True
                counts = np.append(0, np.cumsum([len(x) for x in found]))
                columns = np.array([r for told in found for r in told], np.int64).reshape(-1, 3)
                values = pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values), joined(words, np.flatnonzero(~gone))], [key, "n_words", "runs", "collapsed"])

    return docs.select(key, text).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; the first of equals; null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): ``docs`` with known runs put into a tenth of them, chosen by their ids, for checks of the search.

    With h = crc32 of the decimal doc_id and g = h div 10: where h is divisible by 10 and the text has n > 0 words,
    those from number a = g mod n on are repeated with period 1 + (n - a) div (3 + g mod 8). Null ids are not chosen.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    trimmed = F.trim(F.coalesce("text", F.lit("")), F.lit(_BLANK_CHARACTERS))
    chosen = F.coalesce((h % 10 == 0) & (trimmed != ""), F.lit(False))
    told = docs.select("doc_id", "text", F.when(chosen, F.split(trimmed, _BLANKS)).alias("words"), F.floor(h / 10).cast("long").alias("g"))
    n = F.size("words").cast("long")
    placed = told.withColumn("a", F.when(F.col("words").isNotNull(), F.col("g") % n))
    placed = placed.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    period = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (n - F.col("a")).cast("int"))
    put = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return placed.select("doc_id", F.when(F.col("words").isNotNull(), put).otherwise(F.col("text")).alias("text"))
