"""Substring dedup over minimizer runs of a De Bruijn graph of word k-mers.

Every run of ``window`` words is an edge of the graph. Consecutive edges of a
document that share a minimizer (the least hash of their inner ``seed``-word
runs) form one path, and a path is one row: (minimizer, path hash, document,
place). These runs stand in for compacted paths: no degrees of nodes are
computed and no path goes on over a change of minimizer. Equal edges always share their minimizer, so

1. minimizers found in one document only are set aside (two-phase aggregate),
2. paths that recur as a whole are settled by the smallest document holding
   them (aggregate and join on the path),
3. only where a minimizer has several paths, the graph branches: there the
   paths of their first documents are opened into single edges, which are
   aggregated and joined in the same way.

Paths and edges come back to their documents by source coordinates; before
words are cut, the hash of the words found there must equal the path's. That
tells rows with a clashing id apart. What is equal is decided by two
independent hashes of 64 and 32 bits (and the minimizer's): two different
windows among 10**13 have a chance under 1e-3 to be taken for each other. No
group is gathered: hot minimizers, paths and edges are pre-aggregated before
each shuffle, and the joins that bring the result back can be split anywhere.

Defined cases: a null text has no words; a row with a null id takes no part
and keeps its text; rows with one id count as one document for "smaller id",
and each is cut by its own words; extra columns are left alone; an input
without rows gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrowtext import Words, chunks, covered, joined, signed, sliding_min, strings
from lodestar.llm.shared import bounded_batches, freed, written

#: Words of an edge.
WINDOW = 13
#: Words of the runs that minimizers are taken from.
SEED = 4

_LOW = (1 << 32) - 1
_CHECK = 0x243F6A8885A308D3


def _paths(words: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, edges, minimizer) of each path of a chunk."""
    starts = np.arange(max(0, len(words) - window + 1))
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    inner = np.arange(len(words) - seed + 1)
    least = sliding_min(words.span_hashes(inner, inner + seed), window - seed + 1)
    whole = words.text_of(starts) == words.text_of(starts + window - 1)
    starts, least = starts[whole], least[whole]
    if not len(starts):
        return starts, starts, least
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), least[at]


def _marked(words: Words, first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(path, check): two independent hashes of each run of words, of 64 and 32 bits."""
    return signed(words.span_hashes(first, past)), (words.span_hashes(first, past, _CHECK) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def path_rows(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(minimizer, path, check, doc_id, span) for each path; span = first word * 2**32 + edges; check: 32 more bits of a hash independent of ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                first, edges, least = _paths(words, window, seed)
                text = words.text_of(first)
                path, check = _marked(words, first, first + edges + window - 1)
                ids = np.asarray(part.column("doc_id"))[text]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(least), path, check, ids, (first - words.first[text]) << 32 | edges)], ["minimizer", "path", "check", "doc_id", "span"])

    return docs.select("doc_id", "text").mapInArrow(run, "minimizer bigint, path bigint, check int, doc_id bigint, span bigint")


def minimizer_bounds(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(minimizer, low, high): least and greatest document of each minimizer of a chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                first, _, least = _paths(words, window, seed)
                ids = np.asarray(part.column("doc_id"))[words.text_of(first)]
                order = np.lexsort((ids, least))
                least, ids = least[order], ids[order]
                new = np.ones(len(least), bool)
                new[1:] = least[1:] != least[:-1]
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(least)) - 1 if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(least[at]), ids[at], ids[last])], ["minimizer", "low", "high"])

    return docs.select("doc_id", "text").mapInArrow(run, "minimizer bigint, low bigint, high bigint")


def _marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, span, path) of a column of lists of (span, path); null lists have none."""
    counts = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    values = pc.list_flatten(column)
    return np.repeat(np.arange(len(column)), counts), np.asarray(values.field("span")), np.asarray(values.field("path"))


def _verified(words: Words, column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, past word, row) of the marks whose words, at their coordinates, have the marked hash."""
    row, span, path = _marks(column)
    first = words.first[row] + (span >> 32)
    past = first + (span & _LOW) + window - 1
    inside = past <= words.first[row + 1]
    first, past, row, path = first[inside], past[inside], row[inside], path[inside]
    same = signed(words.span_hashes(first, past)) == path
    return first[same], past[same], row[same]


def _edge_rows(todo: DataFrame, window: int) -> DataFrame:
    """(path, check, doc_id, span) for each single edge of the marked paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                first, past, row = _verified(words, part.column("marks"), window)
                counts = past - first - window + 1
                begun = np.repeat(np.cumsum(counts) - counts, counts)
                starts = np.repeat(first, counts) + np.arange(counts.sum()) - begun
                row = np.repeat(row, counts)
                ids = np.asarray(part.column("doc_id"))[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*_marked(words, starts, starts + window), ids, (starts - words.first[row]) << 32 | 1)], ["path", "check", "doc_id", "span"])

    return todo.mapInArrow(run, "path bigint, check int, doc_id bigint, span bigint")


def _by_document(marks: DataFrame) -> DataFrame:
    """A document's distinct marks, as many as it has windows at most, however many rows share its id."""
    return marks.groupBy("doc_id").agg(F.collect_set(F.struct("span", "path")).alias("marks"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, marks): places whose word windows also start in a document with a smaller id."""
    bounded_batches(docs.sparkSession)
    # each table of groups is written before it is joined: then both sides are plain exchanges, which Spark can split on a hot key
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    bounds = minimizer_bounds(texts, window, seed).groupBy("minimizer").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = written(bounds.where("low < high").select("minimizer"), "minimizers")
    found = written(path_rows(texts, window, seed).join(shared, "minimizer"), "paths")

    freed(shared)

    names = ["minimizer", "path", "check"]
    paths = written(found.groupBy(*names).agg(F.min("doc_id").alias("low")), "firsts")
    marked = found.join(paths, names)
    settled = marked.where("doc_id > low").select("doc_id", "span", "path")

    branching = written(paths.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").select("minimizer"), "branching")
    opened = marked.where("doc_id = low").join(branching, "minimizer", "left_semi").select("doc_id", "span", "path")
    edges = written(_edge_rows(texts.join(_by_document(opened), "doc_id"), window), "edges")
    firsts = written(edges.groupBy("path", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("path", "check", "low"), "edge-firsts")
    single = edges.join(firsts, ["path", "check"]).where("doc_id > low").select("doc_id", "span", "path")
    marks = written(_by_document(settled.unionByName(single)), "marks")
    freed(found, paths, branching, edges, firsts)
    return marks


def _kept_texts(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id``, counts, the kept words joined by spaces, the text with the removed words cut out, the removed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                first, past, _ = _verified(words, part.column("marks"), window)
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, first, 1)
                np.add.at(steps, past, -1)
                gone = np.cumsum(steps[:-1]) > 0
                text, joined_words, removed = _assembled(words, gone)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.counts), pa.array(removed), joined_words, text, _span_lists(words, gone)], ["doc_id", "n_words", "n_removed", "kept", "cut", "spans"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string, cut string, spans array<struct<first: bigint, past: bigint>>")


def _assembled(words: Words, gone: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(texts without the gone words and the white space after them, kept words joined by spaces, gone words of each text)."""
    size, offsets = len(words.data), words.offsets
    kept = np.flatnonzero(~gone)
    sums = np.zeros(len(words) + 1, np.int64)
    np.cumsum(gone, out=sums[1:])
    removed = sums[words.first[1:]] - sums[words.first[:-1]]

    follows = words.starts.copy()
    if len(words):
        past_text = offsets[words.text_of(np.arange(len(words))) + 1]
        follows[:-1] = np.minimum(words.starts[1:], past_text[:-1])
        follows[-1:] = past_text[-1:]
    lost = np.flatnonzero(gone)
    cut = strings(words.data, ~covered(size, words.starts[lost], follows[lost]), offsets)
    return cut, joined(words, kept), removed


def _span_lists(words: Words, gone: np.ndarray) -> pa.Array:
    """Maximal runs of gone words, as (first, past) within each text."""
    at = np.flatnonzero(gone)
    text = words.text_of(at) if len(at) else at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(at)) - 1 if len(begin) else begin
    base = words.first[text[begin]] if len(begin) else begin
    values = pa.StructArray.from_arrays([pa.array(at[begin] - base), pa.array(at[last] + 1 - base)], ["first", "past"])
    offsets = np.searchsorted(text[begin], np.arange(len(words.counts) + 1)) if len(begin) else np.zeros(len(words.counts) + 1, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (remaining words, by single spaces), cut (the text without the removed words), spans."""
    texts = docs.select("doc_id", "text")
    marks = repeated_spans(docs, window, seed)
    return _kept_texts(texts.join(marks, "doc_id", "left"), window)


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; rows that lose all their words go, others keep their columns."""
    marks = repeated_spans(docs, window, seed)
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("row")).join(marks, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"))
                first, past, _ = _verified(words, part.column("marks"), window)
                steps = np.zeros(len(words) + 1, np.int64)
                np.add.at(steps, first, 1)
                np.add.at(steps, past, -1)
                cut, _, removed = _assembled(words, np.cumsum(steps[:-1]) > 0)
                cut = pc.if_else(pa.array(removed > 0), cut, part.column("text"))
                whole = pa.array((removed == 0) | (removed < words.counts))
                yield pa.RecordBatch.from_arrays([cut, part.column("row")], ["text", "row"]).filter(whole)

    row = docs.select(F.struct(*others).alias("row")).schema["row"].dataType.simpleString()
    done = packed.mapInArrow(run, f"text string, row {row}")
    return done.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns])
