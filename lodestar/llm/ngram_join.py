"""Exact Jaccard join of documents on word n-grams: rare-first prefix filtering.

1. A pass over the texts counts, for each document, its distinct shingles, a
   128-bit fingerprint and the parities of the set in 256 parts of the hash
   space, and for the corpus the shingles by hash bucket (2**17 buckets, a
   bounded table). Documents with equal sets form a class; the first stands for it.
2. Each document orders its shingles by (count of the bucket, hash), rare
   first, and sends its prefix: sets of Jaccard t share a shingle of the first
   n - ceil(t n) + 1. Prefix shingles of one document only are dropped; for
   that, shingles of hot buckets are salted.
3. Candidates are first each document with one hub of each prefix shingle
   (linear in the prefixes), then, over groups that the links found so far
   leave in several components, with other hubs, and at last all remaining
   pairs of different components: nothing is lost, yet a group of many near
   copies costs a link each. Length, positional and suffix filters prune them;
   the suffix filter bounds the difference of two whole sets from below by the
   parts in which their parities differ. All grouping is by aggregates, all
   joins are plain equi-joins, which Spark splits where one shingle is hot.
4. Each pair left is verified once on the full sets. Links become components;
   copies with equal sets follow their first document.

A pair's shingles are compared by their words. Hashes only find candidates and
tell shingles of one document apart (a false match among 10,000 of them has a
chance of 3e-12), and texts with equal counts and 128-bit fingerprints of their
shingles' hashes count as equal sets.

Defined cases: texts with fewer words than a shingle count as one shingle of
all words; null or wordless texts have an empty set and link with nothing; a
null id links with nothing and has a null component; rows that share an id
share its component, each text is compared by itself; an empty input gives no
rows; other columns are not read. A text is worked on whole, so a task needs
some 100 times the bytes of its longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.arrowtext import CHUNK_BYTES, Words, chunks, exact_grams, exact_ids, mix, signed
from lodestar.llm.components import components
from lodestar.llm.shared import bounded_batches, freed, written

WORDS = 5
#: Percent of the union that the intersection must reach.
PERCENT = 80
BUCKET_BITS = 17
#: Rows of a shingle that go to one task at most, about, when those of one document are dropped.
HOT = 1000
#: Rounds in which groups try one hub before all remaining pairs are compared.
ROUNDS = 2
#: Rows of a table of ids (16 bytes each) that may be broadcast; a longer one is joined by a shuffle.
IDS_BROADCAST = 500_000
#: Words of 64 parity bits that a document's set is summed up in.
PARITIES = ["p0", "p1", "p2", "p3"]


def sets_of(column: pa.Array, size: int = WORDS) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, text, shingle): each text's distinct shingles, ordered by (text, hash)."""
    words = Words(column, lower=True)
    starts, hashes = words.grams(size)
    text = words.text_of(starts) if len(starts) else starts
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    text = np.concatenate([text, short])
    hashes = np.concatenate([hashes, words.span_hashes(words.first[short], words.first[short + 1])])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return words, text[new], hashes[new]


def exact_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) as ``sets_of``, but with numbers that tell the chunk's shingles apart by their words, not by hashes."""
    words = Words(column, lower=True)
    starts, names = exact_grams(words, size)
    ids, whole = exact_ids(words), {}
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    told = [whole.setdefault(tuple(ids[words.first[i] : words.first[i + 1]].tolist()), -1 - len(whole)) for i in short.tolist()]
    text = np.concatenate([words.text_of(starts) if len(starts) else starts, short])
    names = np.concatenate([names, np.array(told, np.int64)])
    order = np.lexsort((names, text))
    text, names = text[order], names[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (names[1:] != names[:-1])
    return text[new], names[new]


def _parities(text: np.ndarray, hashes: np.ndarray, rows: int) -> list[np.ndarray]:
    """For each text, in which of 256 parts of the hash space its set has an odd number of shingles, as four words."""
    bits = len(PARITIES) * 64
    odd = (np.bincount(text * bits + (hashes & np.uint64(bits - 1)).astype(np.int64), minlength=rows * bits) & 1).astype(np.uint8)
    packed = np.packbits(odd.reshape(rows, bits), axis=1).view(np.int64).reshape(rows, len(PARITIES))
    return [np.ascontiguousarray(packed[:, i]) for i in range(len(PARITIES))]


def _statistics(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (n, one, two, parities), and rows (bucket, count) for each task."""
    names = ["doc_id", "n", "one", "two", *PARITIES, "bucket", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for part in chunks(batch):
                _, text, hashes = sets_of(part.column("text"), size)
                rows = part.num_rows
                np.add.at(totals, (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
                n = np.bincount(text, minlength=rows).astype(np.int64)
                ends = np.cumsum(n)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(key)))]) for key in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                one, two = (signed(x[ends] - x[ends - n]) for x in sums)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (n, one, two, *_parities(text, hashes, rows))), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())], names)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64())] * (len(names) - 2) + [pa.array(at), pa.array(totals[at])], names)

    return docs.mapInArrow(run, ", ".join(f"{x} bigint" for x in names))


def bucket_counts(statistics: DataFrame) -> np.ndarray:
    """Corpus counts by bucket: 2**17 numbers, whatever the corpus."""
    rows = statistics.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count")).collect()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in rows:
        out[r["bucket"]] = r["count"]
    return out


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """(shingle, salt, doc_id, meta): meta = set size * 2**32 + rank; salt 0, or from 1 on for hot buckets."""
    held = docs.sparkSession.sparkContext.broadcast(counts)
    usual = int(4 * counts.sum() / len(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = held.value
        for batch in batches:
            for part in chunks(batch):
                _, text, hashes = sets_of(part.column("text"), size)
                n = np.bincount(text, minlength=part.num_rows).astype(np.int64)
                count = by_bucket[(hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                order = np.lexsort((hashes, count, text))
                rank = np.arange(len(text)) - (np.cumsum(n) - n)[text]
                keep = rank < prefix_length(n, percent)[text]
                order, rank = order[keep], rank[keep]
                text, hashes, count = text[order], hashes[order], count[order]
                ids = np.asarray(part.column("doc_id"))[text]
                parts = np.where(count > max(HOT, usual), count // HOT, 0)
                salt = np.where(parts > 0, 1 + mix(ids.astype(np.uint64)).astype(np.int64) % np.maximum(parts, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(hashes), np.abs(salt), ids, n[text] << 32 | rank)], ["shingle", "salt", "doc_id", "meta"])

    return docs.mapInArrow(run, "shingle bigint, salt bigint, doc_id bigint, meta bigint")


def _near_enough(a: str, b: str, percent: int) -> list[Column]:
    """Tests of two rows of a shingle, by the prefixes of their columns: the length and the positional filter.

    ``meta`` is set size * 2**32 + rank. None of the shingles before the first
    common one are shared, so the overlap is at most what is left from there on.
    A later common shingle bounds the overlap too low: a pair passes if any of
    its common shingles passes.
    """
    n_a, n_b = F.shiftright(f"{a}meta", 32), F.shiftright(f"{b}meta", 32)
    left = lambda meta, n: n - F.col(meta).bitwiseAND(F.lit((1 << 32) - 1))
    # intersection >= percent / (100 + percent) * (n_a + n_b)
    return [F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent, F.least(left(f"{a}meta", n_a), left(f"{b}meta", n_b)) * (100 + percent) >= (n_a + n_b) * percent]


def _suffix_bound(a: str, b: str, sizes: Column, percent: int) -> Column:
    """The suffix filter: parities that differ are a lower bound of the shingles that only one set has."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(a + p).bitwiseXOR(F.col(b + p))) for p in PARITIES])
    return differ * (100 + percent) <= sizes * (100 - percent)


def _pruned(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the suffix filter leaves."""
    of = lambda name: sets.select(F.col("doc_id").alias(name), F.col("n").alias(f"{name}_n"), *[F.col(p).alias(f"{name}_{p}") for p in PARITIES])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.where(_suffix_bound("a_", "b_", F.col("a_n") + F.col("b_n"), percent)).select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar enough; ids of ``docs`` are unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "a_text", CHUNK_BYTES // 2):
                rows, names = exact_sets(pa.concat_arrays([part.column(x).cast(pa.large_string()) for x in ("a_text", "b_text")]), size)
                rows %= part.num_rows
                order = np.lexsort((names, rows))
                rows, names = rows[order], names[order]
                twice = (rows[1:] == rows[:-1]) & (names[1:] == names[:-1])
                both = np.bincount(rows[1:][twice], minlength=part.num_rows)
                union = np.bincount(rows, minlength=part.num_rows) - both
                yield part.select(["a", "b"]).filter(pa.array((both > 0) & (100 * both >= percent * union)))

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    held = F.broadcast(ids) if ids.count() <= IDS_BROADCAST else ids
    texts = docs.select("doc_id", "text").join(held, "doc_id", "left_semi")
    of = lambda name: texts.select(F.col("doc_id").alias(name), F.col("text").alias(f"{name}_text"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint")


def _hub_pairs(groups: DataFrame, by: Callable[[str], Column], percent: int) -> DataFrame:
    """(a, b): each row of a group of (shingle, comp) with the hub of the shingle, the row that is first by ``by``."""
    hubs = groups.groupBy("shingle").agg(F.min_by(F.struct("doc_id", "meta", "comp"), by("doc_id")).alias("hub"))
    both = groups.join(hubs, "shingle").select(F.col("doc_id").alias("a"), F.col("meta").alias("a_meta"), "comp", F.col("hub.doc_id").alias("b"), F.col("hub.meta").alias("b_meta"), F.col("hub.comp").alias("hub_comp"))
    return both.where(reduce(Column.__and__, _near_enough("a_", "b_", percent), F.col("comp") != F.col("hub_comp"))).select("a", "b")


def _remaining_pairs(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of a shingle's rows in different components; the filters are part of the join, so that a pair gives rows only if it passes them."""
    rows = groups.join(sets.select("doc_id", *PARITIES), "doc_id")
    left, right = (rows.select("shingle", F.col("doc_id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("meta", "comp", *PARITIES)]) for s in "ab")
    sizes = F.shiftright("a_meta", 32) + F.shiftright("b_meta", 32)
    tests = [left.shingle == right.shingle, F.col("a") > F.col("b"), F.col("a_comp") != F.col("b_comp"), *_near_enough("a_", "b_", percent), _suffix_bound("a_", "b_", sizes, percent)]
    return left.join(right, reduce(Column.__and__, tests)).select("a", "b")


def links(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, same: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sets, components) of documents (doc_id, text) with unique ids.

    sets: doc_id, n, rep for each document (rep: the least id with an equal
    set); components: node, component for the reps that have a link. ``same``
    holds further links (a, b).
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    statistics = written(_statistics(texts, size), "sets")
    sets = statistics.where("doc_id IS NOT NULL")
    classes = sets.where("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"))
    # equal sets follow their class; the join can be split, as a class may hold a third of all rows
    known = written(sets.join(classes, ["n", "one", "two"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), *PARITIES), "classes")
    # one row for each shingle and set: copies with equal sets have equal prefixes
    firsts = known.where("doc_id = rep")

    rows = _prefixes(texts, bucket_counts(statistics), size, percent)
    freed(statistics)
    over = Window.partitionBy("shingle", "salt")
    shared = rows.withColumns({"low": F.min("doc_id").over(over), "high": F.max("doc_id").over(over)}).where("low < high OR salt > 0").select("shingle", "doc_id", "meta")
    groups = written(shared.join(firsts.select("doc_id"), "doc_id", "left_semi"), "groups")

    found, tried, comps = [], [], None
    if same is not None:
        of = lambda name: known.select(F.col("doc_id").alias(name), F.col("rep").alias(f"{name}_rep"))
        found.append(written(same.join(of("a"), "a").join(of("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct(), "same"))
        comps = components(found[0])
    for turn in range(ROUNDS + 1):
        passing = []
        if comps is None:
            current = groups.withColumn("comp", F.col("doc_id"))
        else:
            named = written(groups.join(comps, groups.doc_id == comps.node, "left").select("shingle", "doc_id", "meta", F.coalesce("component", "doc_id").alias("comp")), "named")
            mixed = written(named.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("shingle"), "mixed")
            current, passing = named.join(mixed, "shingle"), [named, mixed]
        if turn < ROUNDS:
            pairs = _pruned(_hub_pairs(current, (lambda c: F.col(c)) if turn == 0 else (lambda c, t=turn: F.xxhash64(c, F.lit(t))), percent).distinct(), firsts, percent)
        else:
            pairs = _remaining_pairs(current, firsts, percent)
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        tried.append(written(pairs, "pairs"))
        freed(*passing)
        if comps is not None and tried[-1].isEmpty():
            continue
        found.append(written(verified(texts, tried[-1], size, percent), "verified"))
        if comps is None or not found[-1].isEmpty():
            freed(*([] if comps is None else [comps]))
            comps = components(reduce(DataFrame.unionByName, found))
    freed(groups, *tried, *found)
    return known.drop(*PARITIES), comps


def _found(rows: DataFrame, unique: bool, size: int, percent: int) -> DataFrame:
    """(key, doc_id, n, first, component) for each row (key, doc_id, text) with an id: component is the least doc_id, ``first`` marks one row of each id and set."""
    rows = rows.where("doc_id IS NOT NULL").select("key", "doc_id", "text")
    least = rows.groupBy("doc_id").agg(F.min("key").alias("b"))
    same = None if unique else rows.select(F.col("key").alias("a"), "doc_id").join(least, "doc_id").where("a <> b").select("a", "b")
    known, comps = links(rows.select(F.col("key").alias("doc_id"), "text"), size, percent, same)
    done = known.join(comps, known.rep == comps.node, "left").select(F.col("doc_id").alias("key"), "n", "rep", F.coalesce("component", "rep").alias("component"))
    if unique:
        return done.select("key", F.col("key").alias("doc_id"), "n", F.lit(True).alias("first"), "component")
    done = written(done.join(rows.select("key", "doc_id"), "key").withColumn("set", F.when(F.col("n") > 0, F.col("rep"))), "done")
    names = done.groupBy("component").agg(F.min("doc_id").alias("name"))
    firsts = done.groupBy("doc_id", "set").agg(F.min("key").alias("key")).select("key", F.lit(True).alias("first"))
    both = done.join(names, "component").join(firsts, "key", "left")
    return both.select("key", "doc_id", "n", F.coalesce("first", F.lit(False)).alias("first"), F.col("name").alias("component"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(``docs`` (doc_id, ...) with ``key``, whether ids are unique); key: doc_id, or where ids repeat a number of the row, fixed by writing the rows."""
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("key", F.col("doc_id")), True
    return written(docs.withColumn("key", F.monotonically_increasing_id()), "numbered"), False


def document_components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    done = _found(*_keyed(docs.select("doc_id", "text")), size, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    nameless = docs.where("doc_id IS NULL").select("doc_id", "text")
    return done.unionByName(_sizes(nameless, size))


def _sizes(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                _, text, _ = sets_of(part.column("text"), size)
                n = np.bincount(text, minlength=part.num_rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.nulls(part.num_rows, pa.int64())], ["doc_id", "n_shingles", "component_id"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, component_id bigint")


def first_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; rows that share an id stay if their sets differ, one of each set; rows without an id all stay."""
    rows, unique = _keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    gone = written(_found(rows, unique, size, percent).where("component < doc_id OR NOT first").select("key"), "gone")
    return rows.select("key", "row").join(gone, "key", "left_anti").select("row.*")
