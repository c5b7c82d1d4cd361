"""Hard-negative mining by exact maximum inner product over k-means inverted lists.

Vectors are whole numbers (components times ``SCALE``, rounded down), so scores
are exact. Centroids are fitted on a bounded sample; every row joins the list
of its nearest one, and each list has a stored radius. For an anchor q and a
list with centroid c and radius r, Cauchy-Schwarz bounds all scores by
q·c ± |q| r. An anchor visits lists from the greatest upper bound on, in rounds
that grow; lists whose bounds miss the wanted window are skipped, and the search
ends when the next upper bound is strictly below the k-th score found. That is
exact: no row that could be among the results is left out.

First come the positives (best rows of the anchor's label), then the negatives
(best rows of other labels inside the window that each positive's score opens).

Lists are stored as blocks of bounded size, a long list as many of them, and
blocks stand in shelves, each a task's work. A round sends an anchor once to each
shelf that has lists it asks for, whatever the number of these lists; a task
reads its shelf, then the anchors one after another, scores them ``PACK`` at a
time by matrix products and keeps the k best of each. The k best of all come from
a window that Spark limits before the shuffle. Nothing that grows with the
anchors is broadcast: Parquet stores a repeated vector once, so the size of a file
says little about that of its rows. Only list sizes, radii and the centroids (at
most ``LISTS`` rows each, at most ``CENTROID_BYTES``) and a number for each block
pass through the driver.

Defined cases: rows without id, label or vector, or with a null or
non-finite component, take no part; a shorter vector counts as filled up with
zeros; "other" rows are those with another id, so a copy under the anchor's own
id is none; different rows under one anchor id mine each for itself, equal ones
once; rows that share an id are ranked each; an anchor without positives, or a
positive without negatives, gives no rows; an empty table gives none. Scores
beyond the range of long are cut to its ends. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import bounded_batches, freed, written

#: Factor of the components before they are rounded down.
SCALE = 256
#: Rows of the sample that centroids are fitted on, and its bytes.
SAMPLE = 20_000
SAMPLE_BYTES = 32 << 20
#: Most lists, and bytes of all centroids.
LISTS = 1024
CENTROID_BYTES = 16 << 20
#: Bytes of a block of vectors (at eight bytes a component), rows of the smallest one that a list is cut into, blocks that all rows should give at least.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 500
BLOCKS = 200
#: Bytes of a shelf of blocks (as stored), shelves that all rows should give at least if each has ``BLOCK_ROWS``.
SHELF_BYTES = 32 << 20
SHELVES = 64
#: Anchors and rows that are scored together, and candidates from which on the best of them are taken.
PACK = 512
TILE = 1024
CANDIDATES = 50_000
#: Labels of a pack up to which rows of its labels are scored one label at a time, others not at all.
FEW_LABELS = 4
#: Lists visited after each round.
ROUNDS = (4, 16, 64)
#: Results of a search, and the percent of a positive's score that a negative has at least.
BEST = 5
LEAST_SHARE = 80

_MOST = 2**63 - 1
_LIMIT = 2.0**62


def usable(rows: DataFrame, key: str, vector: str, label: str) -> Column:
    """Whether a row takes part."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists as scaled whole numbers (rows x width), short rows filled up with zeros."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    values = np.asarray(column.flatten()).astype(np.float64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.clip(np.floor(values * SCALE), -_LIMIT, _LIMIT).astype(np.int64)
    return out


def _packed(vectors: np.ndarray) -> tuple[bytes, int]:
    """(bytes, bytes of a component) in the narrowest width that holds all."""
    width = next(w for w in (2, 4, 8) if w == 8 or abs(vectors).max(initial=0) < 1 << (8 * w - 1))
    return vectors.astype(f"<i{width}").tobytes(), width


def _unpacked(vectors: list[bytes], widths: list[int]) -> np.ndarray:
    """The vectors of ``_packed`` (rows x width), short ones filled up with zeros."""
    if len(set(widths)) == 1 and len(set(map(len, vectors))) == 1:
        return np.frombuffer(b"".join(vectors), f"<i{widths[0]}").reshape(len(vectors), -1)
    rows = [np.frombuffer(v, f"<i{w}") for v, w in zip(vectors, widths, strict=True)]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), f"<i{max(widths, default=2)}")
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths of the rows, rounded up."""
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of the two, exact; the shorter rows count as filled up with zeros."""
    d = min(a.shape[1], b.shape[1])
    exact = a[:, :d].astype(object) @ b[:, :d].astype(object).T
    return np.clip(exact, -_MOST, _MOST).astype(np.int64)


def fit_centroids(sample: np.ndarray, lists: int, turns: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spread rows of the sample; a centroid that loses its rows stays where it is."""
    if not len(sample):
        return np.zeros((1, max(1, sample.shape[1])))
    data = sample.astype(np.float64)
    centroids = np.unique(data[np.linspace(0, len(data) - 1, min(lists, len(data))).astype(int)], axis=0)
    for _ in range(turns):
        nearest = _nearest(data, centroids)[0]
        counts = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, data)
        held = counts > 0
        centroids[held] = sums[held] / counts[held, None]
    return centroids


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, distance rounded up) of the nearest centroid of each row."""
    width = max(vectors.shape[1], centroids.shape[1])
    vectors, centroids = _widened(vectors, width), _widened(centroids, width)
    half = (centroids * centroids).sum(1) / 2
    nearest = np.concatenate([np.argmin(half - part @ centroids.T, 1) for part in np.array_split(vectors, len(vectors) // 4096 + 1)])
    distance = np.sqrt(((vectors - centroids[nearest]) ** 2).sum(1))
    return nearest, distance * (1 + 1e-9) + 1e-6


class Index:
    """Lists of all rows as blocks: ``blocks`` (shelf, list, block, n, ids, labels, vectors, width); ``centroids``, ``radii``, ``counts`` of blocks by list; ``shelves``, the lists of each shelf."""

    def __init__(self, rows: DataFrame, key: str, vector: str, label: str) -> None:
        """``rows`` must hold usable rows only."""
        spark = rows.sparkSession
        bounded_batches(spark)
        n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(0))).first()
        width = max(1, width)
        sample = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
        drawn = F.xxhash64(key, vector)  # of many rows about twice the sample is sorted
        some = rows.where(F.pmod(drawn, F.lit(max(1, n // (2 * sample)))) == 0).orderBy(drawn).limit(sample).select(vector).toArrow()
        lists = min(LISTS, max(16, int(n**0.5) // 2), max(1, CENTROID_BYTES // (8 * width)))
        self.centroids = centroids = fit_centroids(_matrix(some.column(0).combine_chunks()), lists)
        shared = spark.sparkContext.broadcast(centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = _matrix(batch.column(1))
                if not len(vectors):
                    continue
                nearest, distance = _nearest(vectors.astype(np.float64), shared.value)
                packed = [_packed(v) for v in vectors]
                yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), pa.array(distance), batch.column(0), batch.column(2), pa.array([p for p, _ in packed], pa.binary()), pa.array([w for _, w in packed], pa.int32())], ["list", "distance", "id", "label", "vector", "width"])

        told = rows.select(F.col(key).cast("long"), vector, F.col(label).cast("long")).mapInArrow(assign, "list int, distance double, id bigint, label bigint, vector binary, width int")
        assigned = written(told.withColumn("row", F.monotonically_increasing_id()), "assigned")
        stats = assigned.groupBy("list").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.max("width").alias("width")).collect()  # a row a list
        self.radii, self.counts, per_block = np.full(len(centroids), -1.0), np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
        size = max(1, min(BLOCK_BYTES // (8 * width), max(BLOCK_ROWS, n // BLOCKS)))
        for row in stats:
            self.radii[row["list"]], self.counts[row["list"]] = row["radius"], (blocks := -(-row["n"] // size))
            per_block[row["list"]] = row["n"] / blocks
        # blocks in the order of their lists, as many to a shelf as make up its rows
        stored = width * max((row["width"] for row in stats), default=8)
        most, of_block = max(1, min(SHELF_BYTES // stored, max(BLOCK_ROWS, n // SHELVES))), np.repeat(per_block, self.counts)
        shelf_of = np.unique((np.cumsum(of_block) - of_block) // most, return_inverse=True)[1].astype(np.int64)
        first, list_of = np.cumsum(self.counts) - self.counts, np.repeat(np.arange(len(centroids)), self.counts)
        self.shelves = [np.unique(x) for x in np.split(list_of, np.flatnonzero(np.diff(shelf_of)) + 1)]
        placed = spark.sparkContext.broadcast((first, shelf_of))

        def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _block_rows(batches, *placed.value)

        parts = F.element_at(F.array(*[F.lit(int(max(1, c))) for c in self.counts]), F.col("list") + 1)
        keyed = assigned.withColumn("block", F.pmod(F.xxhash64("row"), parts).cast("int"))
        self.blocks = written(keyed.repartition("list", "block").sortWithinPartitions("list", "block").select("list", "block", "id", "label", "vector", "width").mapInArrow(block_rows, "shelf int, list int, block int, n int, ids binary, labels binary, vectors binary, width int"), "blocks")
        freed(assigned)


def _block_rows(batches: Iterator[pa.RecordBatch], first: np.ndarray, shelf_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each block of the sorted rows. ``first``: number of each list's first block; ``shelf_of``: the shelf by this number."""
    names = ["shelf", "list", "block", "n", "ids", "labels", "vectors", "width"]

    def packed(key: tuple[int, int], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        widths = rows.column("width").to_pylist()
        out = _unpacked(rows.column("vector").to_pylist(), widths)
        shelf = shelf_of[first[key[0]] + key[1]]
        columns = [np.asarray(rows.column(x).combine_chunks()).astype("<i8").tobytes() for x in ("id", "label")]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (np.int32(shelf), *map(np.int32, key), np.int32(len(out)), *columns, out.tobytes(), np.int32(max(widths)))], names)

    now, held = None, []
    for batch in batches:
        keys = np.asarray(batch.column(0)).astype(np.int64) << 32 | np.asarray(batch.column(1))
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            key = (int(keys[a]) >> 32, int(keys[a]) & 0xFFFFFFFF)
            if held and key != now:
                yield packed(now, held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield packed(now, held)


#: In the place of a list, on the rows of anchors: these follow the blocks of their shelf.
_LAST = 2**31 - 1
_WINDOWS = "array<struct<w: bigint, low: bigint, high: bigint>>"


def _windows(column: pa.Array) -> tuple[np.ndarray, ...]:
    """(number of windows by anchor, w, low, high)."""
    return np.asarray(column.value_lengths()).astype(np.int64), *(np.asarray(x) for x in column.flatten().flatten())


def _asks(state: DataFrame, index: Index, begin: int, end: int) -> DataFrame:
    """(shelf, list, vectors, width, uid, id, label, windows, wanted): each anchor once for each shelf that holds any of those of its lists from place ``begin`` to before ``end`` that may matter; ``wanted`` has a bit for each list of the shelf."""
    shared = state.sparkSession.sparkContext.broadcast((index.centroids, index.radii, index.counts, index.shelves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, radii, counts, shelves = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                q = _unpacked(part.column(3).to_pylist(), part.column(4).to_pylist()).astype(np.float64)
                d = min(q.shape[1], centroids.shape[1])
                middle, spread = q[:, :d] @ centroids[:, :d].T, np.sqrt((q * q).sum(1))[:, None] * radii
                slack = 1 + 1e-9 * (abs(middle) + spread)
                upper, lower = middle + spread + slack, middle - spread - slack
                order = np.argsort(np.where(counts > 0, -upper, np.inf), axis=1, kind="stable")
                place = np.empty_like(order)
                np.put_along_axis(place, order, np.arange(len(counts))[None], 1)
                n, _, low, high = _windows(part.column(5))
                of = np.repeat(np.arange(len(n)), n)
                needed = np.zeros(upper.shape, bool)
                if len(of):
                    meets = (upper[of] >= low[:, None]) & (lower[of] <= high[:, None])
                    needed[n > 0] = np.logical_or.reduceat(meets, (np.cumsum(n) - n)[n > 0])
                needed &= (place >= begin) & (place < end) & (counts > 0)
                asked = needed.any(0)
                for shelf, lists in enumerate(shelves):
                    if asked[lists].any():
                        here = needed[:, lists]
                        rows = np.flatnonzero(here.any(1))
                        told = part.take(pa.array(rows))
                        wanted = pa.array([x.tobytes() for x in np.packbits(here[rows], axis=1)], pa.binary())
                        keys = [pa.array(np.full(len(rows), x, np.int32)) for x in (shelf, _LAST)]
                        yield pa.RecordBatch.from_arrays([*keys, *(told.column(i) for i in (3, 4, 0, 1, 2, 5)), wanted], ["shelf", "list", "vectors", "width", "uid", "id", "label", "windows", "wanted"])

    spread_out = state.repartition(state.sparkSession.sparkContext.defaultParallelism, "uid")
    return spread_out.mapInArrow(run, f"shelf int, list int, vectors binary, width int, uid bigint, id bigint, label bigint, windows {_WINDOWS}, wanted binary")


class _Shelf:
    """The blocks of a shelf, its rows by list and label."""

    def __init__(self, lists: np.ndarray, rows: list[tuple[int, bytes, bytes, bytes, int]]) -> None:
        """``rows``: (list, ids, labels, vectors, width), by list."""
        self.ids, self.labels = (np.frombuffer(b"".join(row[i] for row in rows), "<i8") for i in (1, 2))
        sizes = np.array([len(row[1]) // 8 for row in rows])
        parts = [np.frombuffer(row[3], f"<i{row[4]}").reshape(n, -1) for row, n in zip(rows, sizes, strict=True)]
        self.vectors = np.zeros((sizes.sum(), max(p.shape[1] for p in parts)), f"<i{max(row[4] for row in rows)}")
        at = 0
        for p in parts:
            self.vectors[at : at + len(p), : p.shape[1]] = p
            at += len(p)
        list_of = np.repeat([row[0] for row in rows], sizes)
        order = np.lexsort((self.labels, list_of))
        self.ids, self.labels, self.vectors = self.ids[order], self.labels[order], self.vectors[order]
        ends = np.searchsorted(list_of, lists, "right")
        self.ranges = list(zip([0, *ends.tolist()], ends.tolist(), strict=False))
        self.norms = _norms(self.vectors)
        self.as_floats: dict[type, np.ndarray] = {}

    def of_label(self, a: int, b: int, label: int) -> tuple[int, int]:
        """The part of one list's range with a label."""
        labels = self.labels[a:b]
        return a + int(np.searchsorted(labels, label)), a + int(np.searchsorted(labels, label, "right"))

    def scores(self, anchors: np.ndarray, norm: float, a: int, b: int) -> np.ndarray:
        """Inner products of anchors, none longer than ``norm``, with the shelf's rows from ``a`` to before ``b``; exact, as no sum of products is beyond the product of both lengths."""
        most = norm * self.norms[a:b].max(initial=0)
        if most >= 2.0**53:
            return _scores(anchors, self.vectors[a:b])
        kind = np.float32 if most < 2.0**24 else np.float64
        if kind not in self.as_floats:
            self.as_floats[kind] = self.vectors.astype(kind)
        d = min(anchors.shape[1], self.vectors.shape[1])
        return anchors[:, :d].astype(kind) @ self.as_floats[kind][a:b, :d].T


class _Best:
    """The best rows so far for each window of a pack's anchors."""

    def __init__(self, n: np.ndarray, low: np.ndarray, high: np.ndarray, best: int) -> None:
        """``n``: windows by anchor, one at least."""
        self.n, self.first, self.best = n, np.cumsum(n) - n, best
        self.low, self.high = low.copy(), high
        self.last_id = np.full(len(low), _MOST)
        self.window, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))
        self.lowest = np.minimum.reduceat(low, self.first)

    def add(self, anchor: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows for anchors. A full window's least row then bounds it."""
        n = self.n[anchor]
        row = np.repeat(np.arange(len(anchor)), n)
        window = self.first[anchor][row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        score, low = scores[row], self.low[window]
        fits = (score <= self.high[window]) & ((score > low) | ((score == low) & (ids[row] <= self.last_id[window])))
        told = [np.concatenate(x) for x in ((self.window, window[fits]), (self.id, ids[row[fits]]), (self.score, score[fits]))]
        order = np.lexsort((told[1], -told[2], told[0]))
        window, ids, score = (x[order] for x in told)
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        self.window, self.id, self.score = (x[rank < self.best] for x in (window, ids, score))
        full = rank == self.best - 1
        self.low[window[full]], self.last_id[window[full]] = score[full], ids[full]
        self.lowest = np.minimum.reduceat(self.low, self.first)


def _hits_of(shelf: _Shelf, pack: pa.RecordBatch, same: bool, best: int) -> pa.RecordBatch:
    """(uid, w, id, score): the best rows of a shelf for each window of each anchor of a pack."""
    vectors, width, uid, own_id, label, windows, wanted = (pack.column(i) for i in range(4, 11))
    anchors = _unpacked(vectors.to_pylist(), width.to_pylist())
    uid, own_id, label = (np.asarray(x) for x in (uid, own_id, label))
    n, w, low, high = _windows(windows)
    bits = np.unpackbits(np.frombuffer(b"".join(wanted.to_pylist()), np.uint8).reshape(len(uid), -1), axis=1).astype(bool)
    norms, found = _norms(anchors), _Best(n, low, high, best)
    waiting: list[tuple[np.ndarray, ...]] = []

    def settle() -> None:
        if waiting:
            found.add(*map(np.concatenate, zip(*waiting, strict=True)))
            waiting.clear()

    for k, (a, b) in enumerate(shelf.ranges):
        asking = np.flatnonzero(bits[:, k])
        if a == b or not len(asking):
            continue
        parts = [(asking, a, b)]
        if same and len(labels := np.unique(label[asking])) <= FEW_LABELS:
            parts = [(asking[label[asking] == x], *shelf.of_label(a, b, x)) for x in labels]
        for members, begin, end in parts:
            for at in range(begin, end, TILE):
                scores = shelf.scores(anchors[members], norms[members].max(), at, min(end, at + TILE))
                low = found.lowest[members].astype(scores.dtype)
                some = np.flatnonzero(scores.max(1) >= low)
                if not len(some):
                    continue
                i, j = np.divmod(np.flatnonzero(scores[some] >= low[some, None]), scores.shape[1])
                who, row = members[some[i]], at + j
                right = ((shelf.labels[row] == label[who]) == same) & (shelf.ids[row] != own_id[who])
                waiting.append((who[right], shelf.ids[row[right]], scores[some[i[right]], j[right]].astype(np.int64)))
                if sum(len(x[0]) for x in waiting) > CANDIDATES:
                    settle()
    settle()
    of = np.repeat(np.arange(len(n)), n)[found.window]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[of], w[found.window], found.id, found.score)], ["uid", "w", "id", "score"])


def _hits(asks: DataFrame, index: Index, same: bool, best: int) -> DataFrame:
    """(uid, w, id, score): the best rows of each shelf for each window of each anchor that asks there."""
    shared = asks.sparkSession.sparkContext.broadcast(index.shelves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, shelf = None, [], None
        for batch in batches:
            shelves, of_anchors = np.asarray(batch.column(0)), np.asarray(batch.column(1)) == _LAST
            cuts = [0, *(np.flatnonzero((np.diff(shelves) != 0) | (of_anchors[1:] != of_anchors[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shelves[a] != now:
                    now, blocks, shelf = shelves[a], [], None
                if not of_anchors[a]:
                    blocks += zip(*(batch.column(i)[a:b].to_pylist() for i in (1, 2, 3, 4, 5)), strict=True)
                    continue
                if shelf is None:
                    shelf, blocks = _Shelf(shared.value[now], blocks), []
                for at in range(a, b, PACK):
                    yield _hits_of(shelf, batch.slice(at, min(PACK, b - at)), same, best)

    dealt = index.blocks.select("shelf", "list", "ids", "labels", "vectors", "width").unionByName(asks, allowMissingColumns=True)
    dealt = dealt.repartitionById(max(1, len(index.shelves)), "shelf").sortWithinPartitions("shelf", "list", "label")  # packs of one label
    return dealt.select("shelf", "list", "ids", "labels", "vectors", "width", "uid", "id", "label", "windows", "wanted").mapInArrow(run, "uid bigint, w bigint, id bigint, score bigint")


def search(index: Index, state: DataFrame, same: bool, best: int = BEST) -> DataFrame:
    """(uid, w, rank, id, score): the ``best`` rows, by score, then id, that each window of each anchor admits.

    ``state``: (uid, id, label, vector, width, windows), an anchor a row; windows admit scores from low to high. ``same``: rows of the anchor's label, else of others.
    """
    order = Window.partitionBy("uid", "w").orderBy(F.col("score").desc(), "id")
    found = None
    lists = len(index.centroids)
    places = [0, *(p for p in ROUNDS if p < lists), lists]
    for begin, end in zip(places, places[1:], strict=False):
        open_now = state
        if found is not None:
            # windows with enough results want no score below their last one's
            full = found.where(F.col("rank") == best).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
            raised = F.transform("windows", lambda x: x.withField("low", F.greatest(x["low"], F.coalesce(F.try_element_at("kth", x["w"]), x["low"]))))
            open_now = state.join(full.hint("merge"), "uid", "left").withColumn("windows", raised).drop("kth").select(*state.columns)
        hits = _hits(_asks(open_now, index, begin, end), index, same, best)
        both = hits if found is None else hits.unionByName(found.drop("rank"))
        older, found = found, written(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best), "found")
        freed(*([older] if older is not None else []))
    return found


def mine(rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", best: int = BEST, least_share: int = LEAST_SHARE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its ``best`` positives.

    Negatives score from ``least_share`` percent of the positive's score to the whole of it.
    """
    rows = rows.select(key, vector, label).where(usable(rows, key, vector, label))
    index = Index(rows, key, vector, label)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_packed(v) for v in _matrix(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([p for p, _ in packed], pa.binary()), pa.array([w for _, w in packed], pa.int32())], ["id", "label", "vector", "width"])

    anchors = rows.where(is_anchor).select(F.col(key).cast("long").alias("id"), vector, F.col(label).cast("long").alias("label"))
    anchors = anchors.mapInArrow(whole, "id bigint, label bigint, vector binary, width int").distinct()
    anchors = written(anchors.withColumn("uid", F.monotonically_increasing_id()), "anchors")
    all_scores = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(-_MOST).alias("low"), F.lit(_MOST).alias("high")))
    columns = ["uid", "id", "label", "vector", "width", "windows"]
    positives = search(index, anchors.withColumn("windows", all_scores).select(*columns), True, best)
    # the window of a score s, by its number s: 100 n >= least_share * s and n <= s; none below zero
    s = F.col("score")
    low = -F.floor(-(F.lit(least_share).cast("decimal(38,0)") * s) / 100).cast("long")
    opened = positives.where("score >= 0").select("uid", s.alias("w"), low.alias("low"), s.alias("high")).distinct()
    windows = opened.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("w", "low", "high"))).alias("windows"))
    negatives = search(index, anchors.join(windows.hint("merge"), "uid").select(*columns), False, best)
    told = positives.select("uid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    mined = told.join(negatives.select("uid", F.col("w").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge"), ["uid", "positive_score"])
    named = mined.join(anchors.select("uid", F.col("id").alias("anchor_id")).hint("merge"), "uid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
