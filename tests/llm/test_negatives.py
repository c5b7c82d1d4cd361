"""Hard negatives against a plain search of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100, best=5, share=80):
    """The rows of ``mine`` from the definition; ``rows``: (id, vector, label)."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, lab in sorted({(i, tuple(v), lab) for i, v, lab in good if i % every == 0}):
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in good if j != i))
        same = [(-s, j) for s, j, other in scored if other == lab][:best]
        for ps, j in same:
            hard = [(-s, k) for s, k, other in scored if other != lab and share * ps <= -100 * s <= 100 * ps][:best]
            out += [(i, j, rank + 1, k, ps, ns) for rank, (ns, k) in enumerate(hard)]
    return sorted(out)


def found(frame, every=100):
    return sorted(tuple(r) for r in negatives.mine(frame, F.col("vec_id") % every == 0).collect())


def vectors(rng, n, d=8, spread=0.5):
    middles = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    return [[c + rng.gauss(0, spread) for c in rng.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("rows_of_block", [7, 500])
def test_search_is_exact(spark, monkeypatch, rows_of_block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", rows_of_block)
    monkeypatch.setattr(negatives, "BLOCKS", 10_000)
    rng = random.Random(12)
    rows = [(i, v, rng.randrange(3)) for i, v in enumerate(vectors(rng, 900))]
    hot = rows[0][1]
    rows += [(900 + i, hot, rng.randrange(3)) for i in range(400)]  # a common vector, and with it many ties
    told = found(spark.createDataFrame(rows, SCHEMA), 25)
    assert told == plain(rows, 25)
    assert len(told) > 200


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, v, rng.randrange(2)) for i, v in enumerate(vectors(rng, 60, 3))]
    rows += [(None, [1.0, 1.0, 1.0], 0), (300, None, 0), (301, [1.0, None, 0.0], 0), (302, [float("nan"), 0.0, 0.0], 1), (303, [float("inf"), 0.0, 0.0], 1), (304, [1.0, 1.0, 1.0], None)]
    rows += [(400, [], 0), (401, [2.0], 1), (402, [2.0, 0.0, 0.0, 5.0, 1.0], 0), (403, [3e12, 0.0, 0.0], 1), (404, [-3e12, 0.0, 0.0], 0)]
    rows += [rows[20], rows[20], (20, [0.5, 0.5, 0.5], 0), (20, [0.5, 0.5, 0.5], 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in ("list", "block", "n", "id", "uid", "w", "rank", "score", "width", "row", "distance"):
        frame = frame.withColumn(name, F.lit("x"))
    assert found(frame, 20) == plain(rows, 20)
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert negatives.mine(frame, F.lit(False)).collect() == []
    assert negatives.mine(frame.where("vec_id = 20").limit(1), F.lit(True)).collect() == []


def test_bounds_hold(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    index = negatives.Index(frame, "vec_id", "embedding", "label")
    blocks = index.blocks.collect()
    assert sum(b.n for b in blocks) == frame.count()
    for b in blocks:
        rows = np.frombuffer(b.vectors, f"<i{b.width}").reshape(b.n, -1)
        assert (np.sqrt(((rows - index.centroids[b.list]) ** 2).sum(1)) <= index.radii[b.list]).all()


def test_whole_table(spark, small, duck):
    told = duck.execute(queries.SQL["op12_hard_negatives"]).fetchall()
    rows = queries.op12_hard_negatives(spark, small)
    assert sorted(map(tuple, rows.collect())) == sorted(told)
    assert told


def test_search_broadcasts_no_anchors(spark, monkeypatch):
    """Files of anchors are far smaller than their rows, so a join chosen by file size would send all of these through the driver."""
    plans = []

    def seen(frame, name, write=negatives.written):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return write(frame, name)

    monkeypatch.setattr(negatives, "written", seen)
    rng = random.Random(6)
    rows = [(i, v, rng.randrange(3)) for i, v in enumerate(vectors(rng, 600, 4, 3.0))]
    mined = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    plans.append(mined._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_an_anchor_goes_once_to_a_shelf(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 10)
    monkeypatch.setattr(negatives, "SHELVES", 8)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], rng.randrange(3)) for i in range(1200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    index = negatives.Index(frame, "vec_id", "embedding", "label")
    placed = index.blocks.groupBy("list", "block").agg(F.count_distinct("shelf").alias("n"), F.max("shelf").alias("shelf")).collect()
    assert {p.n for p in placed} == {1}
    assert {p.shelf for p in placed} == set(range(len(index.shelves)))
    assert all(p.list in index.shelves[p.shelf] for p in placed)
    assert len(placed) > 2 * len(index.shelves)
    one = np.full(16, 3, "<i2").tobytes()
    state = spark.createDataFrame([(i, i, 0, one, 2, [(0, -(2**62), 2**62), (1, 5, 9)]) for i in range(300)], "uid long, id long, label long, vector binary, width int, windows array<struct<w: long, low: long, high: long>>")
    asks = negatives._asks(state, index, 0, len(index.centroids)).groupBy("shelf", "uid").count().collect()
    assert {a["count"] for a in asks} == {1}
    assert len(asks) == 300 * len(index.shelves)


@pytest.mark.parametrize("most", [2**8, 2**11, 2**20, 2**26, 2**40])
def test_scores_are_exact(most):
    rng = random.Random(most)
    rows = [[[rng.randint(-most, most) for _ in range(d)] for _ in range(n)] for n, d in ((7, 5), (9, 5), (4, 3))]
    packed = [(k, *(np.zeros(len(x), "<i8").tobytes() for _ in range(2)), np.array(x, "<i8").tobytes(), 8) for k, x in zip((2, 5), rows, strict=False)]
    shelf = negatives._Shelf(np.array([2, 3, 5]), packed)
    anchors = np.array(rows[2], np.int64)
    assert shelf.ranges == [(0, 7), (7, 7), (7, 16)]
    for a, b, list_rows in ((0, 7, rows[0]), (7, 16, rows[1]), (9, 9, [])):
        told = shelf.scores(anchors, negatives._norms(anchors).max(), a, b)
        cut = 2**63 - 1
        assert [[int(x) for x in row] for row in told] == [[max(-cut, min(cut, sum(a * b for a, b in zip(x, y, strict=False)))) for y in list_rows] for x in rows[2]]


@pytest.mark.parametrize("few_labels", [0, 3])
def test_labels_of_a_pack(spark, monkeypatch, few_labels):
    monkeypatch.setattr(negatives, "FEW_LABELS", few_labels)
    monkeypatch.setattr(negatives, "PACK", 11)
    monkeypatch.setattr(negatives, "TILE", 5)
    monkeypatch.setattr(negatives, "CANDIDATES", 20)
    rng = random.Random(16)
    rows = [(i, v, rng.choice([-3, 0, 2, 2, 2**31 - 1])) for i, v in enumerate(vectors(rng, 400, 5))]
    rows += [(400 + i, rows[0][1], rng.choice([0, 2])) for i in range(60)]
    told = found(spark.createDataFrame(rows, SCHEMA), 10)
    assert told == plain(rows, 10)
    assert told
