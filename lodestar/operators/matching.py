"""Box matching, suppression, assignment and nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.geometry import Box, center_distance, iou, overlap
from lodestar.functions.vectors import cosine_distance

CORNERS = ["x1", "y1", "x2", "y2"]


def box_pairs(left: DataFrame, right: DataFrame, frame: str, least: float = 0.0) -> DataFrame:
    """Pairs of a frame's boxes (id and corners, prefixed l_ and r_) with iou and distance; an equi-join on the frame."""
    a = left.select(frame, *[F.col(c).alias("l_" + c) for c in ["id", *CORNERS]])
    b = right.select(frame, *[F.col(c).alias("r_" + c) for c in ["id", *CORNERS]])
    both = a.join(b, frame)
    return both.withColumns({"iou": iou(Box("l_"), Box("r_")), "distance": center_distance(Box("l_"), Box("r_"))}).where(F.col("iou") >= least)


def greedy_one_to_one(pairs: DataFrame, frame: str, threshold: float) -> DataFrame:
    """(frame, l_id, r_id, iou): pairs of a frame taken by (iou, l_id, r_id) falling, each side once, down to the threshold.

    A frame's pairs (bounded by its boxes) fold over one ordered array.
    """
    types = dict(pairs.dtypes)
    pair = F.struct(F.col("iou").cast("double").alias("iou"), "l_id", "r_id")
    ordered = pairs.where(F.col("iou") >= threshold).groupBy(frame).agg(F.sort_array(F.collect_list(pair), asc=False).alias("pairs"))
    kind = f"array<struct<iou:double,l_id:{types['l_id']},r_id:{types['r_id']}>>"
    taken = F.aggregate("pairs", F.array().cast(kind), lambda kept, p: F.when(F.exists(kept, lambda k: (k["l_id"] == p["l_id"]) | (k["r_id"] == p["r_id"])), kept).otherwise(F.array_append(kept, p)))
    return ordered.select(frame, F.explode(taken).alias("p")).select(frame, "p.l_id", "p.r_id", "p.iou")


def detection_totals(truth: DataFrame, predicted: DataFrame, frame: str, bucket: Column, threshold: float = 0.5) -> DataFrame:
    """(bucket, n_truth, n_hit, recall, n_predicted, n_false, precision, false_per_frame): one-to-one greedy matches of each frame.

    Truth falls into buckets (a column of truth boxes); the row ``all`` has every box, and predictions and their
    false ones, which have no bucket. Frames are those with a box of either kind.
    """
    taken = greedy_one_to_one(box_pairs(truth, predicted, frame), frame, threshold)
    hits = truth.withColumn("bucket", bucket).join(taken.select(frame, F.col("l_id").alias("id"), F.lit(1).alias("hit")), [frame, "id"], "left")
    # a row that counts nothing makes the total of no truth a row too
    counted = hits.select("bucket", F.lit(1).alias("n"), F.coalesce("hit", F.lit(0)).alias("hit")).unionByName(truth.sparkSession.createDataFrame([(None, 0, 0)], "bucket string, n int, hit int"))
    slices = counted.rollup("bucket").agg(F.sum("n").alias("n_truth"), F.sum("hit").alias("n_hit"), F.grouping("bucket").alias("_whole")).where("_whole = 1 OR n_truth > 0")
    frames = truth.select(frame).unionByName(predicted.select(frame)).distinct().agg(F.count("*").alias("_frames"))
    rest = predicted.agg(F.count("*").alias("n_predicted")).withColumn("_k", F.lit(1)).join(frames.withColumn("_k", F.lit(1)), "_k").drop("_k")
    rows = slices.join(F.broadcast(rest.withColumn("_whole", F.lit(1).cast("tinyint"))), "_whole", "left")
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    wrong = F.when(F.col("_whole") == 1, F.greatest(F.lit(0), F.col("n_predicted") - F.col("n_hit")))
    return rows.select(
        F.when(F.col("_whole") == 1, "all").otherwise(F.col("bucket")).alias("bucket"), "n_truth", "n_hit", share(F.col("n_hit"), F.col("n_truth")).alias("recall"), "n_predicted", wrong.alias("n_false"),
        F.when(F.col("_whole") == 1, share(F.col("n_hit"), F.col("n_predicted"))).alias("precision"), (wrong / F.greatest(F.lit(1), F.col("_frames"))).alias("false_per_frame"),
    )


def selected_profile(profiles: DataFrame, name: str, current: str) -> DataFrame:
    """The one row of ``profiles`` (name, recall, precision, false_rate) with 0.95 of the current one's recall at least (a fixed value) that has fewest false boxes, then the highest precision, recall, and the least name."""
    floor = profiles.where(F.col(name) == current).agg(F.max("recall").alias("_r")).withColumn("_k", F.lit(1))
    good = profiles.withColumn("_k", F.lit(1)).join(F.broadcast(floor), "_k").where(F.col("recall") >= 0.95 * F.col("_r")).drop("_k", "_r")
    return good.orderBy("false_rate", F.desc("precision"), F.desc("recall"), name).limit(1)


def clear_of(candidates: DataFrame, signs: DataFrame, frame: str, most: float) -> DataFrame:
    """The candidates (frame, id, corners) that hold the centre of no sign of their frame and cover no more than ``most`` of a sign's area."""
    box, sign = Box(""), Box("s_")
    told = signs.select(F.col(frame).alias("s_frame"), *[F.col(c).alias("s_" + c) for c in CORNERS])
    cx, cy = sign.center
    covered = F.coalesce(F.try_divide(overlap(box, sign), sign.area) > most, F.lit(False))
    return candidates.join(told, (F.col(frame) == F.col("s_frame")) & (cx.between(box.x1, box.x2) & cy.between(box.y1, box.y2) | covered), "left_anti")


def suppressed(boxes: DataFrame, frame: str, most: float = 0.45) -> DataFrame:
    """The boxes (frame, id, corners, score) that non-maximum suppression keeps: by falling score (then id), those under ``most`` with all kept.

    A frame's boxes fold over one ordered array.
    """
    rows = boxes.select(frame, "id", *CORNERS, "score")
    box = F.struct((-F.col("score")).alias("order"), F.col("id"), *CORNERS, F.col("score"))
    ordered = rows.groupBy(frame).agg(F.sort_array(F.collect_list(box)).alias("boxes"))

    def overlapping(a: Column, b: Column) -> Column:
        both = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
        return F.coalesce(F.try_divide(both, area(a) + area(b) - both) >= most, F.lit(False))

    kind = ordered.schema["boxes"].dataType.simpleString()
    kept = F.aggregate("boxes", F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: overlapping(k, x)), kept).otherwise(F.array_append(kept, x)))
    return ordered.select(frame, F.explode(kept).alias("b")).select(frame, "b.id", *[f"b.{c}" for c in CORNERS], "b.score")


def iou_arrays(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    low, high = np.maximum(box[:2], others[:, :2]), np.minimum(box[2:], others[:, 2:])
    both = np.clip(high - low, 0, None).prod(1)
    union = (box[2:] - box[:2]).prod() + (others[:, 2:] - others[:, :2]).prod(1) - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, by shortest augmenting paths over potentials."""
    turned = cost.shape[0] > cost.shape[1]
    c = np.asarray(cost.T if turned else cost, float)
    n, m = c.shape
    if n == 0:
        return []
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        reach, parent, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column, far = row, -1, 0.0
        while True:
            through = far + c[at] - row_price[at] - column_price
            better = ~done & (through < reach)
            reach[better], parent[better] = through[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            far = reach[column]
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        for j in np.flatnonzero(done):
            if owner[j] >= 0:
                row_price[owner[j]] += far - reach[j]
            column_price[j] -= far - reach[j]
        row_price[row] += far
        while column >= 0:
            before = parent[column]
            owner[column] = owner[before] if before >= 0 else row
            column = before
    pairs = [(int(owner[j]), j) for j in range(m) if owner[j] >= 0]
    return sorted((j, i) for i, j in pairs) if turned else sorted(pairs)


def assignments(cost: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``assignment`` of many problems at once: the row of each column, -1 for none.

    ``cost`` is (problem, row, column). Problem k has ``rows[k]`` rows and at least as many columns; cells beyond its own columns are inf.
    """
    problems, n, m = cost.shape
    row_price, column_price = np.zeros((problems, n)), np.zeros((problems, m))
    owner = np.full((problems, m), -1)
    for row in range(n):
        who = np.flatnonzero(rows > row)
        reach, parent, done = np.full((len(who), m), np.inf), np.full((len(who), m), -1), np.zeros((len(who), m), bool)
        at, column, far = np.full(len(who), row), np.full(len(who), -1), np.zeros(len(who))
        live = np.arange(len(who))
        while live.size:
            k, i = who[live], at[live]
            through = far[live, None] + cost[k, i] - row_price[k, i, None] - column_price[k]
            was, taken = reach[live], done[live]
            better = ~taken & (through < was)
            was = np.where(better, through, was)
            reach[live], parent[live] = was, np.where(better, column[live, None], parent[live])
            j = np.where(taken, np.inf, was).argmin(1)
            far[live], column[live] = was[np.arange(len(j)), j], j
            done[live, j] = True
            at[live] = owner[k, j]
            live = live[at[live] >= 0]
        change = np.where(done, far[:, None] - reach, 0.0)
        k, j = np.nonzero(done & (owner[who] >= 0))
        row_price[who[k], owner[who[k], j]] += change[k, j]
        column_price[who] -= change
        row_price[who, row] += far
        live = np.arange(len(who))
        while live.size:
            k, j = who[live], column[live]
            before = parent[live, j]
            owner[k, j] = np.where(before >= 0, owner[k, before], row)
            column[live] = before
            live = live[before >= 0]
    return owner


def prototypes(vectors: DataFrame, label: str, vector: str, digits: int = 9) -> DataFrame:
    """(label, prototype): the mean vector of each label, rounded, at unit length. One partial aggregate for each element."""
    cells = vectors.select(label, F.posexplode(vector).alias("i", "v"))
    means = cells.groupBy(label, "i").agg(F.round(F.avg(F.col("v").cast("double")), digits).alias("v"))
    rows = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select(label, F.when(length > 0, F.transform("mean", lambda x: x / length)).otherwise(F.col("mean")).alias("prototype"))


#: Rows of the prototype table that may be broadcast.
PROTOTYPES_MOST = 10_000


def nearest(vectors: DataFrame, vector: str, table: DataFrame, label: str) -> DataFrame:
    """``vectors`` with ``nearest`` (label of the closest prototype, of ties the least) and ``distance``.

    The prototypes, a row for each class and counted first, become one array
    that every row folds over, so no pair of rows is formed.
    """
    if table.count() > PROTOTYPES_MOST:
        raise ValueError(f"more than {PROTOTYPES_MOST} prototypes")
    protos = table.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), F.col("prototype").alias("v")))).alias("_protos"))
    held = vectors.withColumn("_one", F.lit(1)).join(F.broadcast(protos.withColumn("_one", F.lit(1))), "_one").drop("_one")
    best = F.array_min(F.transform("_protos", lambda p: F.struct(F.round(cosine_distance(F.col(vector), p["v"]), 9).alias("distance"), p["label"].alias("label"))))
    return held.withColumn("_best", best).withColumns({"nearest": F.col("_best.label"), "distance": F.col("_best.distance")}).drop("_best", "_protos")


def closest_within(rows: DataFrame, values: DataFrame, key: str, value: str, other: str, tolerance: float, order: Column) -> DataFrame:
    """Each row with the nearest ``other`` of its key within the tolerance, ties by ``order``; null if none."""
    from pyspark.sql import Window as W

    numbered = rows.withColumn("_row", F.monotonically_increasing_id()) if "row" not in rows.columns else rows.withColumn("_row", F.col("row"))
    both = numbered.join(values, key, "left").withColumn("_d", F.abs(F.col(value) - F.col(other)))
    near = both.withColumn(other, F.when(F.col("_d") <= tolerance, F.col(other)))
    w = W.partitionBy("_row").orderBy(F.col(other).isNull(), "_d", order)
    return near.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_d", "_row")
