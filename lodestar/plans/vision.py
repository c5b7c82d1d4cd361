"""Boxes, polygons, vectors and the metrics over them, derived from the driver's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import geometry as G
from lodestar.functions import vectors as V
from lodestar.functions.hashing import difference_hash
from lodestar.operators import duplicates, matching, metrics, ranges
from lodestar.plans.registry import query, read

_SQL_BOXES = """b AS (SELECT l_orderkey, l_linenumber AS id, (l_partkey * 37) % 40 AS x1, (l_suppkey * 13) % 40 AS y1,
(l_partkey * 37) % 40 + 20 + l_suppkey % 30 AS x2, (l_suppkey * 13) % 40 + 20 + l_partkey % 30 AS y2, l_quantity::DOUBLE AS score FROM lineitem)"""
_SQL_IOU = """CASE WHEN u > 0 THEN i / u ELSE 0.0 END"""
_SQL_PAIRS = f"""{_SQL_BOXES}, p AS (SELECT a.l_orderkey, a.id AS l_id, c.id AS r_id,
greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1))::DOUBLE AS i,
(a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS u
FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey WHERE a.id % 2 = 1 AND c.id % 2 = 0)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    x, y = F.col("l_partkey") * 37 % 40, F.col("l_suppkey") * 13 % 40
    return rows.select(
        "l_orderkey", F.col("l_linenumber").alias("id"), x.alias("x1"), y.alias("y1"), (x + 20 + F.col("l_suppkey") % 30).alias("x2"), (y + 20 + F.col("l_partkey") % 30).alias("y2"),
        F.col("l_quantity").cast("double").alias("score"),
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd lines stand for the truth, even ones for predictions."""
    boxes = _boxes(spark, sf_dir)
    return matching.box_pairs(boxes.where("id % 2 = 1"), boxes.where("id % 2 = 0"), "l_orderkey")


@query(f"WITH {_SQL_PAIRS} SELECT l_orderkey, l_id, r_id, round({_SQL_IOU}, 6) AS iou FROM p WHERE {_SQL_IOU} >= 0.3")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("iou >= 0.3").select("l_orderkey", "l_id", "r_id", F.round("iou", 6).alias("iou"))


#: Pairs of a frame by falling (iou, l_id, r_id), taken one after another where both sides are free.
_SQL_GREEDY = f"""{_SQL_PAIRS}, o AS (SELECT l_orderkey, l_id, r_id, iou, row_number() OVER (PARTITION BY l_orderkey ORDER BY iou DESC, l_id DESC, r_id DESC) AS i FROM (SELECT l_orderkey, l_id, r_id, {_SQL_IOU} AS iou FROM p) WHERE iou >= 0.3),
r AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS i, 0 AS l_id, 0 AS r_id, 0.0::DOUBLE AS iou, false AS kept, []::INTEGER[] AS ls, []::INTEGER[] AS rs FROM o UNION ALL
SELECT o.l_orderkey, o.i, o.l_id, o.r_id, o.iou, NOT list_contains(ls, o.l_id) AND NOT list_contains(rs, o.r_id), CASE WHEN list_contains(ls, o.l_id) OR list_contains(rs, o.r_id) THEN ls ELSE list_append(ls, o.l_id) END, CASE WHEN list_contains(ls, o.l_id) OR list_contains(rs, o.r_id) THEN rs ELSE list_append(rs, o.r_id) END FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.i = r.i + 1)"""


@query(f"WITH RECURSIVE {_SQL_GREEDY} SELECT l_orderkey, l_id, r_id, round(iou, 6) AS iou FROM r WHERE kept")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy_one_to_one(_pairs(spark, sf_dir), "l_orderkey", 0.3).withColumn("iou", F.round("iou", 6))


@query(f"""WITH RECURSIVE {_SQL_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, id, x1, y1, x2, y2) AS i FROM b),
r AS (SELECT DISTINCT l_orderkey, 0::BIGINT AS i, 0 AS id, 0::BIGINT AS x1, 0::BIGINT AS y1, 0::BIGINT AS x2, 0::BIGINT AS y2, 0.0::DOUBLE AS score, false AS stays, []::STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[] AS kept FROM b UNION ALL
SELECT l_orderkey, i, id, x1, y1, x2, y2, score, stays, CASE WHEN stays THEN list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE kept END FROM (SELECT o.l_orderkey, o.i, o.id, o.x1, o.y1, o.x2, o.y2, o.score, r.kept,
  len([k FOR k IN r.kept IF greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1)) >= 0.45 * ((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1)) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1)))]) = 0 AS stays
  FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.i = r.i + 1))
SELECT l_orderkey, id, x1, y1, x2, y2, score FROM r WHERE stays""")
def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.suppressed(_boxes(spark, sf_dir), "l_orderkey")


@query(f"""WITH {_SQL_PAIRS}, best AS (SELECT l_orderkey, l_id, max({_SQL_IOU}) AS best FROM p GROUP BY ALL),
t AS (SELECT CASE WHEN (x2 - x1) * (y2 - y1) <= 900 THEN 'small' ELSE 'large' END AS bucket, coalesce(best, 0) >= 0.3 AS hit FROM b LEFT JOIN best ON b.l_orderkey = best.l_orderkey AND b.id = best.l_id WHERE b.id % 2 = 1)
SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, count(*) FILTER (WHERE hit) AS n_hit, round(avg(hit::INT), 6) AS recall FROM t GROUP BY ROLLUP (bucket)""")
def recall_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over all, small and large truth boxes, by a rollup."""
    boxes = _boxes(spark, sf_dir).where("id % 2 = 1")
    best = _pairs(spark, sf_dir).groupBy("l_orderkey", F.col("l_id").alias("id")).agg(F.max("iou").alias("best"))
    rows = boxes.join(best, ["l_orderkey", "id"], "left").select(F.when(G.Box().area <= 900, "small").otherwise("large").alias("bucket"), (F.coalesce("best", F.lit(0.0)) >= 0.3).alias("hit"))
    totals = rows.rollup("bucket").agg(F.count("*").alias("n"), F.count_if("hit").alias("n_hit"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("recall"))
    return totals.withColumn("bucket", F.coalesce("bucket", F.lit("all")))


@query(f"""WITH {_SQL_BOXES} SELECT l_orderkey, id FROM b c WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM b a WHERE a.l_orderkey = c.l_orderkey AND a.id % 2 = 1
AND ((a.x1 + a.x2) / 2.0 BETWEEN c.x1 AND c.x2 AND (a.y1 + a.y2) / 2.0 BETWEEN c.y1 AND c.y2 OR greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1))::DOUBLE > 0.05))""")
def overlap_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even boxes that hold the centre of no odd box of their order and cover a twentieth of none."""
    boxes = _boxes(spark, sf_dir)
    return matching.clear_of(boxes.where("id % 2 = 0"), boxes.where("id % 2 = 1"), "l_orderkey", 0.05).select("l_orderkey", "id")


@query(f"""WITH RECURSIVE {_SQL_GREEDY}, t AS (SELECT b.l_orderkey, b.id, CASE WHEN (x2 - x1) * (y2 - y1) <= 0.01 * 90000 THEN 'small' ELSE 'large' END AS bucket, kept IS NOT NULL AS hit FROM b LEFT JOIN (SELECT l_orderkey, l_id, kept FROM r WHERE kept) m ON m.l_orderkey = b.l_orderkey AND m.l_id = b.id WHERE b.id % 2 = 1),
n AS (SELECT count(*) FILTER (WHERE id % 2 = 0) AS n_predicted, count(DISTINCT l_orderkey) AS frames FROM b),
s AS (SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n_truth, count(*) FILTER (WHERE hit) AS n_hit FROM t GROUP BY ROLLUP (bucket))
SELECT bucket, n_truth, n_hit, round(n_hit / n_truth, 6) AS recall, CASE WHEN bucket = 'all' THEN n_predicted END AS n_predicted, CASE WHEN bucket = 'all' THEN n_predicted - n_hit END AS n_false, CASE WHEN bucket = 'all' THEN round(n_hit / n_predicted, 6) END AS "precision", CASE WHEN bucket = 'all' THEN round((n_predicted - n_hit) / frames, 6) END AS false_per_frame FROM s, n""")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, precision and false boxes of one-to-one matches, small and large truth apart."""
    boxes = _boxes(spark, sf_dir)
    bucket = F.when(G.Box().area <= 0.01 * 90_000, "small").otherwise("large")
    done = matching.detection_totals(boxes.where("id % 2 = 1"), boxes.where("id % 2 = 0"), "l_orderkey", bucket, 0.3)
    return done.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "false_per_frame")})


@query("""WITH p AS (SELECT p_brand AS profile, round(avg(p_size / 50.0), 6) AS recall, round(avg((p_partkey % 7) / 6.0), 6) AS "precision", round(100.0 * count(*) FILTER (WHERE p_size > 40) / count(*), 6) AS false_rate FROM part GROUP BY p_brand)
SELECT profile, recall, "precision", false_rate FROM p WHERE recall >= 0.95 * (SELECT recall FROM p WHERE profile = 'Brand#11') ORDER BY false_rate, "precision" DESC, recall DESC, profile LIMIT 1""")
def detector_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile with fewest false boxes among those near the current one's recall."""
    six = lambda c, n: F.round(c, 6).cast("double").alias(n)
    profiles = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("profile")).agg(six(F.avg(F.col("p_size") / 50), "recall"), six(F.avg(F.col("p_partkey") % 7 / 6), "precision"), six(100 * F.count_if(F.col("p_size") > 40) / F.count("*"), "false_rate"))
    return matching.selected_profile(profiles, "profile", "Brand#11")


@query(f"""WITH {_SQL_BOXES} SELECT l_orderkey, id, greatest(0, x1 - round_even(greatest(x2 - x1, y2 - y1) * 0.08, 0))::DOUBLE AS px1, greatest(0, y1 - round_even(greatest(x2 - x1, y2 - y1) * 0.08, 0))::DOUBLE AS py1,
least(90, x2 + round_even(greatest(x2 - x1, y2 - y1) * 0.08, 0))::DOUBLE AS px2, least(90, y2 + round_even(greatest(x2 - x1, y2 - y1) * 0.08, 0))::DOUBLE AS py2 FROM b""")
def padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.lit(90)
    return _boxes(spark, sf_dir).select("l_orderkey", "id", *[c.cast("double").alias(n) for c, n in zip(G.padded(G.Box(), edge, edge, 0.08, 2), ("px1", "py1", "px2", "py2"), strict=True)])


@query(f"""WITH {_SQL_BOXES} SELECT l_orderkey, id, round((x1 + x2) / 2.0 / 90, 8) AS cx, round((y1 + y2) / 2.0 / 90, 8) AS cy, round((x2 - x1) / 90.0::DOUBLE, 8) AS w, round((y2 - y1) / 90.0::DOUBLE, 8) AS h FROM b""")
def center_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("l_orderkey", "id", *[F.round(c, 8).alias(n) for c, n in zip(G.to_center_format(G.Box(), F.lit(90.0), F.lit(90.0)), ("cx", "cy", "w", "h"), strict=True)])


@query("""WITH q AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN [1.0, 2.0] ELSE [o_orderkey % 50, o_orderkey % 50 + 10 + o_custkey % 20, o_orderkey % 50 + 5] END::DOUBLE[] AS xs,
  CASE WHEN o_orderkey % 17 = 0 THEN [1.0, 2.0] ELSE [o_custkey % 40, o_custkey % 40 + o_orderkey % 7, CASE WHEN o_orderkey % 19 = 0 THEN 'NaN'::DOUBLE ELSE o_custkey % 40 + 12 END] END::DOUBLE[] AS ys, (o_orderkey % 50)::DOUBLE AS x1, (o_custkey % 40)::DOUBLE AS y1, (o_orderkey % 50 + 12 + o_custkey % 20)::DOUBLE AS x2, (o_custkey % 40 + 10 + o_orderkey % 5)::DOUBLE AS y2 FROM orders),
a AS (SELECT *, CASE WHEN len(xs) < 3 THEN 0 ELSE abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[1] - xs[1] * ys[3]) / 2 END AS area, greatest(0, least(list_max(xs), x2) - greatest(list_min(xs), x1)) * greatest(0, least(list_max(ys), y2) - greatest(list_min(ys), y1)) AS inner_area FROM q),
r AS (SELECT o_custkey, o_orderkey, round(CASE WHEN isnan(list_max(ys)) THEN 0 ELSE area END, 6) AS area, CASE WHEN len(xs) < 3 THEN 'fewer than three points' WHEN isnan(list_max(ys)) THEN 'not finite' WHEN list_max(xs) > 75 OR list_max(ys) > 50 THEN 'outside the image' WHEN area / greatest(1, (x2 - x1) * (y2 - y1)) NOT BETWEEN 0.3 AND 0.48 THEN 'area ratio'
  WHEN inner_area / ((list_max(xs) - list_min(xs)) * (list_max(ys) - list_min(ys)) + (x2 - x1) * (y2 - y1) - inner_area) < 0.85 THEN 'box overlap' END AS reason FROM a)
SELECT o_custkey, o_orderkey, area, coalesce(reason, 'ok') AS reason, bool_and(reason IS NULL) OVER (PARTITION BY o_custkey, o_orderkey // 400) AS whole_ok FROM r""")
def polygon_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask polygons with a reason each; a picture (some orders of a customer) is fine only if all of its polygons are."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    few, odd = k % 17 == 0, k % 19 == 0
    double = lambda *v: F.array(*[F.lit(x).cast("double") if not isinstance(x, F.Column) else x.cast("double") for x in v])
    xs = F.when(few, double(1.0, 2.0)).otherwise(double(k % 50, k % 50 + 10 + c % 20, k % 50 + 5))
    ys = F.when(few, double(1.0, 2.0)).otherwise(double(c % 40, c % 40 + k % 7, F.when(odd, float("nan")).otherwise(c % 40 + 12)))
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", xs.alias("xs"), ys.alias("ys"), *[x.cast("double").alias(n) for x, n in ((k % 50, "x1"), (c % 40, "y1"), (k % 50 + 12 + c % 20, "x2"), (c % 40 + 10 + k % 5, "y2"))])
    rows = rows.withColumns({"area": F.round(F.nanvl(G.polygon_area(F.col("xs"), F.col("ys")), F.lit(0.0)), 6), "fault": G.polygon_fault(F.col("xs"), F.col("ys"), G.Box(), F.lit(75), F.lit(50), 0.85, 0.3, 0.48)})
    ok = F.bool_and(F.col("fault").isNull()).over(W.partitionBy("o_custkey", F.floor(k / 400)))
    return rows.select("o_custkey", "o_orderkey", "area", F.coalesce("fault", F.lit("ok")).alias("reason"), ok.alias("whole_ok"))


_SQL_HASH = "h AS (SELECT vec_id, list_sum([CASE WHEN embedding[i + 1] > embedding[i + 2] THEN 1::HUGEINT << i ELSE 0 END FOR i IN range(63)])::BIGINT AS code FROM embeddings)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", difference_hash(F.col("embedding")).alias("code"))


@query(f"WITH {_SQL_HASH} SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.code, b.code))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.code, b.code)) <= 16")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.hamming_pairs(_codes(spark, sf_dir), "vec_id", "code", 16, 63)


@query(f"""WITH RECURSIVE {_SQL_HASH}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.vec_id <> b.vec_id WHERE bit_count(xor(a.code, b.code)) <= 16),
r AS (SELECT vec_id AS node, vec_id AS seen FROM h UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    return duplicates.components(duplicates.hamming_pairs(codes, "vec_id", "code", 16, 63), codes.select(F.col("vec_id").alias("node")))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))
    return matching.nearest(rows, "v", matching.prototypes(rows, "label", "v"), "label")


_SQL_NEAR = """c AS (SELECT label, i, round(avg(v::DOUBLE), 9) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
m AS (SELECT label, list(v ORDER BY i) AS mean FROM c GROUP BY label),
protos AS (SELECT label, list_transform(mean, lambda x: x / sqrt(list_sum(list_transform(mean, lambda y: y * y)))) AS p FROM m),
d AS (SELECT e.vec_id, e.label, protos.label AS other, round(least(2, greatest(0, 1 - list_dot_product(embedding::DOUBLE[], p) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(p, p)))), 6) AS distance FROM embeddings e, protos),
near AS (SELECT vec_id, label, min_by(other, (distance, other)) AS nearest, min(distance) AS distance FROM d GROUP BY vec_id, label)"""


@query("""WITH c AS (SELECT label, i, round(avg(v::DOUBLE), 9) AS v FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY label, i),
l AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY label) SELECT label, i::INT AS i, round(v / n, 5) AS v FROM c JOIN l USING (label)""")
def class_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = matching.prototypes(read(spark, sf_dir, "embeddings"), "label", "embedding")
    return table.select("label", F.posexplode("prototype").alias("i", "v")).withColumn("v", F.round("v", 5))


@query(f"WITH {_SQL_NEAR} SELECT vec_id, nearest, round(distance, 5) AS distance FROM near")
def nearest_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("vec_id", "nearest", F.round(F.round("distance", 6), 5).alias("distance"))


@query(f"""WITH {_SQL_NEAR} SELECT count(*) AS n, count(*) FILTER (WHERE distance <= 0.5) AS accepted, round(avg((distance <= 0.5)::INT), 6) AS coverage,
round(avg((label = nearest)::INT), 6) AS accuracy, round(avg(CASE WHEN distance <= 0.5 THEN (label = nearest)::INT END), 6) AS accepted_accuracy, round(avg((distance <= 0.5 AND label = nearest)::INT), 6) AS accepted_correct FROM near""")
def embedding_gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, correct = F.col("distance") <= 0.5, F.col("label") == F.col("nearest")
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return _nearest(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(accepted).alias("accepted"), rate(accepted).alias("coverage"), rate(correct).alias("accuracy"), F.round(F.avg(F.when(accepted, correct.cast("int"))), 6).alias("accepted_accuracy"), rate(accepted & correct).alias("accepted_correct"))


@query(f"WITH {_SQL_NEAR} SELECT round(least(1.0, greatest(0.01, quantile_cont(distance, 0.97))), 5) AS threshold FROM near WHERE label = nearest")
def gate_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nearest(spark, sf_dir).where("label = nearest").withColumn("distance", F.round("distance", 6))
    found = ranges.percentiles_by(rows, [], "distance", {"p97": 0.97})
    return found.select(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.01), "p97")), 5).alias("threshold"))


@query(f"WITH {_SQL_NEAR} SELECT label AS target, nearest AS predicted, count(*) AS n FROM near GROUP BY ALL")
def confusion_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_nearest(spark, sf_dir).select(F.col("label").alias("target"), F.col("nearest").alias("predicted")))


_SQL_F1 = """s AS (SELECT l.label, count(*) FILTER (WHERE near.label = l.label AND nearest = l.label) AS tp, count(*) FILTER (WHERE near.label <> l.label AND nearest = l.label) AS fp,
count(*) FILTER (WHERE near.label = l.label AND nearest <> l.label) AS fn FROM near, (SELECT DISTINCT label FROM {0}) l GROUP BY l.label)
SELECT count(*) AS n_labels, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM s"""


def _f1(spark: SparkSession, sf_dir: str, every_label: bool) -> DataFrame:
    counts = metrics.confusion(_nearest(spark, sf_dir).select(F.col("label").alias("target"), F.col("nearest").alias("predicted")))
    return metrics.class_scores(counts, every_label).agg(F.count("*").alias("n_labels"), F.round(F.avg("f1"), 6).alias("macro_f1"))


@query(f"WITH {_SQL_NEAR}, {_SQL_F1.replace('{0}', 'near')}")
def macro_f1_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, False)


@query(f"WITH {_SQL_NEAR}, {_SQL_F1.replace('{0}', '(SELECT label FROM near UNION SELECT nearest FROM near)')}")
def macro_f1_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f1(spark, sf_dir, True)


@query(f"""WITH {_SQL_NEAR}, r AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = nearest) AS tp FROM near WHERE label % 2 = 0 GROUP BY label)
SELECT sum(support)::BIGINT AS support, round(avg(tp / support), 6) AS macro_recall, round(sum(tp) / sum(support), 6) AS micro_recall FROM r""")
def critical_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the labels that count as critical (the even ones)."""
    counts = metrics.confusion(_nearest(spark, sf_dir).where("label % 2 = 0").select(F.col("label").alias("target"), F.col("nearest").alias("predicted")))
    return metrics.class_scores(counts).agg(F.sum("support").alias("support"), F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.sum("tp") / F.sum("support"), 6).alias("micro_recall"))


@query(f"""WITH {_SQL_NEAR}, b AS (SELECT ceil((1 - distance / 2) * 15) AS bin, count(*) AS n, avg(1 - distance / 2) AS c, avg((label = nearest)::INT) AS a FROM near WHERE 1 - distance / 2 > 0 GROUP BY 1)
SELECT round(sum(n * abs(c - a)) / (SELECT count(*) FROM near), 6) AS ece FROM b""")
def ece15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nearest(spark, sf_dir).select((1 - F.round("distance", 6) / 2).alias("confidence"), (F.col("label") == F.col("nearest")).alias("correct"))
    return metrics.calibration_error(rows, "confidence", "correct")


@query("""SELECT vec_id, round(list_max(p), 6) AS top, list_position(p, list_max(p))::INT - 1 AS argmax FROM (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p
FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp((x - list_max(embedding::DOUBLE[])) / 0.5)) AS e FROM embeddings))""")
def softmax_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", V.softmax(V.as_double(F.col("embedding")), 0.5).alias("p"))
    return rows.select("vec_id", F.round(F.array_max("p"), 6).alias("top"), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("argmax"))
