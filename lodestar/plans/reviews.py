"""Predicates, gates and reviews over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators import checks
from lodestar.operators.ranges import first_of_scan
from lodestar.plans.registry import query, read


@query("SELECT doc_id, source || '::' || CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'd' || doc_id % 10 END AS g FROM documents")
def effective_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name that is not blank, behind its source."""
    rows = read(spark, sf_dir, "documents")
    first = F.when(F.col("doc_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("d"), (F.col("doc_id") % 10).cast("string")))
    return rows.select("doc_id", checks.effective_group(F.col("source"), first, F.col("lang")).alias("g"))


@query("""SELECT p_partkey, CASE WHEN p_size - 20 < 0 THEN 'negative' WHEN p_size % 7 = 0 THEN 'not positive' WHEN p_size > 45 THEN 'exceeds image' END AS error FROM part""")
def box_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x1 = F.col("p_size") - 20
    x2 = F.when(F.col("p_size") % 7 == 0, x1).otherwise(F.col("p_size"))
    return read(spark, sf_dir, "part").select("p_partkey", checks.box_error(x1, F.lit(0), x2, F.lit(1), F.lit(45), F.lit(1)).alias("error"))


@query("""SELECT p_partkey, CASE WHEN least(p_size, 30) >= 24 AND p_partkey % 40 >= 4 THEN 'ok' WHEN least(p_size, 30) >= 16 AND p_partkey % 40 >= 20 THEN 'weak' END AS note FROM part""")
def image_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", checks.image_note(F.col("p_size"), F.lit(30), F.col("p_partkey") % 40).alias("note"))


@query("""WITH m AS (SELECT (p_partkey % 100 / 100.0)::DOUBLE AS c, p_size % 12 AS v, (p_partkey % 20 / 10.0)::DOUBLE AS a, (p_size / 2000.0)::DOUBLE AS area FROM part),
s AS (SELECT *, CASE WHEN c >= 0.76 AND a >= 0.72 AND a <= 1.38 THEN 'circle' WHEN v = 3 THEN 'triangle' WHEN v = 4 THEN 'square_or_rectangle' WHEN v >= 7 AND v <= 10 THEN 'octagon' ELSE 'other' END AS shape FROM m)
SELECT shape, count(*) AS n, round(avg(greatest(0, least(1, 0.26 * c + 0.20 * a / 2 + 0.18 * c + 0.12 * greatest(0, 1 - abs(ln(greatest(a, 0.000001))) / 2) + 0.09 * least(1, area / 0.02)
+ CASE shape WHEN 'circle' THEN 0.15 WHEN 'triangle' THEN 0.15 WHEN 'square_or_rectangle' THEN 0.10 WHEN 'octagon' THEN 0.18 ELSE 0 END))), 6) AS mean_score FROM s GROUP BY shape""")
def shape_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v, a, area = F.col("p_partkey") % 100 / 100.0, F.col("p_size") % 12, F.col("p_partkey") % 20 / 10.0, F.col("p_size") / 2000.0
    rows = read(spark, sf_dir, "part").select(checks.shape_of(v, c, a).alias("shape"), area.alias("area"), c.alias("c"), a.alias("a"))
    score = checks.candidate_score(F.col("area"), F.col("a") / 2, F.col("c"), F.col("c"), F.col("a"), F.col("shape"))
    return rows.groupBy("shape").agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"))


@query("""SELECT p_partkey FROM (SELECT p_partkey, (p_size / 2000.0)::DOUBLE AS area, 8 + p_partkey % 60 AS w, 8 + p_size AS h, (p_partkey % 10 / 10.0)::DOUBLE AS e, (p_partkey % 7 / 6.0)::DOUBLE AS s FROM part)
WHERE area >= 0.002 AND area <= 0.02 AND w >= 12 AND h >= 14 AND e >= 0.2 AND s >= 0.5 AND w / h::DOUBLE <= 2.5 AND w / h::DOUBLE >= 0.4""")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"min_area_ratio": 0.002, "max_area_ratio": 0.02, "min_width": 12, "min_height": 14, "min_extent": 0.2, "min_solidity": 0.5, "max_aspect_ratio": 2.5}
    size, key = F.col("p_size"), F.col("p_partkey")
    return read(spark, sf_dir, "part").where(checks.plausible_candidate(size / 2000.0, 8 + key % 60, 8 + size, key % 10 / 10.0, key % 7 / 6.0, limits)).select("p_partkey")


@query("""SELECT rule, event_id FROM (SELECT rule, event_id, most, row_number() OVER (PARTITION BY rule ORDER BY ts, event_id) AS rn FROM events JOIN (VALUES ('click', 'big clicks', 30.0, 15), ('error', 'errors', 5.0, 40)) r(event_type, rule, least, most) USING (event_type) WHERE value >= least) WHERE rn <= most""")
def rule_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("click", "big clicks", 30.0, 15), ("error", "errors", 5.0, 40)], "event_type string, rule string, least double, most int")
    rows = read(spark, sf_dir, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    return checks.mined(rows, rules, ["event_type"], "us", ["event_id"]).select("rule", "event_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_quantity ORDER BY l_orderkey, l_linenumber) AS copy FROM lineitem WHERE l_quantity >= 26),
k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS place FROM r WHERE copy = 1)
SELECT l_returnflag, l_orderkey, l_linenumber, place FROM k WHERE place <= CASE l_returnflag WHEN 'A' THEN 40 WHEN 'N' THEN 75 ELSE 25 END""")
def scan_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class's quota in scan order: rows of a least size, the first of those with one hash, each with its number."""
    lines = read(spark, sf_dir, "lineitem").where("l_quantity >= 26").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = F.struct("l_orderkey", "l_linenumber")
    firsts = lines.groupBy("l_partkey", "l_suppkey", "l_quantity").agg(F.min_by(F.struct("l_returnflag", "l_orderkey", "l_linenumber"), order).alias("r")).select("r.*")
    kept = first_of_scan(firsts, ["l_returnflag"], "l_orderkey", ["l_linenumber"], F.when(F.col("l_returnflag") == "A", 40).when(F.col("l_returnflag") == "N", 75).otherwise(25))
    # a class's rows are now as many as its quota
    return kept.withColumn("place", F.row_number().over(W.partitionBy("l_returnflag").orderBy("l_orderkey", "l_linenumber")))


@query("SELECT lower(trim(p_brand)) AS p_brand, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1")
def grouped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.lower(F.trim("p_brand")).alias("p_brand")
    return read(spark, sf_dir, "part").groupBy(brand).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'approved' WHEN n_nationkey % 5 = 1 THEN 'rejected' ELSE 'draft' END AS status FROM nation")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = read(spark, sf_dir, "nation").select("n_nationkey", F.lit("draft").alias("status"))
    told = catalogue.where("n_nationkey % 5 < 2").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, "approved").otherwise("rejected").alias("decision"))
    return checks.reviewed(catalogue, told, "n_nationkey", ["approved", "rejected"])


@query("""SELECT l_orderkey, bool_or(abs(l_quantity::DOUBLE - (l_orderkey % 50)) <= 1) AS hit FROM lineitem GROUP BY l_orderkey""")
def tolerance_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("v"))
    return rows.select("l_orderkey", checks.near_value(F.col("l_orderkey") % 50, F.col("v")).alias("hit"))


@query("""SELECT event_type, CASE WHEN share >= 0.5 THEN 'pass' WHEN share >= 0.2 THEN 'partial' ELSE 'fail' END AS status FROM (SELECT event_type, avg((value >= 10)::INT) AS share FROM events GROUP BY event_type)""")
def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy("event_type").agg(F.avg((F.col("value") >= 10).cast("int")).alias("share"))
    return rows.select("event_type", checks.gate(F.col("share"), 0.5, 0.2).alias("status"))


@query("""SELECT o_custkey, greatest(abs(n_f - n_o), abs(low - high)) AS diff FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o, count(*) FILTER (WHERE o_totalprice < 50000) AS low, count(*) FILTER (WHERE o_totalprice >= 50000) AS high FROM orders GROUP BY o_custkey)""")
def map_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.count_if(c)
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.create_map(F.lit("status"), n(F.col("o_orderstatus") == "F"), F.lit("price"), n(F.col("o_totalprice") < 50000), F.lit("left"), F.lit(0).cast("long")).alias("a"),
        F.create_map(F.lit("status"), n(F.col("o_orderstatus") == "O"), F.lit("price"), n(F.col("o_totalprice") >= 50000), F.lit("right"), F.lit(0).cast("long")).alias("b"),
    )
    return rows.select("o_custkey", checks.map_difference(F.col("a"), F.col("b")).alias("diff"))


_CONTROL = """SELECT event_id, {0} AS public, round(CASE WHEN ms > 220 OR drops > 6 THEN greatest({1}, 0.6 - 0.08) WHEN ms > 120 OR drops > 2 THEN greatest({1}, 0.6 - 0.04) WHEN ms < 70 AND drops = 0 THEN least({2}, 0.6 + 0.015) ELSE 0.6 END::DOUBLE, 6) AS quality,
round(CASE WHEN ms > {3} OR drops > {5} THEN 1000 / 30.0 WHEN ms < {4} AND drops <= 2 THEN 1000 / 60.0 ELSE 25.0 END::DOUBLE, 6) AS "interval" FROM (SELECT event_id, value * 6 AS ms, event_id % 10 AS drops FROM events)"""


@query(_CONTROL.format("false", 0.38, 0.78, 180, 80, 4) + " UNION ALL " + _CONTROL.format("true", 0.32, 0.72, 280, 160, 8))
def control_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive control law on latencies and drops from the events, for a local and a public link."""
    rows, out = read(spark, sf_dir, "events").select("event_id", (F.col("value") * 6).alias("ms"), (F.col("event_id") % 10).alias("drops")), []
    for public in (False, True):
        quality, interval = checks.next_control(F.lit(0.6), F.lit(25.0), F.col("ms"), F.col("drops"), public)
        out.append(rows.select("event_id", F.lit(public).alias("public"), F.round(quality, 6).alias("quality"), F.round(interval, 6).alias("interval")))
    return out[0].unionByName(out[1])


@query("SELECT conv_id, count(*) AS n, list(role ORDER BY turn, role)[2] AS second FROM conversations GROUP BY conv_id")
def zipped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and roles side by side, as arrays of one size."""
    ordered = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    arrays = ordered.select("conv_id", F.transform("t", lambda x: x["turn"]).alias("turns"), F.transform("t", lambda x: x["role"]).alias("roles"))
    rows = arrays.select("conv_id", checks.zipped("turns", "roles").alias("z"))
    return rows.select("conv_id", F.size("z").cast("long").alias("n"), F.get("z", 1)["roles"].alias("second"))
