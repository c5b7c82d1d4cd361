"""Queries over the star schema: joins, rollups, ranking, sets, as-of and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.plans.registry import query, read


def _money(c: Column | str) -> Column:
    return F.round(F.sum(F.col(c) if isinstance(c, str) else c), 2)


_SQL_NET = "l_extendedprice * (1 - l_discount)"


def _net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query(f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_SQL_NET}), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_shipdate <= DATE '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(_money("l_quantity").alias("sum_qty"), _money(_net()).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query(f"""SELECT l_orderkey, round(sum({_SQL_NET}), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyers = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    rows = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey", "o_orderdate").agg(_money(_net()).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query(f"""SELECT n_name, round(sum({_SQL_NET}), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    sellers = read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return read(spark, sf_dir, "lineitem").join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(_money(_net()).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def forecast_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    return rows.agg(_money(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INT AS g1, grouping(l_linestatus)::INT AS g2 FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def flag_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus")
    return rows.agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def order_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    return rows.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT c_nationkey, c_custkey, rank() OVER w::INT AS rnk, dense_rank() OVER w::INT AS dense, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)::INT AS quarter,
round(percent_rank() OVER w, 6) AS pct, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS following FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)""".replace("OVER w::INT", "OVER w"))
def customer_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("c_nationkey")
    w, total = by.orderBy("c_acctbal"), by.orderBy("c_acctbal", "c_custkey")
    return read(spark, sf_dir, "customer").select(
        "c_nationkey", "c_custkey", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(total).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.lead("c_custkey").over(total).alias("following")
    )


@query("SELECT s_nationkey AS nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def nation_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey")).intersect(read(spark, sf_dir, "customer").select("c_nationkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey").subtract(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY o_orderpriority")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count("o_orderkey"))
    return rows.na.fill(0)


@query("""SELECT e.event_id, p.event_id AS purchase_id FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def last_purchase_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join: one window over the union of both sides."""
    rows = read(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')")
    order = W.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(W.unboundedPreceding, 0)
    known = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(order)
    return rows.withColumn("purchase_id", known).where("event_type = 'click'").select("event_id", "purchase_id")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), _money("value").alias("total"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("SELECT count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("SELECT user_id, round(avg(regexp_extract(props, '\"k\": ([0-9]+)', 1)::INT), 6) AS mean_k FROM events GROUP BY user_id")
def props_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(F.get_json_object("props", "$.k").cast("int")), 6).alias("mean_k"))


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('weights:' || vec_id), vec_id) AS rn FROM embeddings) WHERE rn <= 5")
def balanced_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.concat(F.lit("weights:"), F.col("vec_id").cast("string")), 256)
    rows = read(spark, sf_dir, "embeddings").withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy(digest, "vec_id")))
    return rows.where("rn <= 5").select("label", "vec_id")


@query("SELECT label, 1.0 / count(*) AS weight FROM embeddings GROUP BY label")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").groupBy("label").agg((F.lit(1.0) / F.count("*")).alias("weight"))
