"""Batch twins of the stateful operators, over the events in (ts, event_id) order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators import metrics, ranges, tracking
from lodestar.plans.registry import query, read


def _seconds() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", _seconds().alias("at"))


@query("""WITH r AS (SELECT event_id, user_id, ts, count(*) OVER w AS n, epoch_us(ts) - min(epoch_us(ts)) OVER w AS span FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW))
SELECT event_id, round(CASE WHEN n <= 1 THEN n::DOUBLE ELSE (n - 1) / greatest(0.001, span / 1e6) END, 9) AS rate FROM r""")
def fps_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.trailing_rate(_events(spark, sf_dir), "user_id", F.col("at"), 6 * 3600).select("event_id", F.round("rate", 9).alias("rate"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 40")
def last40(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.operators.selection import top_k

    return top_k(_events(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 40).select("user_id", "event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) WHERE i < 300 AND i % 3 = 0")
def every_third(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third of the first 300 frames of a key, which is the feature."""
    rows = _events(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return rows.where("i < 300 AND i % 3 = 0").select("event_id")


@query("""WITH r AS (SELECT user_id, event_type, value, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events)
SELECT user_id, event_type, round(sum(value * pow(0.75, later)), 6) AS score FROM r GROUP BY ALL""")
def decayed_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = tracking.decayed_votes(_events(spark, sf_dir), "user_id", "event_type", F.col("value"), ["ts", "event_id"])
    return votes.withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_type, event_id, us, i, us AS last, true AS fire FROM e WHERE i = 1 UNION ALL
SELECT e.user_id, e.event_type, e.event_id, e.us, e.i, CASE WHEN e.us - r.last >= 86400000000 THEN e.us ELSE r.last END, e.us - r.last >= 86400000000 FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.i = r.i + 1)
SELECT event_id FROM r WHERE fire""")
def cooldown_announce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return tracking.cooled_down(rows, ["user_id", "event_type"], "us", "event_id", 86_400_000_000).select("event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.latest(_events(spark, sf_dir), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def carry_forward_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.carried_forward(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "carried").select("event_id", "carried")


@query("""WITH l AS (SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, event_type, n, dense_rank() OVER (PARTITION BY user_id ORDER BY first_seen, event_type)::INT AS label FROM l""")
def registry_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"), F.count("*").alias("n"))
    return rows.select("user_id", "event_type", "n", F.dense_rank().over(W.partitionBy("user_id").orderBy("first_seen", "event_type")).alias("label"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM s GROUP BY user_id, sid""")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "1 hour").alias("s")).agg(F.count("*").alias("n_events"))
    return rows.select("user_id", F.col("s.start").alias("session_start"), "n_events")


@query("SELECT user_id, count(*) FILTER (WHERE event_type <> before) AS switches FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def adjacent_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("before", F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.groupBy("user_id").agg(F.count_if(F.col("event_type") != F.col("before")).alias("switches"))


@query()
def iou_tracker_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from the order lines of a customer; an order is a frame."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    x, y = F.col("l_partkey") * 37 % 60, F.col("l_suppkey") * 13 % 60
    boxes = lines.select(F.col("o_custkey").alias("session"), F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("id"), x.alias("x1"), y.alias("y1"), (x + 30).alias("x2"), (y + 30).alias("y2"))
    return tracking.tracked(boxes, "session", "frame")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS most, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    sums = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    ranks = ranges.percentiles_by(events, ["event_type"], "value", {"median": 0.5, "p95": 0.95})
    return sums.join(ranks, "event_type").select("event_type", "mean", F.round("median", 6).alias("median"), "most", F.round("p95", 6).alias("p95"))


@query("SELECT value AS p95 FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = round_even(0.95 * (n - 1), 0)::BIGINT")
def rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.rank_percentile_by(read(spark, sf_dir, "events"), [], "value", 0.95, "p95")


@query("""SELECT round(max(abs(l_discount - round(l_discount, 1)))::DOUBLE, 9) AS max_diff, round(avg(abs(l_discount - round(l_discount, 1)))::DOUBLE, 9) AS mean_diff, avg((l_discount = round(l_discount, 1))::INT) AS agreement FROM lineitem""")
def parity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("double").alias("a"), F.round(F.col("l_discount"), 1).cast("double").alias("b"))
    return rows.agg(*metrics.largest_difference(rows, "a", "b")).withColumn("max_diff", F.round("max_diff", 9))


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS fp FROM events GROUP BY user_id)
SELECT count(*) AS n_users, sum(fp)::BIGINT AS n_errors, round(100.0 * sum(fp) / sum(n), 6) AS per_hundred, round(avg((fp > 0)::INT), 6) AS any_rate, max(fp) AS most FROM u""")
def negative_fp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("fp"))
    return users.agg(F.count("*").alias("n_users"), F.sum("fp").alias("n_errors"), F.round(100 * F.sum("fp") / F.sum("n"), 6).alias("per_hundred"), F.round(F.avg((F.col("fp") > 0).cast("int")), 6).alias("any_rate"), F.max("fp").alias("most"))


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS fp, sum(value) AS gain FROM events GROUP BY user_id)
SELECT user_id, n, fp FROM u WHERE n >= 0.6 * (SELECT max(n) FROM u) ORDER BY fp, n DESC, user_id LIMIT 1""")
def profile_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile with fewest errors among those that reach a share of the largest."""
    users = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("fp"))
    most = users.agg(F.max("n").alias("n")).first()["n"] or 0
    return users.where(F.col("n") >= 0.6 * most).orderBy("fp", F.desc("n"), "user_id").limit(1)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 20")
def worst_twenty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").orderBy(F.desc("value"), "event_id").limit(20).select("user_id", "event_id", "value")
