"""State machines over the events; their SQL steps through each key's rows by recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.operators import machines
from lodestar.plans.registry import query, read

_LEVEL = "CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", seconds.alias("s"))


def advisories(events: DataFrame) -> DataFrame:
    """Events as advisory events: a result every six hours, a frame a day; phrases rest and interrupt by priority (fixed values, in hours)."""
    kind = F.col("event_type")
    level = F.when(kind == "error", 4).when(kind == "purchase", 3).when(kind == "signup", 2).otherwise(1)
    at = (F.floor(F.col("s") / 21600) * 6).cast("double")
    rows = events.select("user_id", "event_id", at.alias("at"), F.floor(F.col("s") / 86400).alias("frame"), F.col("event_id").alias("place"), kind.alias("phrase"), (F.col("event_id") % 3).alias("track"), level.alias("priority"), F.col("value").alias("confidence"))
    return rows.withColumns({"interrupts": F.col("priority") >= 3, "cooldown": F.when(F.col("priority") >= 3, 8.0).otherwise(12.0), "seconds": F.lit(20.0), "wanted": F.col("confidence") >= 5, "safe": F.when(F.col("event_id") % 5 == 0, False)})


@query(f"""WITH RECURSIVE a AS (SELECT user_id, event_id, floor(epoch(ts) / 21600)::BIGINT * 6 AS tm, floor(epoch(ts) / 86400)::BIGINT AS frame, event_type AS phrase, event_id % 3 AS track, {_LEVEL} AS level, value FROM events WHERE value >= 5 AND event_id % 5 <> 0),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, frame) AS i FROM (SELECT *, row_number() OVER (PARTITION BY user_id, tm, frame ORDER BY level DESC, value DESC, event_id) AS rn FROM a) WHERE rn = 1),
r AS (SELECT user_id, event_id, phrase, i, true AS fire, tm + 20 AS until, level, [{{'phrase': phrase, 'tm': tm, 'mark': frame || ' ' || phrase || ' ' || track}}] AS plays FROM c WHERE i = 1
UNION ALL SELECT user_id, event_id, phrase, i, fire, CASE WHEN fire THEN tm + 20 ELSE until END, CASE WHEN fire THEN new_level ELSE level END, CASE WHEN fire THEN list_append(plays, {{'phrase': phrase, 'tm': tm, 'mark': mark}}) ELSE plays END
FROM (SELECT c.user_id, c.event_id, c.phrase, c.i, c.tm, r.until, r.level, c.level AS new_level, r.plays, c.frame || ' ' || c.phrase || ' ' || c.track AS mark,
  NOT list_contains([p.mark FOR p IN r.plays], c.frame || ' ' || c.phrase || ' ' || c.track)
  AND coalesce(c.tm - list_max([p.tm FOR p IN r.plays IF p.phrase = c.phrase]) >= CASE WHEN c.level >= 3 THEN 8 ELSE 12 END, true) AND (c.tm >= r.until OR (c.level >= 3 AND c.level > r.level)) AS fire
  FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1))
SELECT user_id, event_id, phrase FROM r WHERE fire""")
def phrase_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Played phrases of each user's stream."""
    return machines.played(advisories(_events(spark, sf_dir)), "user_id").select("user_id", "event_id", "phrase")


def sightings(events: DataFrame) -> DataFrame:
    """Events as sightings of tracks: a frame a day, a track an event type, stable from a value of 30 on."""
    return events.select(F.col("user_id"), F.floor(F.col("s") / 86400).alias("frame"), F.col("event_id").alias("place"), F.col("event_type").alias("track"), (F.col("value") >= 30).alias("stable"), "value")


@query("""WITH f AS (SELECT user_id, event_id, event_type, value, value >= 30 AS stable, floor(epoch(ts) / 86400)::BIGINT AS frame, dense_rank() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts) / 86400)) AS n FROM events),
t AS (SELECT *, n - dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS island FROM f),
k AS (SELECT *, count(*) FILTER (WHERE stable) OVER w AS upto, first_value(CASE WHEN stable THEN value END IGNORE NULLS) OVER w AS held FROM t WINDOW w AS (PARTITION BY user_id, event_type, island ORDER BY frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN upto = 0 THEN 'pending' WHEN upto = 1 AND stable THEN 'computed' ELSE 'reused' END AS status, held AS cached FROM k""")
def track_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache a track works out once and reuses while the track stays in view."""
    return machines.cached(sightings(_events(spark, sf_dir)), "user_id").select(F.col("place").alias("event_id"), "status", "cached")


@query("""WITH f AS (SELECT user_id, event_id, event_type, value, value >= 30 AS stable, floor(epoch(ts) / 86400)::BIGINT AS frame, dense_rank() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts) / 86400)) AS n FROM events),
t AS (SELECT *, n - dense_rank() OVER (PARTITION BY user_id, event_type ORDER BY frame) AS island FROM f),
k AS (SELECT *, count(*) FILTER (WHERE stable) OVER (PARTITION BY user_id, event_type, island ORDER BY frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM t)
SELECT user_id, count(*) FILTER (WHERE upto = 1 AND stable) AS computed, count(*) FILTER (WHERE upto > 1 OR (upto = 1 AND NOT stable)) AS reused, count(*) FILTER (WHERE upto = 0) AS pending FROM k GROUP BY user_id""")
def track_cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = machines.cached(sightings(_events(spark, sf_dir)), "user_id")
    return rows.groupBy("user_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("computed", "reused", "pending")])


def connections(events: DataFrame) -> DataFrame:
    """Events as messages to ten servers. Views connect, purchases leave, others are frames; a device is one of three of its user or none; frames and leaves name the last connection of their device, every seventh an older one."""
    kind = F.when(F.col("event_type") == "view", "connect").when(F.col("event_type") == "purchase", "disconnect").otherwise("frame")
    device = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit(" d"), F.col("event_id") % 4))
    rows = events.select((F.col("user_id") % 10).alias("server"), "s", F.col("event_id").alias("number"), kind.alias("kind"), F.col("user_id").cast("string").alias("session"), device.alias("device"))
    before = W.partitionBy("server", "session", "device").orderBy("s", "number").rowsBetween(W.unboundedPreceding, -1)
    made = F.when(F.col("kind") == "connect", F.col("number"))
    named = F.when(F.col("number") % 7 == 0, F.first(made, ignorenulls=True).over(before)).otherwise(F.last(made, ignorenulls=True).over(before))
    return rows.withColumn("stream", F.when(F.col("kind") != "connect", named)).withColumn("token", F.when(F.col("number") % 11 == 0, -1).otherwise(F.col("stream")).cast("bigint"))


@query("""WITH RECURSIVE m AS (SELECT user_id % 10 AS server, floor(epoch(ts))::BIGINT AS s, event_id AS number, CASE event_type WHEN 'view' THEN 'connect' WHEN 'purchase' THEN 'disconnect' ELSE 'frame' END AS kind, user_id::VARCHAR AS session, CASE WHEN event_id % 4 > 0 THEN 'd' || event_id % 4 END AS device FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY s, number) AS i, CASE WHEN kind <> 'connect' THEN CASE WHEN number % 7 = 0 THEN first_value(CASE WHEN kind = 'connect' THEN number END IGNORE NULLS) OVER w ELSE last_value(CASE WHEN kind = 'connect' THEN number END IGNORE NULLS) OVER w END END AS stream
  FROM m WINDOW w AS (PARTITION BY server, session, device ORDER BY s, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, CASE WHEN number % 11 = 0 THEN -1 ELSE stream END AS token FROM n),
r AS (SELECT server, 0::BIGINT AS i, 0::BIGINT AS number, '' AS outcome, NULL::BIGINT AS label, 1::BIGINT AS next_label, []::STRUCT(stream BIGINT, session VARCHAR, device VARCHAR, label BIGINT)[] AS streams FROM (SELECT DISTINCT server FROM e)
UNION ALL SELECT server, i, number, outcome, coalesce(old_label, CASE WHEN outcome = 'admitted' THEN next_label WHEN outcome IN ('taken', 'left') THEN own_label END), next_label + (outcome = 'admitted')::BIGINT,
  CASE WHEN outcome IN ('admitted', 'replaced') THEN list_append(rest, {'stream': number, 'session': session, 'device': device, 'label': coalesce(old_label, next_label)}) WHEN outcome = 'left' THEN [x FOR x IN rest IF x.stream <> stream] ELSE rest END
FROM (SELECT *, CASE WHEN kind = 'connect' THEN CASE WHEN len(rest) >= 12 THEN 'refused' WHEN old_label IS NULL THEN 'admitted' ELSE 'replaced' END WHEN own_label IS NULL THEN 'stale' WHEN kind = 'disconnect' THEN 'left' ELSE 'taken' END AS outcome
  FROM (SELECT e.*, r.next_label, CASE WHEN kind = 'connect' AND e.device IS NOT NULL THEN list_max([x.label FOR x IN r.streams IF x.session = e.session AND x.device IS NOT DISTINCT FROM e.device]) END AS old_label,
    CASE WHEN kind <> 'connect' AND e.token = e.stream THEN list_max([x.label FOR x IN r.streams IF x.stream = e.stream]) END AS own_label,
    CASE WHEN kind = 'connect' AND e.device IS NOT NULL THEN [x FOR x IN r.streams IF NOT (x.session = e.session AND x.device IS NOT DISTINCT FROM e.device)] ELSE r.streams END AS rest
    FROM r JOIN e ON e.server = r.server AND e.i = r.i + 1)))
SELECT number, outcome, label, len(streams)::BIGINT AS n_streams FROM r WHERE i > 0""")
def registry_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a registry of at most twelve streams answers to each message."""
    return machines.scanned(connections(_events(spark, sf_dir)), ["server"], ["s", "number"], machines.Registry).select("number", "outcome", "label", "n_streams")


@query("""WITH RECURSIVE m AS (SELECT p.user_id % 50 AS topic, epoch_us(ts) AS tm, event_id AS message FROM events p WHERE event_type = 'purchase'),
u AS (SELECT DISTINCT user_id % 50 AS topic, user_id FROM events),
q AS (SELECT user_id, tm, 0 AS turn, message FROM m JOIN u USING (topic) UNION ALL SELECT user_id, epoch_us(ts), 1, NULL FROM events WHERE event_type IN ('view', 'click')),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm, turn, message) AS i FROM q),
r AS (SELECT user_id, 0::BIGINT AS i, false AS sent, NULL::BIGINT AS taken, NULL::BIGINT AS dropped, []::BIGINT[] AS waiting FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.i, message IS NOT NULL, CASE WHEN message IS NULL THEN waiting[1] END, CASE WHEN message IS NOT NULL AND len(waiting) >= 2 THEN waiting[1] END,
  CASE WHEN message IS NULL THEN waiting[2:] WHEN len(waiting) >= 2 THEN list_append(waiting[2:], message) ELSE list_append(waiting, message) END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, count(*) FILTER (WHERE sent) AS sent, count(taken) AS taken, count(dropped) AS dropped, sum(taken)::BIGINT AS taken_sum, sum(dropped)::BIGINT AS dropped_sum FROM r WHERE i > 0 GROUP BY user_id""")
def queue_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a topic to the queues of its users: how many each took, and how many were dropped as the oldest of a full queue."""
    rows = read(spark, sf_dir, "events").where("user_id IS NOT NULL").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), (F.col("user_id") % 50).alias("topic"))
    sent = rows.where("event_type = 'purchase'").select("topic", "at", F.col("event_id").alias("message"))
    return machines.delivery_totals(sent, rows.select("topic", "user_id"), rows.where("event_type IN ('view', 'click')").select("topic", "user_id", "at"), "topic", "user_id")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS tick, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 6 HOURS, ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def tick_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last update of each user in each tick of six hours."""
    rows = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return machines.coalesced(rows, "user_id", "ts", ["ts", "event_id"], "6 hours").select("tick", "user_id", "event_id", "value")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS label, value AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, []::STRUCT(label VARCHAR, score DOUBLE)[] AS scores FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT e.user_id, e.i, e.event_id, CASE WHEN list_contains([x.label FOR x IN r.scores], e.label) THEN [{'label': x.label, 'score': x.score * 0.75 + CASE WHEN x.label = e.label THEN e.confidence ELSE 0 END} FOR x IN r.scores]
  ELSE list_append([{'label': x.label, 'score': x.score * 0.75} FOR x IN r.scores], {'label': e.label, 'score': e.confidence}) END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
s AS (SELECT event_id, [x.score FOR x IN scores] AS v, scores FROM r WHERE i > 0)
SELECT event_id, scores[list_position(v, list_max(v))].label AS leader, round(list_max(v) / list_sum(v), 6) AS share FROM s""")
def leading_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading label of each user after each event, and its share."""
    done = machines.fused(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("event_type"), F.col("value"), quotient=True)
    # SQL rounds the product as a float; Spark's round at six digits goes by the decimal form
    return done.select("event_id", "leader", (F.round(F.col("share") * 1e6) / 1e6).alias("share"))
