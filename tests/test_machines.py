"""State machines: fixed cases, and streams that give their batch's rows."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import machines
from lodestar.plans import SQL as plans_sql
from lodestar.plans import machines as plans
from lodestar.streaming import stateful


def steps(machine, rows):
    return [machine.step(*row) for row in rows]


def player(cases, remember=float("inf")):
    """(at, frame, phrase, track, priority, interrupts), each 2 s long; rests of 8 s from priority 3 on, else 12 s."""
    one = machines.Player(remember)
    return [one.step(at, frame, phrase, track, level, cut, 8.0 if level >= 3 else 12.0, 2.0)[0] for at, frame, phrase, track, level, cut in cases]


def test_player():
    # what is not played leaves no mark: horn plays two seconds, slow is refused at 1 s and may come again in its frame
    assert player([(0.0, 0, "horn", 1, 4, True), (1.0, 0, "slow", 1, 1, False), (5.0, 0, "slow", 1, 1, False)]) == [True, False, True]
    # a higher priority gives way only to phrases that interrupt
    assert player([(0.0, 0, "slow", 1, 1, False), (1.0, 1, "calm", 1, 2, False), (1.5, 2, "stop", 1, 4, True), (1.8, 3, "stop2", 1, 4, True)]) == [True, False, True, False]
    # rests by phrase, once for a frame, phrase and track
    assert player([(0.0, 0, "stop", 1, 4, True), (7.9, 1, "stop", 1, 4, True), (8.0, 0, "stop", 1, 4, True), (8.0, 2, "stop", 1, 4, True)]) == [True, False, False, True]
    assert player([(0.0, 0, "stop", 1, 4, True), (50.0, 0, "stop", 1, 4, True)], 30.0) == [True, False]
    assert player([(0.0, 0, "stop", 1, 4, True), (50.0, 1, "slow", 1, 1, False), (90.0, 0, "stop", 1, 4, True)], 30.0) == [True, True, True]


EVENTS = "stream string, at double, frame long, place int, phrase string, track long, priority int, confidence double, interrupts boolean, cooldown double, seconds double, wanted boolean, safe boolean"


def event(at, frame, place, phrase, priority, confidence=0.5, wanted=True, safe=None):
    return ("a", at, frame, place, phrase, 1, priority, confidence, priority >= 3, 8.0 if priority >= 3 else 12.0, 2.0, wanted, safe)


def test_played(spark):
    rows = [
        event(0.0, 0, 0, "stop", 4), event(0.0, 0, 1, "slow", 1),  # the best of a result is chosen
        event(3.0, 1, 2, "stop", 4), event(3.0, 1, 3, "slow", 1),  # it rests: nothing of the result plays
        event(4.0, 2, 4, "slow", 1, 0.4), event(4.0, 2, 5, "horn", 1, 0.6),  # more confidence
        event(7.0, 3, 6, "low", 2, 0.5), event(7.0, 3, 7, "low2", 2, 0.5),  # equals: the first
        event(10.0, 4, 8, "dumb", 4, wanted=False), event(10.0, 4, 9, "sly", 4, safe=False), event(10.0, 4, 10, "slow", 1, safe=True), event(10.0, 4, 11, "nul", 4, wanted=None),
    ]
    frame = spark.createDataFrame(rows, EVENTS)
    assert sorted(r.place for r in machines.played(frame, "stream").collect()) == [0, 5, 6, 10]
    assert machines.played(frame.limit(0), "stream").isEmpty()


def test_cache_and_its_windows(spark):
    rows = [(0, 0, "t", False, 1.0), (1, 1, "t", True, 2.0), (1, 2, "u", True, 3.0), (2, 3, "t", True, 4.0), (3, 4, None, None, None), (4, 5, "t", False, 5.0), (4, 6, "t", True, 6.0), (4, 7, "t", False, 7.0), (5, 8, "u", None, 8.0)]
    want = [("pending", None), ("computed", 2.0), ("computed", 3.0), ("reused", 2.0), (None, None), ("pending", None), ("computed", 6.0), ("reused", 6.0), ("pending", None)]
    assert steps(machines.Cache(), [(f, t, s, v) for f, _, t, s, v in rows]) == want
    frame = spark.createDataFrame([("s", *r) for r in rows], "session string, frame long, place int, track string, stable boolean, value double")
    got = {r.place: (r.status, r.cached) for r in machines.cached(frame, "session").collect()}
    assert got == {r[1]: w for r, w in zip(rows, want, strict=True) if r[2] is not None}


def test_registry():
    def connect(number, device, session="s"):
        return (number, "connect", session, device, None, None)

    one = machines.Registry()
    assert steps(one, [connect(1, None), connect(2, "")]) == [("admitted", 1, 1), ("admitted", 2, 2)]  # two without a device
    assert steps(one, [connect(3, "x"), connect(4, " x "), connect(5, "x", "other")]) == [("admitted", 3, 3), ("replaced", 3, 3), ("admitted", 4, 4)]
    assert steps(one, [(6, "frame", "s", "x", 3, 3), (7, "frame", "s", "x", 4, 4), (8, "frame", "s", "x", 4, 9), (9, "disconnect", "s", "x", 4, 9), (10, "disconnect", "s", "x", 4, 4), (11, "frame", "s", "x", 4, 4)]) == [("stale", None, 4), ("taken", 3, 4), ("stale", None, 4), ("stale", None, 4), ("left", 3, 3), ("stale", None, 3)]
    filled = steps(one, [connect(20 + i, f"d{i}") for i in range(10)])
    assert filled[8:] == [("admitted", 13, 12), ("refused", None, 12)]
    assert steps(one, [connect(40, "d0"), connect(41, "new")]) == [("replaced", 5, 12), ("refused", None, 12)]


def test_queue_and_votes():
    assert steps(machines.Queue(), [(1,), (2,), (3,), (None,), (None,), (None,), (4,)]) == [(None, None, 1), (None, None, 2), (None, 1, 2), (2, None, 1), (3, None, 0), (None, None, 0), (None, None, 1)]
    votes = steps(machines.Votes(), [("a", 0.75), ("b", 0.5625), ("b", 0.0), ("a", 0.0), ("b", 1.0)])
    assert [v[0] for v in votes] == ["a", "a", "a", "a", "b"]  # of equals the first seen
    assert votes[1][1] == pytest.approx(0.5)
    assert steps(machines.Votes(), [("a", 0.0)]) == [("a", 0.0)]


def events_table(spark, path, rows):
    """A table of events (event_id, minute, user_id, event_type, value) and a connection that sees it."""
    import duckdb

    frame = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    frame.select("event_id", F.timestamp_seconds(F.col("s") * 60).cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value").write.parquet(f"{path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return duck


def test_leading_label_of_nothing_and_of_ties(spark, tmp_path):
    """Scores that sum to 0 give SQL's nan; shares between two roundings (0.5203125) are rounded as SQL does."""
    rows = [(1, 1, 1, "view", 0.0), (2, 2, 1, "click", 0.0), (3, 3, 1, "view", 2.0), (4, 1, 2, "view", 4.44), (5, 2, 2, "click", 3.07), (6, 1, 3, "view", 12.68), (7, 2, 3, "error", 9.69)]
    duck = events_table(spark, tmp_path, rows)
    got = sorted(map(tuple, plans.leading_label(spark, str(tmp_path)).select("event_id", "leader", "share").collect()))
    assert list(map(repr, got)) == list(map(repr, sorted(duck.execute(plans_sql["leading_label"]).fetchall())))
    assert [str(r[2]) for r in got] == ["nan", "nan", "1.0", "1.0", "0.520312", "1.0", "0.504687"]


def test_queue_drops_copies_no_message(spark, tmp_path):
    """Totals are those of the queues, step by step and by SQL, with equal times; and no message is joined to the users of its topic."""
    import random

    dice = random.Random(5)
    rows = [(i, dice.randrange(60), dice.choice([0, 1, 50, 51, 100, 101, 150, 52, 202]), dice.choices(["view", "click", "purchase", "error"], [2, 1, 3, 1])[0], 1.0) for i in range(400)]
    rows += [(1000, 5, 3, "error", 1.0), (1001, 5, 4, "view", 1.0), (1002, 5, 6, "purchase", 1.0), (1003, 5, 7, "purchase", 1.0), (1004, 5, 7, "purchase", 1.0), (1005, 6, 7, "purchase", 1.0), (1006, 6, None, "purchase", 1.0), (1007, 6, None, "view", 1.0)]
    duck = events_table(spark, tmp_path, rows)
    done = plans.queue_drops(spark, str(tmp_path))
    got = {tuple(r) for r in done.collect()}
    assert got == set(duck.execute(plans_sql["queue_drops"]).fetchall()) and len(got) == 12
    events = spark.createDataFrame(rows, "message long, at long, user long, kind string, value double").where("user IS NOT NULL").withColumn("topic", F.col("user") % 50)
    queues = machines.delivered(events.where("kind = 'purchase'"), events.select("topic", "user").distinct(), events.where("kind IN ('view', 'click')"), "topic", "user")
    counts = queues.groupBy("user").agg(*[F.count(c) for c in ("message", "taken", "dropped")], *[F.sum(c) for c in ("taken", "dropped")])
    assert {tuple(r) for r in counts.collect()} == got
    assert "Join" not in done._jdf.queryExecution().optimizedPlan().toString()


def test_queries_show_every_outcome(spark, small):
    found = {r.outcome: r.n for r in plans.registry_admissions(spark, "/root/testdata/sf0.01").groupBy("outcome").agg(F.count("*").alias("n")).collect()}
    assert set(found) == {"admitted", "replaced", "refused", "taken", "left", "stale"}
    row = plans.queue_drops(spark, small).agg(*[F.sum(c).alias(c) for c in ("sent", "taken", "dropped")]).first()
    assert row.sent > row.taken > 0 and row.dropped > 0
    row = plans.track_cache_counts(spark, small).agg(*[F.sum(c).alias(c) for c in ("computed", "reused", "pending")]).first()
    assert min(row) > 0


def stream_of(spark, rows, path, order):
    """A stream of ``rows`` in three files, one a micro-batch, in order."""
    total = rows.count()
    numbered = rows.orderBy(*order).collect()
    for i in range(3):
        part = numbered[i * total // 3 : (i + 1) * total // 3]
        spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(str(path))
        import time

        time.sleep(1.1)  # files are taken by age
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def results(spark, frame, name):
    frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    return spark.table(name)


def timed(rows):
    return rows.withColumn("ts", F.timestamp_seconds("s"))


DAY = 86_400_000


@pytest.mark.parametrize("name", ["play", "cache", "registry", "queue", "votes"])
def test_streams_give_the_batch(spark, small, tmp_path, name):
    events = plans._events(spark, small).where("user_id < 12").withColumn("ts", F.col("ts").cast("timestamp"))
    if name == "play":
        rows = machines.chosen(plans.advisories(events), "user_id").withColumn("ts", F.timestamp_seconds(F.col("at") * 3600)).repartition(1)
        keys, order, kind, columns = ["user_id"], ["at", "frame"], machines.Player, ["event_id", "played"]
    elif name == "cache":
        rows = plans.sightings(events).withColumn("ts", F.timestamp_seconds(F.col("frame") * 86400))
        keys, order, kind, columns = ["user_id"], ["frame", "place"], machines.Cache, ["place", "status", "cached"]
    elif name == "registry":
        rows = timed(plans.connections(events))
        keys, order, kind, columns = ["server"], ["s", "number"], machines.Registry, ["number", "outcome", "label", "n_streams"]
    elif name == "queue":
        rows = events.select((F.col("user_id") % 3).alias("user_id"), "ts", "event_id", F.when(F.col("event_type") != "view", F.col("event_id")).alias("message"))
        keys, order, kind, columns = ["user_id"], ["ts", "event_id"], machines.Queue, ["event_id", "taken", "dropped", "waiting"]
    else:
        rows = events.select("user_id", "ts", "event_id", F.col("event_type").alias("label"), F.col("value").alias("confidence"))
        keys, order, kind, columns = ["user_id"], ["ts", "event_id"], machines.Votes, ["event_id", "leader", "share"]
    batch = sorted(map(tuple, machines.scanned(rows, keys, order, kind).select(*columns).collect()), key=repr)
    live = stateful.scanned(stream_of(spark, rows, tmp_path / "in", order), keys, order, kind, "ts", "60 days", 90 * DAY)
    assert sorted(map(tuple, results(spark, live, f"machine_{name}").select(*columns).collect()), key=repr) == batch
    assert batch


def test_idle_keys_are_forgotten(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10_000, 1), (1, 10_010, 2), (2, 11_000, 3), (2, 12_000, 4), (1, 13_000, 5), (1, 13_060, 6)], "key int, s long, message long").withColumn("ts", F.timestamp_seconds("s"))
    path = tmp_path / "in"
    import time

    for part in (rows.where("message <= 2"), rows.where("message = 3"), rows.where("message = 4"), rows.where("message >= 5")):
        part.coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    got = results(spark, stateful.scanned(live, ["key"], ["s"], machines.Queue, "ts", "1 second", 60_000), "idle").collect()
    assert sorted((r.message, r.waiting) for r in got) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, 1), (6, 2)]


def late_rows(spark, path):
    """Minutes 0 to 9, minute 30 twice (a watermark holds from the batch after the next on) and, too late, minute 2 again."""
    first = [(i % 2, i * 60 + 1, i) for i in range(10)]
    import time

    for part in (first, [(0, 1800, 10), (1, 1830, 11)], [(1, 1840, 14)], [(0, 120, 12), (1, 3600, 13)]):
        spark.createDataFrame(part, "key long, s long, n long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)
    schema = spark.read.parquet(str(path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def seconds(column):
    return F.unix_timestamp(column).alias(column)


def test_windows_sessions_and_dedup_drop_late_rows(spark, tmp_path):
    counts = results(spark, stateful.windowed_counts(late_rows(spark, tmp_path / "a"), "key", "ts", "5 minutes"), "tumbling")
    assert {(r.key, r.window_start, r.n) for r in counts.select("key", seconds("window_start"), "n").collect()} >= {(0, 0, 3), (1, 0, 2), (0, 300, 2), (1, 300, 3), (0, 1800, 1), (1, 1800, 2)}
    sliding = results(spark, stateful.windowed_counts(late_rows(spark, tmp_path / "b"), "key", "ts", "10 minutes", "5 minutes"), "sliding")
    assert {(0, 0, 5), (1, 0, 5), (0, -300, 3)} <= {(r.key, r.window_start, r.n) for r in sliding.select("key", seconds("window_start"), "n").collect()}
    found = results(spark, stateful.sessions(late_rows(spark, tmp_path / "c"), "key", "ts", "3 minutes"), "sessions")
    assert {(0, 1, 5), (1, 61, 5), (0, 1800, 1), (1, 1830, 2)} <= {(r.key, r.session_start, r.n_events) for r in found.select("key", seconds("session_start"), "n_events").collect()}
    ticks = results(spark, stateful.coalesced(late_rows(spark, tmp_path / "d"), "key", "ts", ["s", "n"], "5 minutes"), "ticks")
    got = {(r.tick, r.key, r.n) for r in ticks.select(seconds("tick"), "key", "n").collect()}
    assert {(0, 0, 4), (0, 1, 3), (300, 0, 8), (300, 1, 9)} <= got and not any(n == 12 for _, _, n in got)
    unique = results(spark, stateful.deduplicated(late_rows(spark, tmp_path / "e"), ["key"], "ts", "2 minutes"), "unique")
    assert sorted(r.n for r in unique.collect())[:2] == [0, 1]


def test_latest_of_each_batch(spark, tmp_path):
    stateful.latest_to(late_rows(spark, tmp_path / "in"), ["key"], ["s", "n"], str(tmp_path / "out"), str(tmp_path / "check")).start().awaitTermination(120)
    got = sorted((r.batch, r.key, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 0, 8), (0, 1, 9), (1, 0, 10), (1, 1, 11), (2, 1, 14), (3, 0, 12), (3, 1, 13)]
