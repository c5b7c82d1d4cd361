"""Operators on small tables with known results."""

import difflib
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import geometry, hashing, text
from lodestar.operators import decisions, duplicates, matching, merges, metrics, ranges, rules, selection, splits, tracking
from lodestar.plans import language


def test_stable_fraction_is_the_digest(spark):
    rows = spark.range(50).select("id", hashing.stable_fraction(F.col("id"), 42).alias("f")).collect()
    for r in rows:
        assert r["f"] == int.from_bytes(hashlib.sha256(f"42:{r['id']}".encode()).digest()[:8], "big") / 2**64


def test_bands_find_all_close_codes(spark):
    random.seed(5)
    base = [random.getrandbits(63) for _ in range(6)]
    codes = [(i, b ^ sum(1 << random.randrange(63) for _ in range(random.randrange(4)))) for i, b in enumerate(base * 8)]
    found = {(r["a"], r["b"]) for r in duplicates.hamming_pairs(spark.createDataFrame(codes, "id long, code long"), "id", "code", 5, 63).collect()}
    assert found == {(a, b) for (a, x), (b, y) in itertools.combinations(codes, 2) if bin(x ^ y).count("1") <= 5}


def test_components_follow_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 40, 50, 60]], "node long")
    found = {r["node"]: r["component"] for r in duplicates.components(edges, nodes).collect()}
    assert found == {**{i: 0 for i in range(31)}, 40: 40, 50: 40, 60: 60}


def test_assignment_costs_least():
    random.seed(2)
    for n, m in [(1, 1), (2, 3), (4, 4), (5, 3), (3, 6)]:
        cost = np.array([[random.random() for _ in range(m)] for _ in range(n)])
        pairs = matching.assignment(cost)
        small, large = min(n, m), max(n, m)
        table = cost if n <= m else cost.T
        best = min(sum(table[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(pairs) == small and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9
    assert matching.assignment(np.zeros((0, 3))) == []


def test_greedy_prefers_larger_ids_among_ties(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.5), (1, 2, 1, 0.4), (1, 2, 2, 0.2)], "frame int, l_id int, r_id int, iou double")
    assert sorted(tuple(r) for r in matching.greedy_one_to_one(pairs, "frame", 0.3).collect()) == [(1, 1, 2, 0.5), (1, 2, 1, 0.4)]


def test_suppression_keeps_boxes_under_the_limit(spark):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0.9), (1, 2, 1, 0, 11, 10, 0.8), (1, 3, 30, 30, 40, 40, 0.1), (2, 1, 0, 0, 10, 10, 0.5)], "frame int, id int, x1 int, y1 int, x2 int, y2 int, score double")
    assert sorted((r["frame"], r["id"]) for r in matching.suppressed(boxes, "frame").collect()) == [(1, 1), (1, 3), (2, 1)]


def test_boxes_and_polygons(spark):
    row = spark.range(1).select(F.lit(0.0).alias("l_x1"), F.lit(0.0).alias("l_y1"), F.lit(10.0).alias("l_x2"), F.lit(10.0).alias("l_y2"), F.lit(5.0).alias("r_x1"), F.lit(0.0).alias("r_y1"), F.lit(15.0).alias("r_x2"), F.lit(10.0).alias("r_y2"))
    a, b = geometry.Box("l_"), geometry.Box("r_")
    area = geometry.polygon_area(F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0))))
    got = row.select(geometry.iou(a, b).alias("i"), area.alias("p"), geometry.polygon_area(F.array(F.lit(1.0)), F.array(F.lit(1.0))).alias("none")).first()
    assert abs(got["i"] - 1 / 3) < 1e-12 and got["p"] == 12.0 and got["none"] == 0.0


def test_even_spread_matches_its_definition(spark):
    for n in (1, 4, 9, 23):
        rows = spark.range(n).withColumn("g", F.lit(1))
        for k in (1, 3, 5):
            got = sorted(r["id"] for r in selection.even_spread(rows, "g", [F.col("id")], k).collect())
            want = sorted({round(i * (n - 1) / (k - 1)) for i in range(k)}) if k > 1 and n > k else list(range(min(n, k) if k == 1 else n))
            assert got == want
            spread = sorted(r["id"] for r in selection.floor_spread(rows, "g", [F.col("id")], k).collect())
            assert spread == (sorted({i * n // k for i in range(k)}) if n > k else list(range(n)))


def test_rank_percentile(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        want = sorted(values)[round(q * (len(values) - 1))]
        assert ranges.rank_percentile_by(rows, [], "v", q, "p").first()["p"] == want
        assert rows.agg(metrics.rank_percentile(F.col("v"), q).alias("p")).first()["p"] == want


def test_splits_never_tear_groups(spark):
    rows = spark.range(400).select(F.concat(F.lit("g"), F.col("id") % 60).alias("g"), (F.col("id") % 7).alias("label"))
    found = {r["g"]: r["split"] for r in splits.stratified(rows, "g", "label", 1).collect()}
    assert len(found) == 60 and set(found.values()) == {"train", "validation", "test"}
    per_label = splits.by_label(spark.range(60).select((F.col("id") % 3).alias("label"), F.col("id").alias("g"), F.lit(5).alias("n")), "label", "g", "n", 1)
    assert per_label.groupBy("label").agg(F.count_distinct("split").alias("k")).where("k < 3").isEmpty()


def test_stratified_split_has_one_rule_at_every_size(spark):
    """20 groups of a rare label among 200,100 are shared out to their targets."""
    rows = spark.range(200_100).select(F.concat(F.lit("g"), F.col("id")).alias("g"), F.when(F.col("id") < 20, "rare").otherwise("common").alias("label"))
    found = splits.stratified(rows, "g", "label", 1)
    got = {(r["label"], r["split"]): r["n"] for r in rows.join(found, "g").groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert {s: got["rare", s] for s in splits.SHARES} == {"train": 14, "validation": 3, "test": 3}
    assert sum(got.values()) == 200_100 and all(abs(got["common", s] - 200_080 * share) < 10 for s, share in splits.SHARES.items())


def test_stratified_split_equals_a_plain_version(spark):
    from collections import Counter, defaultdict

    rows = [(f"g{i % 37}", None if i % 11 == 0 else "abcd"[i * i % 7 % 4]) for i in range(500)] + [(None, "a"), ("alone", None)]
    frame = spark.createDataFrame(rows, "g string, label string")
    fraction = {r["g"]: r["at"] or 0.0 for r in frame.select("g", splits.stable_fraction(F.col("g"), 5).alias("at")).distinct().collect()}
    groups, totals = defaultdict(Counter), Counter(label for _, label in rows)
    for g, label in rows:
        groups[g][label] += 1
    sizes, filled, want = Counter(), defaultdict(Counter), {}
    tie = lambda g, s: int(hashlib.sha256(f"5:{g or ''}:{s}".encode()).hexdigest()[:16], 16) / 2**64

    def gap(have, goal):
        return ((have - goal) / max(goal, 1.0)) ** 2

    order = sorted(groups, key=lambda g: (min(totals[x] for x in groups[g]), -len(groups[g]), -groups[g].total(), fraction[g]))
    for i, g in enumerate(order):
        empty = [s for s in splits.SHARES if not sizes[s]]
        allowed = empty if empty and len(order) - i <= len(empty) else list(splits.SHARES)

        def score(split, g=g):  # the whole sum over splits and labels
            out = 0.0
            for s, share in splits.SHARES.items():
                out += gap(sizes[s] + (groups[g].total() if s == split else 0), len(rows) * share)
                out += sum(gap(filled[s][x] + (groups[g][x] if s == split else 0), n * share) / n**0.5 for x, n in totals.items())
            return round(out, 9)

        want[g] = min(allowed, key=lambda s: (score(s), tie(g, s), s))
        sizes[want[g]] += groups[g].total()
        filled[want[g]].update(groups[g])
    got = {r["g"]: r["split"] for r in splits.stratified(frame, "g", "label", 5).collect()}
    assert got == want
    assert splits.stratified(frame.limit(0), "g", "label", 5).count() == 0


def test_grouped_lists_gathers_no_rows(spark, tmp_path):
    from lodestar.plans import QUERIES

    rows = [(" A ", 5), ("a", None), ("a", 3), (None, 1)]
    spark.createDataFrame(rows, "p_brand string, p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["grouped_lists"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("a", 3, 3), (None, 1, 1)}
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_corrections(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, label string")
    told = spark.createDataFrame([(1, "relabel", "z", True), (2, "remove", None, True), (3, "remove", None, False)], "id int, action string, new_label string, approved boolean")
    kept, log = merges.corrected(rows, told, "id", "label")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "z"), (3, "c")] and log.count() == 2
    wrong = spark.createDataFrame([(1, "rename", None, True)], "id int, action string, new_label string, approved boolean")
    with pytest.raises(Exception, match="unknown action"):
        merges.corrected(rows, wrong, "id", "label")[0].collect()


def test_tracker_keeps_ids_and_forgets_late():
    tracker = tracking.Tracker()
    box = np.array([[0.0, 0.0, 10.0, 10.0]])
    assert tracker.step(box) == [(1, 1, False)]
    assert tracker.step(box + 1) == [(1, 2, False)]
    assert tracker.step(box + 2) == [(1, 3, True)]
    for _ in range(12):
        tracker.step(np.zeros((0, 4)))
    assert len(tracker.tracks) == 1
    tracker.step(np.zeros((0, 4)))
    assert not tracker.tracks
    assert tracker.step(box) == [(2, 1, False)]


def test_measures_and_rules(spark):
    rows = spark.createDataFrame([("MAX 60 kph",), ("3,5 t",), ("none",), (None,)], "t string").select(text.measure(F.col("t")).alias("m"))
    assert [(r["m"]["value"], r["m"]["unit"]) if r["m"] else None for r in rows.collect()] == [(60.0, "KM/H"), (3.5, "T"), None, None]
    cases = [("speed", 4.0, "KM/H"), ("speed", 160.0, None), ("height", 450.0, "CM"), ("height", 4.5, None), ("height", 11.0, "M"), ("distance", 2.0, "KM"), ("speed", 50.0, "T"), ("none", 5.0, "M")]
    got = spark.createDataFrame(cases, "k string, v double, u string").select(rules.valid_parameter(F.col("k"), F.col("v"), F.col("u")).alias("x")).collect()
    assert [tuple(r["x"]) if r["x"] else None for r in got] == [None, (160.0, "KM/H"), (4.5, "M"), None, None, (2.0, "KM"), None, None]


def test_resolved_labels(spark):
    cases = [("a", 0.8, "a", 0.7), ("a", 0.8, "a", 0.6), ("a", 0.3, "b", 0.99), ("zz", 0.9, "b", 0.7), ("zz", 0.9, "b", 0.6), ("zz", 0.9, None, None)]
    known = lambda c: F.col(c).isin("a", "b")
    rows = spark.createDataFrame(cases, "s string, p double, r string, q double").select(rules.resolved(F.col("s"), F.col("p"), known("s"), F.col("r"), F.col("q"), known("r")).alias("x")).collect()
    assert [(r["x"]["label"], round(r["x"]["confidence"], 6)) for r in rows] == [("a", 0.865), ("a", 0.8), ("a", 0.3), ("b", 0.7), ("unknown_sign", 0.9), ("unknown_sign", 0.9)]


def test_decisions(spark):
    signs = [("maximum_speed", "SET_TARGET_SPEED", "critical", "speed", None), ("stop", "STOP", "critical", "none", None), ("height", "HEIGHT_RESTRICTION", "warning", "height", None)]
    table = spark.createDataFrame(signs, "label string, base_action string, severity string, kind string, default_value double")
    cases = [("maximum_speed", 0.95, 50.0, "KM/H", 0.99), ("stop", 0.40, None, None, None), ("maximum_speed", 0.95, 300.0, "KM/H", 0.99), ("maximum_speed", 0.95, 50.0, "KM/H", 0.5), ("maximum_speed", 0.95, 50.0, "T", 0.99), ("height", 0.9, 450.0, "CM", 0.9), ("height", 0.9, 4.5, None, 0.9), ("nothing", 0.99, None, None, None)]
    rows = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "label string, confidence double, read_value double, read_unit string, read_confidence double, i int")
    got = rules.decided(rows, table).orderBy("i").select("action", "severity", "value").collect()
    unsure = ("UNKNOWN_CAUTION", "caution", None)
    assert [tuple(r) for r in got] == [("SET_TARGET_SPEED", "critical", 50.0), unsure, unsure, unsure, unsure, ("HEIGHT_RESTRICTION", "warning", 4.5), unsure, unsure]


def _at(*xs):
    return np.array([[x, 10.0, x + 40.0, 50.0] for x in xs]).reshape(-1, 4)


def test_tracker_cases():
    """The trackers' fixed cases: order swapped, occlusion and expiry, prediction, a far box, camera motion."""
    swapped = tracking.Tracker()
    assert [r[0] for r in swapped.step(_at(10, 180))] == [1, 2]
    assert [r[0] for r in swapped.step(_at(184, 14))] == [2, 1]
    hidden = tracking.Tracker(patience=2)
    ids = [[r[0] for r in hidden.step(_at(*xs))] for xs in ([20], [], [24], [], [], [], [24])]
    assert ids == [[1], [], [1], [], [], [], [2]]
    foreseen = tracking.Tracker()
    assert [[r[0] for r in foreseen.step(_at(*xs))] for xs in ([10], [30], [], [67])] == [[1], [1], [], [1]]
    far = tracking.Tracker()
    far.step(_at(0))
    assert far.step(_at(70))[0][0] == 1 and far.tracks[0].age == 2
    moved = tracking.Tracker()
    moved.step(_at(0))
    moved.step(_at(30), (30.0, 0.0))
    assert moved.tracks[0].velocity.tolist() == [0.0, 0.0]


def test_gated_assignment_is_least():
    """Pairs outside the gate never displace one inside: against all assignments of small frames."""
    from itertools import permutations

    random = np.random.default_rng(5)
    for _ in range(200):
        tracker = tracking.Tracker(most_distance=1.0)
        tracker.step(_at(*random.integers(0, 300, 3)))
        boxes = _at(*random.integers(0, 300, 3))
        cost = tracker.costs(boxes)
        best = min(sum(cost[i, p] for i, p in enumerate(order)) for order in permutations(range(3)))
        assert sum(cost[i, j] for i, j in tracking.assignment(cost)) == pytest.approx(best)


def test_checks_that_raise(spark):
    rows = spark.createDataFrame([("s0", "a"), ("s1", "a"), ("s1", "b")], "sample_id string, label string")
    shares = {"train": 0.7, "validation": 0.15, "test": 0.15}
    with pytest.raises(ValueError, match="missing"):
        decisions.require_split_input(rows, ["path"], "sample_id", shares)
    with pytest.raises(ValueError, match="repeat"):
        decisions.require_split_input(rows, ["label"], "sample_id", shares)
    with pytest.raises(ValueError, match="sum to 1"):
        decisions.require_split_input(rows, ["label"], "sample_id", {"train": 0.7, "test": 0.4})
    decisions.require_split_input(rows.limit(1), ["label"], "sample_id", shares)
    with pytest.raises(ValueError, match="too few"):
        decisions.require_enough(rows, "label", 2)
    wanted = spark.createDataFrame([("s1", 0), ("s9", 1)], "sample_id string, place int")
    with pytest.raises(ValueError, match="unknown sample_id"):
        decisions.chosen_in_order(wanted, rows, "sample_id")
    assert sorted(r["label"] for r in decisions.chosen_in_order(wanted.limit(1), rows, "sample_id").collect()) == ["a", "b"]


def test_tracks_over_batches(spark):
    """Many keys in one partition, in batches of three rows, as each key by itself."""
    rows = [(k, f, i, 10.0 * f + 100 * i + k, 0.0, 10.0 * f + 100 * i + k + 40, 40.0) for k in range(7) for f in range(1 + k) for i in range(1 + (k + f) % 3)]
    boxes = spark.createDataFrame(rows, "key int, frame int, id int, x1 double, y1 double, x2 double, y2 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(tuple(r) for r in tracking.tracked(boxes, "key", "frame").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in range(7):
        tracker = tracking.Tracker()
        for f in range(1 + k):
            part = [r for r in rows if r[0] == k and r[1] == f]
            want += [(k, f, r[2], *t) for r, t in zip(part, tracker.step(np.array([r[3:] for r in part])), strict=True)]
    assert got == sorted(want)


def test_assignments_of_many_problems():
    """Problems of all shapes together, with many ties and pairs outside the gate, each as by itself."""
    dice = np.random.default_rng(4)
    costs = [np.where(dice.random((n, m)) < 0.2, 1e6, dice.integers(0, 4, (n, m)) / 3) for _ in range(60) for n, m in [dice.integers(1, 7, 2)]]
    costs = [c if c.shape[0] <= c.shape[1] else c.T for c in costs]
    block = np.full((len(costs), 6, 6), np.inf)
    for c, cells in zip(costs, block, strict=True):
        cells[: c.shape[0], : c.shape[1]] = c
    owner = matching.assignments(block, np.array([len(c) for c in costs]))
    assert [[(i, j) for j, i in enumerate(o) if i >= 0] for o in owner.tolist()] == [sorted(matching.assignment(c), key=lambda p: p[1]) for c in costs]


@pytest.mark.parametrize("pairs, few", [(1 << 16, 3), (40, 1), (1, 5)])
def test_trackers_in_step(monkeypatch, pairs, few):
    """Keys of all lengths in step, also cut in the midst of a key, give what a tracker of each key gives: ids, hits and all that is carried on."""
    monkeypatch.setattr(tracking, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(tracking, "FEW", few)
    dice = np.random.default_rng(6)
    lengths = [*dice.integers(1, 9, 12), 60, 25]
    sizes = [dice.integers(1, 7, n) for n in lengths]
    corner = dice.integers(0, 8, (sum(map(sum, sizes)), 2)) * 30.0
    boxes = np.hstack([corner, corner + 40])
    boxes[::17] = np.nan
    boxes[5::29, 2] = np.inf
    frames = np.append(0, np.cumsum(np.concatenate(sizes)))
    keys = np.append(0, np.cumsum(lengths))
    want, trackers = [], []
    for begin, end in zip(keys[:-1], keys[1:], strict=True):
        trackers.append(tracking.Tracker())
        for f in range(begin, end):
            want += [x[:2] for x in trackers[-1].step(boxes[frames[f] : frames[f + 1]])]
    cut = keys[-3] + 31  # amid the key of 60 frames
    nothing = tracking.Tracks.of_one(0, [])
    *first, tracks, last_id = tracking.steps(boxes[: frames[cut]], frames[: cut + 1], np.append(keys[:-2], cut), nothing, 0)
    *second, tracks, last_id = tracking.steps(boxes[frames[cut] :], frames[cut:] - frames[cut], np.append(0, keys[-2:] - cut), tracks, last_id)
    assert [tuple(x) for part in (first, second) for x in zip(*map(np.ndarray.tolist, part), strict=True)] == want
    told = lambda t: repr((int(t.id), t.box.tolist(), t.velocity.tolist(), int(t.hits), int(t.missed)))
    assert list(map(told, tracks.as_list())) == list(map(told, trackers[-1].tracks)) and last_id == trackers[-1].last_id


def test_tracks_of_equal_ids(spark):
    """Boxes of one id in a frame go by their corners, however the rows come; null keys and frames are keys and frames."""
    rows = [(k, f, 1, 30.0 * i, 0.0, 30.0 * i + 40, 40.0) for k in (None, 1, 2) for f in (None, 1, 2, 3) for i in range(4)]
    schema = "key int, frame int, id int, x1 double, y1 double, x2 double, y2 double"
    one, other = (sorted(map(tuple, tracking.tracked(spark.createDataFrame(r, schema).repartition(n), "key", "frame").collect()), key=repr) for r, n in ((rows, 1), (rows[::-1], 3)))
    assert one == other == sorted([(k, f, 1, i + 1, h, h >= 3) for k in (None, 1, 2) for h, f in enumerate((None, 1, 2, 3), 1) for i in range(4)], key=repr)


def test_hamming_pairs_at_every_distance(spark):
    rng = random.Random(9)
    codes = [(i, rng.getrandbits(63)) for i in range(150)]
    codes += [(150 + i, codes[i][1] ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(30)))) for i in range(100)] + [(400, codes[0][1]), (401, codes[0][1])]
    frame = spark.createDataFrame(codes, "id long, code long")
    for most in (0, 3, 7, 8, 16, 20):
        found = sorted(map(tuple, duplicates.hamming_pairs(frame, "id", "code", most, 63).collect()))
        assert found == sorted((a, b, (x ^ y).bit_count()) for (a, x), (b, y) in itertools.combinations(codes, 2) if (x ^ y).bit_count() <= most)
    # of unlike codes, few meet in a band
    unlike = spark.createDataFrame([(i, rng.getrandbits(63)) for i in range(300)], "id long, code long")
    assert duplicates.hamming_candidates(unlike, "id", "code", 16, 63).select("a", "b").distinct().count() < 300 * 299 // 2 // 10


def test_percentiles_and_quotas_by_ranges(spark):
    rng = random.Random(10)
    rows = [(rng.choice(["a", "b", None]), round(rng.gauss(0, 1), 1), rng.randrange(1000), i) for i in range(800)] + [("c", None, None, -1), ("d", 2.5, 5, -2), ("hot", 1.0, 7, -3)] + [("hot", 1.0, 7, i) for i in range(900, 1300)]
    frame = spark.createDataFrame(rows, "k string, v double, at long, id long")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in ranges.percentiles_by(frame, ["k"], "v", shares).collect()}
    for key in ("a", "b", None, "d", "hot"):
        values = [v for k, v, _, _ in rows if k == key and v is not None]
        assert got[key].n == len(values)
        assert [got[key][name] for name in shares] == pytest.approx(np.quantile(values, list(shares.values())).tolist())
    assert set(got) == {"a", "b", None, "d", "hot"}
    one = ranges.percentiles_by(frame, [], "v", shares).collect()
    assert [one[0][name] for name in shares] == pytest.approx(np.quantile([v for _, v, _, _ in rows if v is not None], list(shares.values())).tolist())
    assert ranges.percentiles_by(frame.limit(0), ["k"], "v", shares).isEmpty()
    dated = frame.where("at is not null")
    for most in (1, 7, 90, 10_000):
        found = sorted((r.k or "", r.id) for r in ranges.first_of_scan(dated, ["k"], "at", ["id"], F.lit(most)).collect())
        want = []
        for key in {k for k, _, at, _ in rows if at is not None}:
            want += [(key or "", i) for _, i in sorted((at, i) for k, _, at, i in rows if k == key and at is not None)[:most]]
        assert found == sorted(want)
    assert ranges.first_of_scan(dated.limit(0), ["k"], "at", ["id"], F.lit(3)).isEmpty()


def plain_alias(said, catalogue, score, least, margin, shortest):
    out = []
    for key, text in said:
        if text is None or len(text) < max(1, shortest):
            continue
        best: dict = {}
        for entry, alias in catalogue:
            if alias:
                best[entry] = max(best.get(entry, 0.0), score(text, alias))
        ranked = sorted((-s, e) for e, s in best.items())
        if ranked and -ranked[0][0] >= least and (len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= margin):
            out.append((key, ranked[0][1], round(-ranked[0][0], 9)))
    return sorted(out)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_aliases_equal_brute_force(spark):
    rng = random.Random(20)
    word = lambda n: "".join(rng.choice("abcdxyz") for _ in range(n))
    catalogue = [(f"e{i % 150}", word(rng.randrange(1, 16))) for i in range(220)] + [("same", "stop"), ("twin", "stop"), ("none", ""), ("void", None), ("sign", "berhenti"), ("road", "road")]
    said = []
    for i in range(400):
        text = list(rng.choice(catalogue)[1] or "zz")
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = [rng.choice("abq")] if rng.random() < 0.6 else []
        said.append((i, "".join(text)))
    said += [(900, None), (901, ""), (902, "berhnti"), (903, "roa"), (904, "berhnti")]
    rows, entries = spark.createDataFrame(said, "id int, said string"), spark.createDataFrame(catalogue, "entry string, alias string")
    for like, score in ((rules.RATIO, lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()), (rules.EDITS, lambda a, b: 1 - edit_distance(a, b) / max(len(a), len(b)))):
        for least, margin, shortest in ((0.88, 0.08, 4), (0.7, 0.05, 1), (0.8, 0.0, 1)):
            found = sorted((r.id, r.entry, round(r.score, 9)) for r in rules.best_alias(rows, "id", "said", entries, "entry", like, least, margin, shortest).collect())
            assert found == plain_alias(said, catalogue, score, least, margin, shortest)
            assert found
    # unlike words meet seldom
    unlike = spark.createDataFrame([("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(8, 15))),) for _ in range(300)], "alias string")
    for like in (rules.RATIO, rules.EDITS):
        assert rules.alias_candidates(unlike.withColumnRenamed("alias", "said"), "said", unlike, like, 0.8).count() < 300 * 300 // 8
    assert rules.best_alias(rows.limit(0), "id", "said", entries, "entry", rules.RATIO, 0.88, 0.08).isEmpty()
    assert rules.best_alias(rows, "id", "said", entries.limit(0), "entry", rules.RATIO, 0.88, 0.08).isEmpty()


def test_fuzzy_part_names_equal_brute_force(spark, small):
    parts, nations = (spark.read.parquet(f"{small}/{name}.parquet") for name in ("part", "nation"))
    said = [(r.p_partkey, r.said) for r in language.written_parts(parts).collect()]
    catalogue = [(r.entry, r.alias) for r in language.part_aliases(parts, nations).collect()]
    score = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    found = sorted((r.p_partkey, r.entry, round(r.score, 9)) for r in language.alias_fuzzy_ratio(spark, small).collect())
    assert found == plain_alias(said, catalogue, score, 0.88, 0.08, 4)
    assert len(found) > 50
