"""Rules, reports and small functions on fixed cases."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lodestar.functions import geometry, hashing, text, vectors
from lodestar.operators import checks, decisions, gaps, matching, merges
from lodestar.sources import readers, writers


def one(spark, column, **values):
    """The column over one row of the values."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first().x


def test_polygon_faults(spark):
    box = geometry.Box()
    good = ([12.0, 58.0, 58.0, 12.0], [12.0, 12.0, 58.0, 58.0])
    cases = [
        (good, (10.0, 10.0, 60.0, 60.0), None), (([12.0, 58.0], [12.0, 12.0]), (10.0, 10.0, 60.0, 60.0), "fewer than three points"), (([], []), (0.0, 0.0, 1.0, 1.0), "fewer than three points"),
        (([-1.0, 58.0, 58.0], [12.0, 12.0, 58.0]), (10.0, 10.0, 60.0, 60.0), "outside the image"), (([12.0, 58.0, 58.0], [12.0, 12.0, 101.0]), (10.0, 10.0, 60.0, 60.0), "outside the image"),
        (([12.0, float("nan"), 58.0], [12.0, 12.0, 58.0]), (10.0, 10.0, 60.0, 60.0), "not finite"), (([12.0, 13.0, 13.0], [12.0, 12.0, 13.0]), (10.0, 10.0, 60.0, 60.0), "area ratio"),
        (([50.0, 96.0, 96.0, 50.0], [50.0, 50.0, 96.0, 96.0]), (10.0, 10.0, 60.0, 60.0), "box overlap"),
    ]
    frame = spark.createDataFrame([(i, *p, *b) for i, (p, b, _) in enumerate(cases)], "i int, xs array<double>, ys array<double>, x1 double, y1 double, x2 double, y2 double")
    fault = geometry.polygon_fault(F.col("xs"), F.col("ys"), box, F.lit(100), F.lit(100), 0.5, 0.1, 1.2)
    rows = frame.select("i", fault.alias("f"), geometry.polygon_box_iou(F.col("xs"), F.col("ys"), box).alias("iou"), geometry.polygon_area(F.col("xs"), F.col("ys")).alias("a"), F.array(*geometry.polygon_box(F.col("xs"), F.col("ys"))).alias("b")).orderBy("i").collect()
    assert [r.f for r in rows] == [want for _, _, want in cases]
    assert rows[0].a == 2116 and rows[0].iou > 0.8 and rows[0].b == [12, 12, 58, 58]


def test_boxes(spark):
    frame = spark.createDataFrame([(10.0, 20.0, 31.0, 25.0)], "x1 double, y1 double, x2 double, y2 double")
    assert list(frame.select(*[c.alias(str(i)) for i, c in enumerate(geometry.truncated_padding(geometry.Box(), F.lit(35.0), F.lit(90.0), 0.45, 1))]).first()) == [1.0, 18.0, 35.0, 27.0]
    told = frame.select(*[c.alias(n) for c, n in zip(geometry.to_center_format(geometry.Box(), F.lit(100.0), F.lit(50.0)), "abcd", strict=True)])
    back = told.select(*[c.alias(str(i)) for i, c in enumerate(geometry.from_center_format(*map(F.col, "abcd"), F.lit(100.0), F.lit(50.0)))]).first()
    assert list(back) == pytest.approx([10.0, 20.0, 31.0, 25.0])


MANIFEST = "semantic_sign_id string, file_name string, source_label string, source_file_url string, source_url string, dedupe_key string, crop_sha256 string, source_group string"


def test_manifest_groups(spark):
    cases = [
        (("stop", "a.jpg", None, "x/controlled_from_MAN01-AB-0001.png", None, None, None, "g"), "stop::MAN01-AB-0001", "g::stop::a"),
        (("stop", "MAN01-CD-0002.v1.jpg", "controlled_from_MAN01-AB-0001", None, "u", "k", "s", None), "stop::MAN01-AB-0001", "unknown::stop::k"),
        (("stop", "x_MAN01-CD-0002.jpg", "", "MAN01-EF-0009", " u ", "k", " s ", ""), "stop::MAN01-CD-0002", "::stop::k"),
        (("stop", "b.c.jpg", None, None, " u ", " k ", "s", "g"), "stop::u", "g::stop::k"), (("stop", "b.c.jpg", None, None, " ", " k ", None, "g"), "stop::k", "g::stop::k"),
        (("stop", "b.c.jpg", None, None, None, "", " s ", "g"), "stop::b.c", "g::stop::s"), (("stop", ".hidden", None, None, None, None, None, "g"), "stop::.hidden", "g::stop::.hidden"),
    ]
    frame = spark.createDataFrame([row for row, _, _ in cases], MANIFEST).coalesce(1)
    got = [tuple(r) for r in frame.select(decisions.base_variant(), decisions.leakage_group()).collect()]
    assert got == [(base, leak) for _, base, leak in cases]


def test_whole_groups(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "test"), (None, "test")], "g string, split string")
    decisions.require_whole_groups(rows, "g", "split")
    with pytest.raises(ValueError, match="several splits"):
        decisions.require_whole_groups(rows.unionByName(spark.createDataFrame([("a", "test")], rows.schema)), "g", "split")
    with pytest.raises(ValueError, match="no rows"):
        decisions.require_whole_groups(rows.limit(0), "g", "split")


def test_evidence(spark):
    cases = [(("by hand", True, "high", 0.1), "by hand"), ((None, True, "high", 0.1), "confirmed_owner_review"), ((None, False, "high", 0.1), "confirmed_online_reference"), ((None, None, "low", 0.99), "accepted_with_reference_caution"), ((None, False, None, 0.95), "confirmed_visual_high_confidence"), ((None, False, None, 0.9), "accepted_visual_medium_confidence"), ((None, False, None, 0.899), "needs_second_review"), ((None, None, None, None), "needs_second_review")]
    frame = spark.createDataFrame([row for row, _ in cases], "o string, w boolean, r string, c double").coalesce(1)
    assert [r.x for r in frame.select(decisions.evidence_status(*map(F.col, "owrc")).alias("x")).collect()] == [want for _, want in cases]


def test_gap_ladder(spark):
    flags = [*gaps.GROUPS, "known_risk"]

    def row(total, train, validation, test, tiny=0, *named):
        return (total, train, validation, test, tiny, *[f in named for f in flags])

    cases = [
        (row(0, 0, 0, 0), ("future_catalogue", "optional", 10, "none", "no_samples", "optional_no_data", "P4_optional")),
        (row(0, 0, 0, 0, 0, "assignment"), ("assignment", "must", 50, "none", "no_samples", "missing_data", "P0_collect_now")),
        (row(20, 20, 0, 0, 0, "common_should"), ("secondary_malaysia;current_p5_dataset", "should", 30, "none", "missing_validation_test", "below_minimum", "P2_collect_after_P0")),
        (row(60, 60, 0, 0, 0, "demo", "value_class"), ("demo_default;ocr_value;current_p5_dataset", "must", 50, "none", "missing_validation_test", "split_gap", "P1_fix_before_training")),
        (row(160, 100, 30, 30, 40), ("current_p5_dataset", "should", 30, "high_tiny_crop_rate", "ok", "ready_count_qc_risk", "P3_fix_if_claimed")),
        (row(200, 100, 50, 50, 50, "common_must", "known_risk"), ("common_malaysia;current_p5_dataset", "must", 50, "known_noise_history;high_tiny_crop_rate", "ok", "ready_count_qc_risk", "P1_fix_before_training")),
        (row(300, 200, 50, 50, 0, "value_class"), ("ocr_value;current_p5_dataset", "should", 50, "none", "ok", "ready_strong", "P5_ready_queue")),
        (row(150, 100, 25, 25, 0, "assignment"), ("assignment;current_p5_dataset", "must", 50, "none", "ok", "ready_good", "P5_ready_queue")),
    ]
    frame = spark.createDataFrame([r for r, _ in cases], ", ".join(f"{c} int" for c in ("total", "train", "validation", "test", "tiny")) + ", " + ", ".join(f"{f} boolean" for f in flags)).coalesce(1)
    rows = gaps.classified(frame).collect()
    assert [(";".join(r.groups), r.priority, r.minimum, r.risk, r.split_status, r.status, r["rank"]) for r in rows] == [want for _, want in cases]
    assert rows[1].plan.startswith("Collect and annotate at least 50 more clean crops; aim for 150 total. Keep") and rows[6].plan == gaps.PLANS["ready"]
    assert rows[0].limitation == gaps.LIMITATIONS["optional_no_data"] and rows[6].limitation == gaps.LIMITATIONS[""]


def test_detection_totals_are_one_to_one(spark):
    kind = "frame int, id int, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 0.0, 11.0, 10.0), (2, 1, 0.0, 0.0, 5.0, 5.0)], kind)
    predicted = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 10.0), (1, 8, 50.0, 50.0, 60.0, 60.0), (3, 9, 0.0, 0.0, 1.0, 1.0)], kind)
    bucket = F.when(geometry.Box().area <= 25, "small").otherwise("large")
    rows = {r.bucket: r for r in matching.detection_totals(truth, predicted, "frame", bucket).collect()}
    assert (rows["all"].n_truth, rows["all"].n_hit, rows["all"].n_predicted, rows["all"].n_false) == (3, 1, 3, 2)  # two truths, one prediction: one hit
    assert rows["all"].recall == pytest.approx(1 / 3) and rows["all"].precision == pytest.approx(1 / 3) and rows["all"].false_per_frame == pytest.approx(2 / 3)
    assert (rows["large"].n_truth, rows["large"].n_hit, rows["small"].n_hit, rows["small"].precision) == (2, 1, 0, None)
    none = matching.detection_totals(truth.limit(0), predicted, "frame", bucket).collect()
    assert [(r.bucket, r.n_truth, r.recall, r.n_false) for r in none] == [("all", 0, 0.0, 3)]


def test_profiles_and_clear_boxes(spark):
    profiles = spark.createDataFrame([("now", 0.8, 0.7, 9.0), ("a", 0.77, 0.6, 3.0), ("b", 0.76, 0.9, 3.0), ("c", 0.1, 1.0, 0.0), ("d", 0.76, 0.9, 3.0)], "name string, recall double, precision double, false_rate double")
    assert [r.name for r in matching.selected_profile(profiles, "name", "now").collect()] == ["b"]
    kind = "frame int, id int, x1 double, y1 double, x2 double, y2 double"
    candidates = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 8.0, 8.0, 20.0, 20.0), (1, 3, 30.0, 30.0, 40.0, 40.0), (2, 4, 0.0, 0.0, 10.0, 10.0), (1, 5, 14.0, 14.0, 40.0, 40.0)], kind)
    signs = spark.createDataFrame([(1, 1, 4.0, 4.0, 6.0, 6.0), (1, 2, 12.0, 12.0, 15.0, 15.0), (1, 3, 33.0, 33.0, 33.0, 33.0)], kind)
    assert sorted(r.id for r in matching.clear_of(candidates, signs, "frame", 0.1).collect()) == [4]
    assert sorted(r.id for r in matching.clear_of(candidates.where("id = 5"), signs.where("id = 2"), "frame", 0.2).collect()) == [5]


def test_small_functions(spark):
    assert one(spark, hashing.short_id("a", F.lit("X"), 8)) == "a_11f6ad8e"
    assert one(spark, text.title_of_code(F.lit("KEEP_left"))) == "Keep Left"
    assert one(spark, text.base_variant(F.lit("sign_jpg.rf.0af1.jpg"))) == "sign_jpg"
    assert one(spark, text.stem(F.lit("a/b/c.d.jpg"))) == "c.d"
    assert one(spark, vectors.log_signed(F.lit(-100.0))) == pytest.approx(2.0) and one(spark, vectors.log_signed(F.lit(0.0))) == 0
    items = F.array(*[F.struct(F.lit(c).alias("label"), F.lit(x).alias("confidence")) for c, x in (("a", 0.456), ("b", 1.0), ("c", 0.0))])
    assert one(spark, checks.compact(items, 2)) == "a:0.46;b:1.00"
    changed = one(spark, checks.updated_elements(items, "label", F.lit("b"), "confidence", F.lit(0.5)))
    assert [tuple(x) for x in changed] == [("a", 0.456), ("b", 0.5), ("c", 0.0)]


def test_tables(spark):
    left, right = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ((1, 2, 2), (2, 1)))
    checks.require_equal_keys(left, right, "k")
    with pytest.raises(ValueError, match="k differs"):
        checks.require_equal_keys(left, right.where("k = 1"), "k")
    rows = spark.createDataFrame([(1, " A "), (2, "a"), (3, "b"), (4, None)], "i int, k string")
    good, bad = merges.accepted_and_rejected(rows, [("no key", F.col("k").isNull()), ("odd", F.col("i") == 3)])
    assert good.columns == ["i", "k"] and sorted(r.i for r in good.collect()) == [1, 2]
    assert sorted((r.i, r.reject_reason) for r in bad.collect()) == [(3, "odd"), (4, "no key")]
    assert {r.k: [x.i for x in r.rows] for r in checks.group_lists(rows, "k", "i").collect()} == {"a": [1, 2], "b": [3], None: [4]}


def test_documents_and_reports(spark, tmp_path):
    schema = StructType([StructField("entries", ArrayType(StructType([StructField("a", LongType()), StructField("b", DoubleType())])))])
    (tmp_path / "d.json").write_text(json.dumps({"entries": [{"a": 1, "b": 0.5}, {"a": 2}]}))
    assert sorted(tuple(r) for r in readers.json_document(spark, str(tmp_path / "d.json"), schema, "entries").collect()) == [(1, 0.5), (2, None)]
    (tmp_path / "e.json").write_text(json.dumps({"entries": [{"a": "x"}]}))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.json_document(spark, str(tmp_path / "e.json"), schema, "entries").collect()
    wide = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, body string")
    assert sorted(r.body for r in readers.late_rows(spark.createDataFrame([(1,), (3,), (3,)], "k int"), wide, "k").collect()) == ["x", "z"]
    writers.json_lines(wide, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3
    assert json.loads(writers.report(wide.agg(F.count("*").alias("n")))) == {"n": 3} and writers.report(wide.limit(0)) == "{}"
    (tmp_path / "list.txt").write_text("a/b.jpg\n\n c.jpg \n")
    (tmp_path / "list.csv").write_text("path,x\nd.jpg,1\n")
    assert sorted(r.path for r in readers.listed(spark, str(tmp_path / "list.txt")).collect()) == ["a/b.jpg", "c.jpg"]
    assert [r.path for r in readers.listed(spark, str(tmp_path / "list.csv")).collect()] == ["d.jpg"]
    (tmp_path / "t" / "train" / "stop").mkdir(parents=True)
    (tmp_path / "t" / "train" / "stop" / "1.bin").write_bytes(b"x")
    row = readers.files(spark, str(tmp_path / "t")).first()
    assert (row.split, row.label, row["name"], row.length) == ("train", "stop", "1.bin", 1)


def test_markdown_of_any_length(spark, tmp_path):
    rows = spark.range(1000).select((999 - F.col("id")).alias("n"), F.when(F.col("id") % 2 == 0, "a|b\nc").alias("text"))
    writers.markdown(rows, str(tmp_path / "m"), ["n"])
    lines = [line for part in sorted((tmp_path / "m").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines[:4] == ["| n | text |", "| --- | --- |", "| 0 |  |", "| 1 | a\\|b c |"] and len(lines) == 1002
    assert [r.value for r in writers.markdown_lines(rows.limit(0)).collect()] == ["| n | text |", "| --- | --- |"]
