"""What a class still lacks: priority, targets, risks, status, rank and advice of a collection report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minimum, good and strong counts by what a class is needed for, the first that fits; then the share of tiny crops that is a risk.
TARGETS = [("assignment", 50, 150, 300), ("demo_default", 50, 150, 300), ("common_malaysia", 50, 100, 200)]
VALUE_TARGETS, SHOULD_TARGETS, OTHER_TARGETS = (50, 100, 300), (30, 80, 150), (10, 30, 50)
TINY_SHARE = 0.25

#: What a report says of a class.
PLANS = {
    "optional_no_data": "Do not collect now; exclude from final claims unless later promoted.",
    "ready_count_qc_risk": "Run targeted QC/final split audit before training claim; collect only if QC removes too many samples.",
    "split_gap": "Rebuild leakage-safe train/validation/test split before training.",
    "ready": "Can be included in next classifier training after dataset freeze.",
}
PLAN_EXTRAS = {
    "assignment": " Keep coursework images as external test unless explicitly moved into training.",
    "demo_default": " Capture phone/laptop-camera examples from real or printed demo signs.",
    "ocr_value": " Store OCR transcript/value/unit for each sample.",
}
LIMITATIONS = {
    "optional_no_data": "No final limitation if excluded from claims.",
    "missing_data": "Likely unknown or wrong in the live app until data is collected and the classifier is retrained.",
    "below_minimum": "Likely unknown or wrong in the live app until data is collected and the classifier is retrained.",
    "ready_count_qc_risk": "May train a noisy decision boundary unless QC confirms labels.",
    "split_gap": "Metrics may be unreliable until split coverage is fixed.",
    "": "No major data-count limitation for the next training pass.",
}
RANKS = {"must": ("P0_collect_now", "P1_fix_before_training"), "should": ("P2_collect_after_P0", "P3_fix_if_claimed")}

#: The flags of a class, each with the group that it puts the class in, in the report's order (fixed values).
GROUPS = {"assignment": "assignment", "common_must": "common_malaysia", "demo": "demo_default", "common_should": "secondary_malaysia", "value_class": "ocr_value", "text_class": "multilingual_text"}


def classified(rows: DataFrame) -> DataFrame:
    """``rows`` (total, train, validation, test, tiny and the flags of ``GROUPS`` and ``known_risk``) with groups, priority, minimum, good, strong, risk, split_status, status, rank, plan, limitation."""
    named = [F.when(F.col(flag), group) for flag, group in GROUPS.items()] + [F.when(F.col("total") > 0, "current_p5_dataset")]
    groups = F.array_compact(F.array(*named))
    rows = rows.withColumn("groups", F.when(F.size(groups) == 0, F.array(F.lit("future_catalogue"))).otherwise(groups))
    needed = F.col("assignment") | F.col("common_must") | F.col("demo")
    rows = rows.withColumn("priority", F.when(needed, "must").when(F.col("common_should") | (F.col("total") > 0), "should").otherwise("optional"))
    in_group = lambda name: F.array_contains("groups", name)
    cases = [(in_group(name), counts) for name, *counts in TARGETS] + [(in_group("ocr_value") & (F.col("priority") != "optional"), VALUE_TARGETS), (F.col("priority") == "should", SHOULD_TARGETS)]
    pick = lambda i: reduce(lambda tail, case: F.when(case[0], case[1][i]).otherwise(tail), reversed(cases), F.lit(OTHER_TARGETS[i]))
    rows = rows.withColumns({"minimum": pick(0), "good": pick(1), "strong": pick(2)})
    tiny = (F.col("total") > 0) & (F.try_divide("tiny", "total") >= TINY_SHARE)
    risks = F.array_join(F.array_compact(F.array(F.when(F.col("known_risk"), "known_noise_history"), F.when(tiny, "high_tiny_crop_rate"))), ";")
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(s) == 0, s) for s in ("train", "validation", "test")])), "_")
    rows = rows.withColumns({"risk": F.when(risks == "", "none").otherwise(risks), "split_status": F.when(F.col("total") == 0, "no_samples").when(missing == "", "ok").otherwise(F.concat(F.lit("missing_"), missing))})
    total = F.col("total")
    status = F.when((total == 0) & (F.col("priority") == "optional"), "optional_no_data").when(total == 0, "missing_data").when(total < F.col("minimum"), "below_minimum")
    status = status.when((F.col("train") == 0) | (F.col("validation") == 0), "split_gap").when(F.col("risk") != "none", "ready_count_qc_risk")
    rows = rows.withColumn("status", status.when(total >= F.col("strong"), "ready_strong").when(total >= F.col("good"), "ready_good").otherwise("ready_minimum"))
    lacking, unsure = F.col("status").isin("missing_data", "below_minimum"), F.col("status").isin("ready_count_qc_risk", "split_gap")
    rank = F.when(F.col("priority") == "optional", "P4_optional")
    for priority, (collect, fix) in RANKS.items():
        rank = rank.when((F.col("priority") == priority) & lacking, collect).when((F.col("priority") == priority) & unsure, fix)
    more = F.concat(F.lit("Collect and annotate at least "), F.greatest(F.col("minimum") - total, F.lit(0)).cast("string"), F.lit(" more clean crops; aim for "), F.col("good").cast("string"), F.lit(" total."))
    more = F.concat(more, *[F.when(in_group(g), text).otherwise("") for g, text in PLAN_EXTRAS.items()])
    plan = F.when(F.startswith("status", F.lit("ready_")) & (F.col("status") != "ready_count_qc_risk"), PLANS["ready"])
    for name in ("optional_no_data", "ready_count_qc_risk", "split_gap"):
        plan = plan.when(F.col("status") == name, PLANS[name])
    limits = F.lit(LIMITATIONS[""])
    for name, text in LIMITATIONS.items():
        limits = F.when(F.col("status") == name, text).otherwise(limits) if name else limits
    return rows.withColumns({"rank": rank.otherwise("P5_ready_queue"), "plan": plan.otherwise(more), "limitation": limits})
