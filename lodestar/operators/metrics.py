"""Evaluation metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linear_percentile(value: Column, share: float) -> Column:
    """Between the two nearest ranks, in proportion."""
    return F.percentile(value, F.lit(share))


def rank_percentile(value: Column, share: float) -> Column:
    """The value at rank round(share (n - 1)), halves to even. Gathers a group's values: for groups of bounded size."""
    ordered = F.sort_array(F.collect_list(value))
    return F.element_at(ordered, (F.bround(F.lit(share) * (F.count(value) - 1)) + 1).cast("int"))


def confusion(rows: DataFrame, target: str = "target", predicted: str = "predicted") -> DataFrame:
    """(target, predicted, n), a row for each pair that occurs."""
    return rows.groupBy(target, predicted).agg(F.count("*").alias("n"))


def dense_confusion(counts: DataFrame) -> DataFrame:
    """``confusion`` with 0 for the pairs of labels that do not occur; the labels, one for each class, come from both columns."""
    labels = counts.select(F.explode(F.array("target", "predicted")).alias("x")).distinct()
    others = labels.agg(F.collect_set("x").alias("all"))
    pairs = labels.withColumn("_k", F.lit(1)).join(F.broadcast(others.withColumn("_k", F.lit(1))), "_k").select(F.col("x").alias("target"), F.explode("all").alias("predicted"))
    return pairs.join(counts, ["target", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_scores(counts: DataFrame, every_label: bool = False) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) from ``confusion``, 0 where undefined; labels: targets, or targets and predictions."""
    hit = F.col("target") == F.col("predicted")
    by_target = counts.groupBy(F.col("target").alias("label")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support"))
    by_prediction = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fp"))
    rows = by_target.join(by_prediction, "label", "full" if every_label else "left").na.fill(0)
    rows = rows.withColumn("fn", F.col("support") - F.col("tp"))
    zero = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return rows.select("label", "tp", "fp", "fn", "support", zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def calibration_error(rows: DataFrame, confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """One row: the expected calibration error over equal bins (lower, upper]."""
    inside = rows.where(F.col(confidence) > 0).groupBy(F.ceil(F.col(confidence) * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("double")).alias("a"))
    total = rows.agg(F.count("*").alias("total"))
    gaps = inside.agg(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))).alias("gap"))
    return gaps.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").select(F.round(F.coalesce("gap", F.lit(0.0)) / F.col("total"), 6).alias("ece"))


def largest_difference(rows: DataFrame, a: str, b: str) -> list[Column]:
    """Aggregates of the parity of two columns."""
    d = F.abs(F.col(a) - F.col(b))
    return [F.max(d).alias("max_diff"), F.round(F.avg(d), 9).alias("mean_diff"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement")]
