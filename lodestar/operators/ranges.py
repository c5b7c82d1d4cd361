"""Ranks, percentiles and quotas by group without any group in one task: two-level prefix sums over ranges of a number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that the numbers are cut into; the cuts (one fewer) are all that the driver holds.
RANGES = 64


def range_of(df: DataFrame, value: str, ranges: int = RANGES) -> Column:
    """The number of the range that the column ``value`` lies in, by cuts at approximate quantiles: fixed numbers in the plan, so that every use agrees."""
    found = df.agg(F.approx_percentile(value, F.lit([i / ranges for i in range(1, ranges)]), F.lit(10 * ranges)).alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(value)))


def _before(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., range, s) with ``before``: the sum of the key's smaller ranges."""
    order = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("_before", F.coalesce(F.sum("_s").over(order), F.lit(0)))


def _ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., value, n, _upto): each distinct value that is not null, how many values its key has, and how many up to it."""
    held = df.where(F.col(value).isNotNull())
    counts = held.groupBy(*keys, value).agg(F.count("*").alias("_n")).withColumn("_range", range_of(held, value))
    sums = _before(counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_s")), keys)
    totals = sums.groupBy(*keys).agg(F.sum("_s").alias("n"))
    told = _same(_same(counts, sums, [*keys, "_range"]), totals, list(keys))
    return told.withColumn("_upto", F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_range").orderBy(value)))


def percentiles_by(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys..., n, and a column for each of ``shares``): linear percentiles of the values that are not null, exact.

    Distinct values are counted; a value's rank is the sum of its key's smaller
    ranges and of the smaller values of its own. Without keys there is one row,
    also for no values.
    """
    placed = _ranked(df, keys, value)
    aggregates = [F.max("n").alias("n")]
    for name, share in shares.items():
        place = F.lit(share) * (F.col("n") - 1)
        for end, rank in (("_low", F.floor(place)), ("_high", F.ceil(place))):
            aggregates.append(F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(name + end))
    done = placed.groupBy(*keys).agg(*aggregates)
    outs = []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("n") - 1)
        low, high = F.col(name + "_low"), F.col(name + "_high")
        outs.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return done.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), *outs)


def rank_percentile_by(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """(keys..., name): the value at rank round(share (n - 1)), halves to even; without keys one row, null for no values."""
    rank = F.bround(F.lit(share) * (F.col("n") - 1))
    return _ranked(df, keys, value).where(F.col("_upto") > rank).groupBy(*keys).agg(F.min(value).alias(name))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on keys that may be null; without keys, with the one row on the right."""
    if not keys:
        return left.withColumn("_k", F.lit(1)).join(F.broadcast(right.withColumn("_k", F.lit(1))), "_k").drop("_k")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def first_of_scan(rows: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], most: Column) -> DataFrame:
    """The first ``most`` (a column, the same for all rows of a key) rows of each key by (``at``, ``order``).

    ``at`` is a number. Rows are counted by key and range of ``at``; ranges that
    fit whole are kept without a sort, and only the range where a key's quota
    ends is sorted. ``rows`` is read three times.
    """
    ranged = rows.withColumns({"_range": range_of(rows, at), "_most": most})
    sums = _before(ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_s"), F.max("_most").alias("_quota")), keys)
    # ranges past the quota are gone before the rows are joined
    told = _same(ranged, sums.where("_before < _quota"), [*keys, "_range"])
    whole = told.where("_before + _s <= _quota")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(at, *order))
    cut = told.where("_before + _s > _quota").withColumn("_place", place).where("_place <= _quota - _before").drop("_place")
    return whole.unionByName(cut).select(*rows.columns)
