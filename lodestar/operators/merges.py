"""Keyed updates, overrides, assertions and gap reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def accepted_and_rejected(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that break no rule, rows with ``reject_reason``)."""
    marked = df.withColumn("reject_reason", first_reason(rules))
    return marked.where("reject_reason IS NULL").drop("reject_reason"), marked.where("reject_reason IS NOT NULL")


def replaced_partition(old: DataFrame, new: DataFrame, dropped: Column) -> DataFrame:
    """``old`` without the rows of the replaced part, and ``new``."""
    return old.where(~F.coalesce(dropped, F.lit(False))).unionByName(new)


def add_counts(table: DataFrame, counts: DataFrame, key: str, total: str = "total", least: str = "minimum", capped: bool = False) -> DataFrame:
    """``table`` with counts (key, n) added to the total of matched keys, up to the gap if capped; status follows."""
    n = F.coalesce("n", F.lit(0))
    added = F.least(n, F.greatest(F.lit(0), F.col(least) - F.col(total))) if capped else n
    done = table.join(counts.select(key, "n"), key, "left").withColumn(total, F.col(total) + added).drop("n")
    return with_gap(done, total, least)


def raise_to_minimum(table: DataFrame, keys: DataFrame, key: str, total: str = "total", least: str = "minimum") -> DataFrame:
    """``table`` with the totals of the given keys raised to the minimum."""
    hit = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    done = table.join(hit, key, "left").withColumn(total, F.when(F.col("_hit"), F.greatest(total, least)).otherwise(F.col(total))).drop("_hit")
    return with_gap(done, total, least)


def with_gap(table: DataFrame, total: str = "total", least: str = "minimum") -> DataFrame:
    return table.withColumn("gap", F.greatest(F.lit(0), F.col(least) - F.col(total))).withColumn("status", F.when(F.col("gap") == 0, "complete").when(F.col(total) > 0, "partial").otherwise("missing"))


def keep_reviews(fresh: DataFrame, before: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``fresh`` with the given columns taken from the previous output where it has the key, else empty."""
    old = before.select(key, *columns)
    return fresh.join(old, key, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def corrected(rows: DataFrame, corrections: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows after approved corrections, log of those applied): action relabel gives new_label, remove deletes; another action raises."""
    approved = corrections.where("approved").select(key, "action", "new_label")
    approved = approved.withColumn("action", F.when(F.col("action").isin("relabel", "remove"), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.coalesce("action", F.lit("null"))))))
    both = rows.join(approved, key, "left")
    kept = both.where("action IS NULL OR action <> 'remove'").withColumn(label, F.when(F.col("action") == "relabel", F.col("new_label")).otherwise(F.col(label))).drop("action", "new_label")
    log = both.where("action IS NOT NULL").select(key, "action", F.col(label).alias("old_label"), F.when(F.col("action") == "relabel", F.col("new_label")).alias("new_label"))
    return kept, log


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one table only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def require_empty(df: DataFrame, message: str, most: int = 5) -> None:
    """Raises with a few rows if there are any."""
    rows = df.limit(most).collect()
    if rows:
        raise ValueError(f"{message}: {[r.asDict() for r in rows]}")


def dependency_violations(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): keys with several values."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values")).where(F.size("values") > 1)
