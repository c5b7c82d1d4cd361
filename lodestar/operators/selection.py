"""First-wins dedup, ranked and spread selection, generated ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Order = Sequence[Column]


def numbered(df: DataFrame, keys: Sequence[str | Column], order: Order, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def first_wins(df: DataFrame, keys: Sequence[str | Column], order: Order) -> DataFrame:
    """The first row of each key, by an explicit total order."""
    return numbered(df, keys, order, "_rn").where("_rn = 1").drop("_rn")


def duplicates(df: DataFrame, keys: Sequence[str | Column], order: Order) -> DataFrame:
    """The rows that ``first_wins`` drops."""
    return numbered(df, keys, order, "_rn").where("_rn > 1").drop("_rn")


def top_k(df: DataFrame, keys: Sequence[str | Column], order: Order, k: int | Column) -> DataFrame:
    return numbered(df, keys, order, "_rn").where(F.col("_rn") <= k).drop("_rn")


def top_k_by_hash(df: DataFrame, group: str, item: str, k: int, seed: int) -> DataFrame:
    """k rows of each group in the order of SHA-256 of ``seed:group:item``."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(item).cast("string")), 256)
    return top_k(df, [group], [digest, F.col(item)], k)


def diverse_top_k(df: DataFrame, group: str, key: str, order: Order, k: int) -> DataFrame:
    """k rows of each group: first one of each key in order, then the rest in order."""
    marked = numbered(df, [group, key], order, "_in_key").withColumn("_again", (F.col("_in_key") > 1).cast("int"))
    return top_k(marked, [group], [F.col("_again"), *order], k).drop("_in_key", "_again")


def _positions(df: DataFrame, group: str, order: Order) -> DataFrame:
    w = W.partitionBy(group)
    return df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})


def even_spread(df: DataFrame, group: str, order: Order, k: int) -> DataFrame:
    """Rows at round(i (n - 1) / (k - 1)), i < k, halves to even; the first row if k is 1, all rows if there are k at most."""
    if k <= 1:
        return top_k(df, [group], order, k)
    rows = _positions(df, group, order)
    # a position is hit if some i in 0..k-1 rounds to it
    near = F.floor(F.col("_i") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hits = F.exists(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i <= k - 1) & (F.bround(i * (F.col("_n") - 1) / F.lit(float(k - 1))) == F.col("_i")))
    return rows.where((F.col("_n") <= k) | hits).drop("_i", "_n")


def floor_spread(df: DataFrame, group: str, order: Order, k: int) -> DataFrame:
    """Rows at floor(i n / k), i < k; all rows if there are k at most."""
    rows = _positions(df, group, order)
    first = F.ceil(F.col("_i") * k / F.col("_n"))
    hits = (first < k) & (F.floor(first * F.col("_n") / F.lit(k)) == F.col("_i"))
    return rows.where((F.col("_n") <= k) | hits).drop("_i", "_n")


def spread_by_base(df: DataFrame, group: str, base: str, order: Order, k: int) -> DataFrame:
    """``floor_spread`` over one row of each base, or over all rows where a group has fewer than k bases."""
    rows = numbered(df, [group, base], order, "_in_base").withColumn("_bases", F.sum((F.col("_in_base") == 1).cast("int")).over(W.partitionBy(group)))
    pool = rows.where((F.col("_in_base") == 1) | (F.col("_bases") < k)).drop("_in_base", "_bases")
    return floor_spread(pool, group, order, k)


def spread_order(df: DataFrame, group: str, order: Order, k: int) -> DataFrame:
    """All rows with ``place``: the spread positions first, then the rest in order."""
    rows = _positions(df, group, order)
    first = F.ceil(F.col("_i") * k / F.col("_n"))
    preferred = (F.col("_n") <= k) | ((first < k) & (F.floor(first * F.col("_n") / F.lit(k)) == F.col("_i")))
    rows = rows.withColumn("_late", (~preferred).cast("int"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("_late", "_i"))).drop("_late", "_i", "_n")


def round_robin(df: DataFrame, group: str, order: Order, quota: int) -> DataFrame:
    """``quota`` rows of each group, its rows taken in turn again and again; ``turn`` counts from 0."""
    rows = _positions(df, group, order)
    turns = F.sequence(F.col("_i").cast("long"), F.lit(quota - 1).cast("long"), F.col("_n").cast("long"))
    return rows.where(F.col("_i") < quota).withColumn("turn", F.explode(turns)).drop("_i", "_n")


def with_ids(df: DataFrame, prefix: str, group: str, order: Order, digest: Column, width: int = 5) -> DataFrame:
    """``id`` = prefix, group, a running number within the group and ten digits of a digest."""
    number = F.lpad(F.row_number().over(W.partitionBy(group).orderBy(*order)).cast("string"), width, "0")
    return df.withColumn("id", F.concat_ws("_", F.lit(prefix), F.col(group).cast("string"), number, F.substring(digest, 1, 10)))


def row_offsets(df: DataFrame, group: str, part: str) -> DataFrame:
    """(group, part, n, offset): rows before each part within its group."""
    counts = df.groupBy(group, part).agg(F.count("*").alias("n"))
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def preferred_else(primary: DataFrame, secondary: DataFrame, key: str, order: Order, k: int) -> DataFrame:
    """The primary rows; for keys without any, the first k secondary rows."""
    rest = secondary.join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(top_k(rest, [key], order, k))
