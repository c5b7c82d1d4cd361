"""Deterministic splits of grouped rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.hashing import stable_fraction

SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}


def split_of(group: Column, seed: int | str) -> Column:
    """train, validation or test by the group's stable fraction."""
    at = stable_fraction(group, seed)
    return F.when(at < 0.70, "train").when(at < 0.85, "validation").otherwise("test")


def target_counts(total: Column) -> list[Column]:
    """Rows of each split: one row trains, of two one validates; else 15 % each for validation and test, halves to even, at least one, the rest to train."""
    share = F.greatest(F.lit(1), F.bround(total * 0.15)).cast("long")
    validation = F.when(total <= 1, 0).otherwise(F.when(total == 2, 1).otherwise(share)).cast("long")
    test = F.when(total <= 2, 0).otherwise(share).cast("long")
    return [(total - test - validation).alias("train"), validation.alias("validation"), test.alias("test")]


def leakage(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(key, splits): keys that stand in several splits, with the ordered list."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def stratified(rows: DataFrame, group: str, label: str, seed: int, shares: dict[str, float] | None = None) -> DataFrame:
    """(group, split): groups with rare labels first, each to the split whose counts then come closest to their targets.

    One rule at every size. Each choice depends on those before, so the groups
    pass in order through one task, a row a group, which keeps counts by split
    and label only; counting and totals run before that on all executors. A
    null group or label is one of its own.
    """
    shares = shares or SHARES
    counts = rows.groupBy(F.col(group).alias("g"), F.col(label).alias("x")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("x").alias("y")).agg(F.sum("n").alias("total"))
    with_totals = counts.join(totals, F.col("x").eqNullSafe(F.col("y")))
    # labels by number and not by value: any type of label will do
    labels = F.sort_array(F.collect_list(F.struct(F.xxhash64(F.col("x").isNull(), "x").alias("x"), "n", "total")))
    groups = with_totals.groupBy("g").agg(labels.alias("labels"), F.sum("n").alias("size"), F.min("total").alias("rarity"))
    groups = groups.withColumn("at", F.coalesce(stable_fraction(F.col("g"), seed), F.lit(0.0)))
    groups = groups.withColumn("ties", _ties(F.coalesce(F.col("g").cast("string"), F.lit("")), list(shares), seed))
    n_groups, total = counts.groupBy("g").agg(F.sum("n").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ordered = groups.repartition(1).sortWithinPartitions("rarity", F.desc(F.size("labels")), F.desc("size"), "at", "g")
    kind = dict(rows.dtypes)[group]

    def allot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled: dict[str, dict[int, int]] = {s: {} for s in shares}
        sizes = dict.fromkeys(shares, 0)
        left = n_groups
        for batch in batches:
            out = []
            for labels, size, ties in zip(*(batch.column(c).to_pylist() for c in ("labels", "size", "ties")), strict=True):
                tie = dict(zip(shares, ties, strict=True))
                empty = [s for s in shares if sizes[s] == 0]
                names = empty if empty and left <= len(empty) else list(shares)

                def cost(split: str, labels: list = labels, size: int = size) -> float:
                    goal = total * shares[split]
                    change = _gap(sizes[split] + size, goal) - _gap(sizes[split], goal)
                    for entry in labels:
                        have, goal = filled[split].get(entry["x"], 0), entry["total"] * shares[split]
                        change += (_gap(have + entry["n"], goal) - _gap(have, goal)) / entry["total"] ** 0.5
                    return change

                best = min(names, key=lambda s: (cost(s), tie[s], s))
                sizes[best] += size
                for entry in labels:
                    filled[best][entry["x"]] = filled[best].get(entry["x"], 0) + entry["n"]
                left -= 1
                out.append(best)
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(out, pa.string())], [group, "split"])

    return ordered.select("g", "labels", "size", "ties").mapInArrow(allot, f"`{group}` {kind}, split string")


def _ties(name: Column, splits: list[str], seed: int | str) -> Column:
    """The fractions that settle ties between splits, of ``name:split``."""
    return F.array(*[stable_fraction(F.concat(name, F.lit(f":{s}")), seed) for s in splits])


def _gap(have: float, goal: float) -> float:
    return ((have - goal) / max(goal, 1.0)) ** 2


def by_label(groups: DataFrame, label: str, group: str, size: str, seed: int) -> DataFrame:
    """(label, group, split) from a row (label, group, size) for each group: every label is allotted by itself.

    In hash order, the first groups seed train, validation and test, where
    those have a target; each other goes to a split under its target where the
    filled share is then least, ties by a fraction of label, group and split.
    A label's groups pass in order through one task, which keeps three counts.
    """
    types = dict(groups.dtypes)
    name = F.concat_ws(":", F.col(label).cast("string"), F.col(group).cast("string"))
    rows = groups.select(F.col(label).alias("x"), F.col(group).alias("g"), F.col(size).alias("n"), stable_fraction(name, seed).alias("at"), _ties(name, list(SHARES), seed).alias("ties"))
    totals = rows.groupBy(F.col("x").alias("y")).agg(F.sum("n").alias("total")).select("y", F.array(*target_counts(F.col("total"))).alias("goals"))
    ordered = rows.join(totals, F.col("x").eqNullSafe(F.col("y"))).repartition("x").sortWithinPartitions("x", "at", "g")

    def allot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, have, seeds = object(), {}, []
        for batch in batches:
            out = []
            for x, n, ties, counts in zip(*(batch.column(c).to_pylist() for c in ("x", "n", "ties", "goals")), strict=True):
                goals, tie = dict(zip(SHARES, counts, strict=True)), dict(zip(SHARES, ties, strict=True))
                allowed = [s for s in SHARES if goals[s] > 0]
                if x != now:
                    now, have, seeds = x, dict.fromkeys(SHARES, 0), list(allowed)
                if seeds:
                    best = seeds.pop(0)
                else:
                    best = min(allowed, key=lambda s: (have[s] >= goals[s], (have[s] + n) / goals[s], tie[s], s))
                have[best] += n
                out.append(best)
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("g"), pa.array(out, pa.string())], [label, group, "split"])

    return ordered.select("x", "g", "n", "ties", "goals").mapInArrow(allot, f"`{label}` {types[label]}, `{group}` {types[group]}, split string")
