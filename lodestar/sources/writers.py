"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _not_empty(df: DataFrame, path: str) -> None:
    if df.isEmpty():
        raise ValueError(f"no rows for {path}")


def csv_file(df: DataFrame, path: str, columns: Sequence[str] | None = None, allow_empty: bool = False) -> None:
    """CSV with a header and columns in the given order; refuses an empty table unless allowed."""
    if not allow_empty:
        _not_empty(df, path)
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def by_split(df: DataFrame, path: str, split: str = "split", label: str | None = None) -> DataFrame:
    """Parquet folders by split (and label); returns the rows of each."""
    keys = [split, *([label] if label else [])]
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def replaced_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Overwrites only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def report(df: DataFrame) -> str:
    """The single row of ``df`` as a JSON document."""
    row = df.select(F.to_json(F.struct("*")).alias("j")).first()
    return row["j"] if row else "{}"


def _cell(column: str) -> Column:
    text = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def markdown_lines(df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """(value) the lines of the table as Markdown, head first, rows by ``order``; bars are escaped, line breaks become spaces."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(_cell, df.columns)), F.lit(" |"))
    heads = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    head = df.sparkSession.createDataFrame(list(enumerate(heads)), "_turn int, value string")
    rows = df.select(F.lit(2).alias("_turn"), line.alias("value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    both = head.unionByName(rows, allowMissingColumns=True)
    return both.orderBy("_turn", *[f"_o{i}" for i in range(len(order))]).select("value")


def markdown(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A table of any length as Markdown text; the lines are in order over the part files by name."""
    markdown_lines(df, order).write.mode("overwrite").text(path)
