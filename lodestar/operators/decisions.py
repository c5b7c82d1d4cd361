"""Gates, overrides, hand-overs and cooldowns over keyed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.merges import first_reason, require_empty
from lodestar.operators.selection import first_wins


def in_scope(priority: Column, scope: str) -> Column:
    """Whether a priority is in ``must`` (must only), ``other`` (all but must) or ``all``."""
    wanted = {"must": priority == "must", "other": priority != "must", "all": F.lit(True)}
    return F.coalesce(wanted[scope], F.lit(scope == "other"))


def may_announce(wanted: Column, safe: Column) -> Column:
    """An event is announced if it wants to and its advice is not marked unsafe; unmarked advice is safe."""
    return F.coalesce(wanted, F.lit(False)) & F.coalesce(safe, F.lit(True))


def admission(excluded: Column, status: Column, override: bool = False) -> Column:
    """Why a dataset may not be trained on, null if it may: it holds (or may hold) excluded rows, or is not approved without an override."""
    return first_reason([("excluded rows", F.coalesce(excluded, F.lit(-1)) != 0), ("not approved", (F.coalesce(status, F.lit("")) != "approved") & F.lit(not override))])


def first_of_sources(sources: Sequence[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of all sources, one for each key: of the first source that has it, there the first by ``order``."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    both = ranked[0]
    for df in ranked[1:]:
        both = both.unionByName(df)
    return first_wins(both, keys, [F.col("source_rank"), *order])


def shortages(rows: DataFrame, key: str, needed: int) -> DataFrame:
    """(key, n, needed): the keys with fewer than ``needed`` rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") < needed).withColumn("needed", F.lit(needed))


def require_enough(rows: DataFrame, key: str, needed: int) -> None:
    """Raises with the keys that have fewer than ``needed`` rows."""
    require_empty(shortages(rows, key, needed), "too few rows")


def require_split_input(rows: DataFrame, columns: Sequence[str], sample: str, shares: dict[str, float]) -> None:
    """Raises if columns are missing, sample ids repeat, or the shares are no fractions that sum to one."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    if any(not 0 < x < 1 for x in shares.values()) or abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError(f"shares must lie between 0 and 1 and sum to 1: {shares}")
    require_empty(rows.groupBy(sample).agg(F.count("*").alias("n")).where("n > 1"), "sample ids repeat")


def overridden(rows: DataFrame, overrides: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(log, unmatched): overrides (key, new_label) against ``rows`` (key, label).

    The log has the old and new label and ``already_correct`` or ``approved``;
    the caller writes it before it raises for unmatched overrides.
    """
    both = overrides.select(key, "new_label").join(rows.select(key, F.col(label).alias("old_label"), F.lit(True).alias("_hit")), key, "left")
    log = both.where("_hit").select(key, "old_label", "new_label", F.when(F.col("old_label").eqNullSafe(F.col("new_label")), "already_correct").otherwise("approved").alias("status"))
    return log, both.where("_hit IS NULL").select(key, "new_label")


def seeded(rows: DataFrame, key: str, rules: Sequence[tuple[Column, str, str]]) -> DataFrame:
    """(key, action, new_label) for the rows that a rule (condition, action, new label) fits; the first that fits decides."""
    pick = lambda i: first_reason([(rule[i], rule[0]) for rule in rules])
    return rows.select(key, pick(1).alias("action"), pick(2).alias("new_label")).where("action IS NOT NULL")


def resumed(declared: DataFrame, before: DataFrame, fresh: DataFrame, key: str, value: str) -> DataFrame:
    """``declared`` (key, place) with the value collected before, else the fresh one, and which of them it is; keys without either go."""
    old, new = (df.select(key, F.col(value).alias(name)) for df, name in ((before, "_old"), (fresh, "_new")))
    both = declared.join(old, key, "left").join(new, key, "left")
    kept = both.withColumns({value: F.coalesce("_old", "_new"), "origin": F.when(F.col("_old").isNotNull(), "kept").otherwise("fresh")})
    return kept.where(F.col(value).isNotNull()).drop("_old", "_new")


def back_filled(rows: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, status) with the reviewer's decision; an approved row without one counts as ``approve``, another as empty."""
    both = rows.join(decisions.select(key, F.nullif(F.trim("decision"), F.lit("")).alias("decision")), key, "left")
    return both.withColumn("decision", F.coalesce("decision", F.when(F.col("status") == "approved", "approve").otherwise("")))


#: Confidence from which a mapping is confirmed, and from which it is accepted (fixed values).
CONFIRMED, ACCEPTED = 0.95, 0.90


def evidence_status(override: Column, owner: Column, reference: Column, confidence: Column) -> Column:
    """How well a mapping is proven: the status of an override, else the owner's word, else a reference by its own mapping confidence (null: none), else bands of confidence."""
    seen = F.when(confidence >= CONFIRMED, "confirmed_visual_high_confidence").when(confidence >= ACCEPTED, "accepted_visual_medium_confidence").otherwise("needs_second_review")
    told = F.when(reference == "high", "confirmed_online_reference").when(reference.isNotNull(), "accepted_with_reference_caution")
    return F.coalesce(override, F.when(owner, "confirmed_owner_review"), told, seen)


#: How ids of collected pictures look, and of those made from one of them (fixed values).
_COLLECTED = r"(MAN01-[A-Z]+-\d{4})"
_MADE_FROM = "controlled_from_" + _COLLECTED


def _given(column: str) -> Column:
    return F.nullif(F.trim(F.coalesce(column, F.lit(""))), F.lit(""))


def _stem(name: Column) -> Column:
    """The file's name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def base_variant(label: str = "semantic_sign_id", name: str = "file_name") -> Column:
    """The group of a picture and its variants: the id that it was made from or has, else its page's URL, else its key, else its file's stem; each behind the label."""
    text = F.concat_ws(" ", name, F.coalesce("source_label", F.lit("")), F.coalesce("source_file_url", F.lit("")))
    found = lambda where, pattern: F.nullif(F.regexp_extract(where, pattern, 1), F.lit(""))
    key = F.coalesce(found(text, _MADE_FROM), found(F.col(name), _COLLECTED), _given("source_url"), _given("dedupe_key"), _stem(F.col(name)))
    return F.concat(F.col(label), F.lit("::"), key)


def leakage_group(label: str = "semantic_sign_id", name: str = "file_name") -> Column:
    """The group that must stay in one split: source group (``unknown`` if null), label, and the key, else the digest, else the file's stem."""
    return F.concat(F.coalesce("source_group", F.lit("unknown")), F.lit("::"), F.col(label), F.lit("::"), F.coalesce(_given("dedupe_key"), _given("crop_sha256"), _stem(F.col(name))))


def require_whole_groups(rows: DataFrame, group: str, split: str) -> None:
    """Raises if a group has rows of several splits, or there are no rows."""
    if rows.isEmpty():
        raise ValueError("no rows")
    require_empty(rows.groupBy(group).agg(F.min(split).alias("one"), F.max(split).alias("other")).where(~F.col("one").eqNullSafe(F.col("other"))), "groups in several splits")


def chosen_in_order(wanted: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """``catalogue`` rows of the wanted keys with their place; an unknown key raises before anything is returned."""
    require_empty(wanted.join(catalogue.select(key), key, "left_anti"), f"unknown {key}")
    return wanted.groupBy(key).agg(F.min("place").alias("place")).join(catalogue, key)
