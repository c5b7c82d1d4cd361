"""Predicates, gates and reviews: columns and tables that say why a row passes or not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import blank_to_null
from lodestar.operators.merges import first_reason, require_empty
from lodestar.operators.ranges import first_of_scan


def effective_group(source: Column, *names: Column) -> Column:
    """``source::name`` with the first name that is not blank; raises if all are."""
    found = F.coalesce(*[blank_to_null(n) for n in names])
    return F.when(found.isNotNull(), F.concat(source, F.lit("::"), found)).otherwise(F.raise_error(F.lit("a row has no group")))


def image_note(width: Column, height: Column, deviation: Column) -> Column:
    """ok for a large enough and not flat image, weak for a small one of strong contrast, else null."""
    least = F.least(width, height)
    return F.when((least >= 24) & (deviation >= 4), "ok").when((least >= 16) & (deviation >= 20), "weak")


def box_error(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The first of: negative, not positive, exceeds image; else null."""
    return first_reason([("negative", (x1 < 0) | (y1 < 0)), ("not positive", (x2 <= x1) | (y2 <= y1)), ("exceeds image", (x2 > width) | (y2 > height))])


#: Weights of the measures of a candidate and what its shape adds.
SCORE_WEIGHTS = {"solidity": 0.26, "extent": 0.20, "circularity": 0.18, "aspect": 0.12, "area": 0.09}
SHAPE_BONUS = {"circle": 0.15, "triangle": 0.15, "square_or_rectangle": 0.10, "octagon": 0.18, "other": 0.0}
#: The share of the image from which a candidate's area counts in full (fixed value).
FULL_AREA = 0.02


def shape_of(vertices: Column, circularity: Column, aspect: Column) -> Column:
    """The shape class by roundness, then by corners."""
    return F.when((circularity >= 0.76) & aspect.between(0.72, 1.38), "circle").when(vertices == 3, "triangle").when(vertices == 4, "square_or_rectangle").when(vertices.between(7, 10), "octagon").otherwise("other")


def candidate_score(area_ratio: Column, extent: Column, solidity: Column, circularity: Column, aspect: Column, shape: Column) -> Column:
    """A weighted sum of the measures and the shape's bonus, within [0, 1]."""
    measures = {
        "solidity": solidity, "extent": extent, "circularity": circularity,
        "aspect": F.greatest(F.lit(0.0), 1 - F.abs(F.log(F.greatest(aspect, F.lit(1e-6)))) / 2), "area": F.least(F.lit(1.0), area_ratio / FULL_AREA),
    }
    bonus = F.lit(0.0)
    for name, value in SHAPE_BONUS.items():
        bonus = F.when(shape == name, value).otherwise(bonus)
    total = bonus
    for name, weight in SCORE_WEIGHTS.items():
        total = total + weight * measures[name]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def plausible_candidate(area_ratio: Column, width: Column, height: Column, extent: Column, solidity: Column, limits: dict[str, float]) -> Column:
    """Whether a candidate's area, size, filling and aspect (either way) are within the limits."""
    aspect = width / F.greatest(F.lit(1), height)
    most = limits["max_aspect_ratio"]
    sized = area_ratio.between(limits["min_area_ratio"], limits["max_area_ratio"]) & (width >= limits["min_width"]) & (height >= limits["min_height"])
    return sized & (extent >= limits["min_extent"]) & (solidity >= limits["min_solidity"]) & (aspect <= most) & (aspect >= 1.0 / most)


def mined(rows: DataFrame, rules: DataFrame, on: Sequence[str], at: str, order: Sequence[str]) -> DataFrame:
    """Rows of each rule (on..., rule, least, most): value at least ``least``, the first ``most`` by (``at``, ``order``); the rule table is broadcast.

    Only the range of ``at`` where a rule's quota ends is sorted.
    """
    both = rows.join(F.broadcast(rules), list(on)).where("value >= least")
    return first_of_scan(both, ["rule"], at, order, F.col("most")).drop("least", "most")


def group_lists(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, rows): the rows of each trimmed lower-case key. Gathers a key's rows: for keys with few."""
    return rows.groupBy(F.lower(F.trim(key)).alias(key)).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))


def require_equal_keys(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises if a key stands in one table only."""
    from lodestar.operators.merges import one_sided

    require_empty(one_sided(left, right, key), f"{key} differs")


def reviewed(catalogue: DataFrame, decisions: DataFrame, key: str, allowed: Sequence[str]) -> DataFrame:
    """``catalogue`` with the status of the decisions (key, decision); an unknown key or decision raises before anything is returned."""
    require_empty(decisions.join(catalogue.select(key), key, "left_anti"), "unknown ids")
    require_empty(decisions.where(~F.col("decision").isin(*allowed)), "unknown decisions")
    return catalogue.join(decisions.select(key, "decision"), key, "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")


def near_value(expected: Column, values: Column, tolerance: float = 1.0) -> Column:
    """Whether some value lies within the tolerance; null without an expected value."""
    return F.when(expected.isNotNull(), F.exists(values, lambda v: F.abs(v - expected) <= tolerance))


def compact(items: Column, most: int = 5) -> Column:
    """``label:confidence`` of the first items, by semicolons."""
    return F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(x["label"], F.lit(":"), F.format_number(x["confidence"], 2))), ";")


def gate(value: Column, passing: float, partial: float) -> Column:
    return F.when(value >= passing, "pass").when(value >= partial, "partial").otherwise("fail")


def map_difference(a: Column, b: Column) -> Column:
    """The greatest difference over the keys of both maps; null without a common key."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.array_max(F.transform(common, lambda k: F.abs(F.element_at(a, k) - F.element_at(b, k))))


def updated_elements(items: Column, key: str, wanted: Column, field: str, value: Column) -> Column:
    """An array of structs with ``field`` replaced where ``key`` is wanted."""
    return F.transform(items, lambda x: F.when(x[key] == wanted, x.withField(field, value)).otherwise(x))


def zipped(*arrays: str) -> Column:
    """Arrays side by side; raises if their sizes differ."""
    sizes = F.array(*[F.size(a) for a in arrays])
    return F.when(F.array_min(sizes) == F.array_max(sizes), F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit("arrays differ in size")))


#: Fixed values of the control law for a local and a public link: bounds of the quality, latencies that slow down and speed up, drops that slow down.
CONTROL = {False: (0.38, 0.78, 180, 80, 4), True: (0.32, 0.72, 280, 160, 8)}


def next_control(quality: Column, interval: Column, latency_ms: Column, drops: Column, public: bool = False) -> list[Column]:
    """Quality and frame interval (ms) after a step: down by steps on drops or high latency, slowly up when all is well."""
    least, most, slow, fast, dropped = CONTROL[public]
    step = F.when((latency_ms > 220) | (drops > 6), F.greatest(F.lit(least), quality - 0.08)).when((latency_ms > 120) | (drops > 2), F.greatest(F.lit(least), quality - 0.04))
    better = step.when((latency_ms < 70) & (drops == 0), F.least(F.lit(most), quality + 0.015)).otherwise(quality)
    frames = F.when((latency_ms > slow) | (drops > dropped), 1000 / 30).when((latency_ms < fast) & (drops <= 2), 1000 / 60).otherwise(interval)
    return [better.alias("quality"), frames.alias("interval")]
