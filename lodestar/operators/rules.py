"""Decisions, advice and fuzzy aliases from small rule tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import number_text, phrase_id, similarity

#: Actions that mean nothing without a value, and the action of an unsure decision (fixed values).
NEED_VALUE = ["SET_TARGET_SPEED", "HEIGHT_RESTRICTION", "WIDTH_RESTRICTION", "WEIGHT_RESTRICTION"]
UNSURE = "UNKNOWN_CAUTION"
#: Confidence from which a reader's text counts (fixed value).
READ_LEAST = 0.65
#: Advice by kind; the value stands for the braces.
ADVICE = {"speed": "Limit {} km/h ahead", "height": "Height limit {} m", "weight": "Weight limit {} t"}
#: By kind of parameter: the units that it may have and the range of its value (fixed values).
RANGES = {"speed": (["KM/H"], 5.0, 160.0), "height": (["M"], 0.5, 10.0), "width": (["M"], 0.5, 10.0), "weight": (["T"], 0.5, 100.0), "axle_weight": (["T"], 0.5, 100.0), "distance": (["M", "KM"], 1.0, 100_000.0)}


def decided(rows: DataFrame, catalogue: DataFrame, critical: float = 0.88, normal: float = 0.75) -> DataFrame:
    """``rows`` (label, confidence, read_value, read_unit, read_confidence) with action, severity, value and unit.

    The catalogue (label, base_action, severity, kind, default_value), a row
    for each label, gives the action. An unknown label, too little confidence
    for the label's severity, or no valid value where one is needed make it
    ``UNSURE``, of severity caution.
    """
    signs = catalogue.select("label", "base_action", F.col("severity").alias("sign_severity"), "kind", "default_value")
    both = rows.join(signs, "label", "left")
    read = F.coalesce("default_value", F.when(F.col("read_confidence") >= READ_LEAST, F.col("read_value")))
    both = both.withColumn("_p", valid_parameter(F.col("kind"), read, F.upper("read_unit")))
    least = F.when(F.col("sign_severity") == "critical", critical).otherwise(normal)
    unsure = F.col("base_action").isNull() | (F.col("confidence") < least) | (F.col("base_action").isin(NEED_VALUE) & F.col("_p").isNull())
    sure = lambda x: F.when(~unsure, x)
    done = both.withColumns({"action": F.coalesce(sure(F.col("base_action")), F.lit(UNSURE)), "severity": F.coalesce(sure(F.col("sign_severity")), F.lit("caution")), "value": sure(F.col("_p.value")), "unit": sure(F.col("_p.unit"))})
    return done.drop("base_action", "sign_severity", "kind", "default_value", "_p")


def needs_reading(category: Column, kind: Column) -> Column:
    """Whether a sign's text must be read: a text sign, or one with a parameter other than a direction."""
    return (category == "text") | ~kind.isin("none", "direction")


def advised(rows: DataFrame) -> DataFrame:
    """``rows`` (kind, value) with advice and phrase."""
    text = F.lit(None).cast("string")
    for kind, template in ADVICE.items():
        before, after = template.split("{}")
        text = F.when(F.col("kind") == kind, F.concat(F.lit(before), number_text(F.col("value")), F.lit(after))).otherwise(text)
    return rows.withColumns({"advice": text, "phrase": phrase_id(F.col("value"))})


def valid_parameter(kind: Column, value: Column, unit: Column) -> Column:
    """struct(value, unit) where the value fits its kind of parameter, else null: centimetres count as metres, a speed without unit is in KM/H, a time is taken as it is."""
    sized = kind.isin("height", "width") & (unit == "CM")
    value, unit = F.when(sized, value / 100.0).otherwise(value), F.when(sized, "M").otherwise(F.coalesce(unit, F.when(kind == "speed", "KM/H")))
    pair = F.struct(value.cast("double").alias("value"), unit.alias("unit"))
    out = F.when((kind == "time") & value.isNotNull(), pair)
    for name, (units, low, high) in RANGES.items():
        out = out.when((kind == name) & unit.isin(units) & value.between(low, high), pair)
    return out


def resolved(seen: Column, seen_confidence: Column, seen_known: Column, read: Column, read_confidence: Column, read_known: Column) -> Column:
    """struct(label, confidence) from a classifier and a reader, each with whether the catalogue has its label.

    A known class stays; a sure and known reading that agrees raises its
    confidence; it stands alone only where the class is unknown.
    """
    pick = lambda label, sure: F.struct(label.alias("label"), sure.cast("double").alias("confidence"))
    known, sure = F.coalesce(seen_known, F.lit(False)), F.coalesce(read_known & (read_confidence >= READ_LEAST), F.lit(False))
    both = F.least(F.lit(1.0), 0.65 * seen_confidence + 0.35 * read_confidence + 0.10)
    return F.when(~known & sure, pick(read, read_confidence)).when(~known, pick(F.lit("unknown_sign"), seen_confidence)).when(sure & (seen == read), pick(seen, both)).otherwise(pick(seen, seen_confidence))


def compact(text: Column) -> Column:
    """Letters and digits only, in lower case: what aliases are compared by."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


@dataclass(frozen=True)
class Likeness:
    """A score of two strings in [0, 1] and what a score of at least t says about strings of n and m characters.

    ``shortest``: the least m. ``letters`` and ``pairs``: the least numbers of
    letters and of neighbouring pairs of letters, repeats counted, that both share.
    """

    score: Callable[[Column, Column], Column]
    shortest: Callable[[Column, float], Column]
    letters: Callable[[Column, Column, float], Column]
    pairs: Callable[[Column, Column, float], Column]


#: 2 M / (n + m) of the Ratcliff-Obershelp matches M. At most n + m - 2 M letters are not matched; each of the longer string breaks two pairs at most, each of the other one.
RATIO = Likeness(
    similarity,
    lambda n, t: F.ceil(n * t / (2 - t) - 1e-6),
    lambda n, m, t: F.ceil((n + m) * t / 2 - 1e-6),
    lambda n, m, t: F.floor(F.greatest(n, m) - 1 - 1.5 * (1 - t) * (n + m) - 0.5 * F.abs(n - m) + 1e-6),
)
#: 1 - edit distance / longer length. Each edit breaks two pairs of the longer string at most.
EDITS = Likeness(
    lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)),
    lambda n, t: F.ceil(n * t - 1e-6),
    lambda n, m, t: F.ceil(F.greatest(n, m) * t - 1e-6),
    lambda n, m, t: F.floor(F.greatest(n, m) * (1 - 2 * (1 - t)) - 1 + 1e-6),
)
#: Buckets of the letters and pairs that are counted to order them, rare first: a table of fixed size.
GRAM_BUCKETS = 1024


def _grams(text: Column, size: int) -> Column:
    """The runs of ``size`` letters, each with how often it came before."""
    letters = F.split(text, "")
    letters = F.filter(letters, lambda x: x != "")
    n = F.size(letters) - size + 1
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(letters, i, size), ""))).otherwise(F.array().cast("array<string>"))
    return F.transform(runs, lambda x, i: F.concat(F.lit(f"{size}:"), x, F.lit(":"), F.size(F.filter(F.slice(runs, F.lit(1), i), lambda y: y == x)).cast("string")))


def _prefixes(rows: DataFrame, text: str, like: Likeness, t: float, counts: list[int], both: bool) -> DataFrame:
    """``rows`` with ``gram``: the rare letters or pairs of which a partner must share one; ``both``: letters and pairs, else pairs where they say something, else letters."""
    n = F.length(text)
    short = like.shortest(n, t)
    long = F.floor(n * n / F.greatest(F.lit(1), like.shortest(n, t)) + 1)  # lengths that n itself is long enough for
    least = lambda f: F.least(f(n, short, t), f(n, n, t), f(n, long, t))
    bucket = lambda g: F.get(F.lit(counts), F.pmod(F.xxhash64(g), F.lit(GRAM_BUCKETS)).cast("int"))

    def prefix(size: int, shared: Column) -> Column:
        ordered = F.array_sort(F.transform(_grams(F.col(text), size), lambda g: F.struct(bucket(g).alias("n"), g.alias("g"))))
        return F.transform(F.slice(ordered, F.lit(1), F.greatest(F.lit(0), F.size(ordered) - F.greatest(shared, F.lit(1)) + 1).cast("int")), lambda x: x["g"])

    pairs, letters = prefix(2, least(like.pairs)), prefix(1, least(like.letters))
    chosen = F.concat(pairs, letters) if both else F.when(least(like.pairs) >= 1, pairs).otherwise(letters)
    return rows.withColumn("gram", F.explode(chosen))


def alias_candidates(said: DataFrame, text: str, catalogue: DataFrame, like: Likeness, t: float) -> DataFrame:
    """Distinct (``text``, alias) that may score ``t``: all that do, and some others.

    Both sides send the rarest of their letters or pairs, as many as leave out
    fewer than a partner must share, and meet on one of them; lengths that rule the score out go.
    """
    texts, aliases = said.select(text).distinct(), catalogue.select("alias").distinct()
    grams = aliases.select(F.explode(F.concat(_grams(F.col("alias"), 1), _grams(F.col("alias"), 2))).alias("g"))
    counted = grams.groupBy(F.pmod(F.xxhash64("g"), F.lit(GRAM_BUCKETS)).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()
    counts = [0] * GRAM_BUCKETS
    for row in counted:
        counts[row["b"]] = row["n"]
    left, right = _prefixes(texts, text, like, t, counts, False), _prefixes(aliases, "alias", like, t, counts, True)
    n, m = F.length(text), F.length("alias")
    fits = F.least(n, m) >= like.shortest(F.greatest(n, m), t)
    return left.join(right, "gram").where(fits).select(text, "alias").distinct()


def best_alias(said: DataFrame, key: str, text: str, catalogue: DataFrame, entry: str, like: Likeness, least: float, margin: float, shortest: int = 1) -> DataFrame:
    """(key, entry, score): the best entry of each text of ``shortest`` characters or more, if it scores ``least`` and leads the second by ``margin``; ties to the least entry.

    A second entry counts from ``least`` - ``margin`` on, so only pairs that may
    score that are looked for, in an index of letters and pairs of them. Null
    and empty texts have no entry.
    """
    rows = said.select(key, text).where(F.length(text) >= max(1, shortest))
    pairs = alias_candidates(rows, text, catalogue.where(F.length("alias") > 0), like, least - margin - 1e-9)
    # each pair of strings is scored once
    scores = pairs.withColumn("score", like.score(F.col(text), F.col("alias"))).where(F.col("score") >= least - margin - 1e-9)
    entries = scores.join(catalogue.select(entry, "alias"), "alias").groupBy(text, entry).agg(F.max("score").alias("score"))
    w = W.partitionBy(text).orderBy(F.desc("score"), entry)
    ranked = entries.withColumns({"_rn": F.row_number().over(w), "_next": F.lead("score").over(w)})
    best = ranked.where((F.col("_rn") == 1) & (F.col("score") >= least) & (F.coalesce(F.col("score") - F.col("_next"), F.lit(1.0)) >= margin)).drop("_rn", "_next")
    return rows.join(best, text).select(key, entry, "score")
