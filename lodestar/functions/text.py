"""Text columns."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def slug(text: Column, default: str = "item", limit: int = 64) -> Column:
    """Lower-case ASCII letters and digits, other runs as one underscore, none at the ends."""
    ascii_only = F.regexp_replace(F.lower(text), r"[^\x00-\x7F]", "")
    parts = F.regexp_replace(F.regexp_replace(ascii_only, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(parts, 1, limit), F.lit("")), F.lit(default))


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC, which no built-in function has."""
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def plain(text: Column) -> Column:
    """Dashes folded to ``-``, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[‐‑‒–—−]", "-"), r"\s+", " "))


#: A number with an optional decimal part and a unit (fixed values: the units).
_MEASURE = r"(?i)(\d+(?:[.,]\d+)?)\s*(KM/H|KMH|KPH|KMJ|KM|CM|TON|TAN|T|M)\b"


def measure(text: Column) -> Column:
    """struct(value, unit) of the first number with a unit; null if there is none."""
    unit = F.upper(F.regexp_extract(text, _MEASURE, 2))
    known = F.when(unit.isin("KPH", "KMJ"), "KM/H").when(unit.isin("TON", "TAN"), "T").otherwise(unit)
    value = F.regexp_replace(F.regexp_extract(text, _MEASURE, 1), ",", ".")
    return F.when(unit != "", F.struct(F.try_to_number(value, F.lit("999999.999")).cast("double").alias("value"), known.alias("unit")))


def script_of(text: Column) -> Column:
    """cjk, latin, mixed, digit or unknown, by the characters present."""
    cjk, latin, digit = F.rlike(text, F.lit(r"[\x{3400}-\x{9FFF}]")), F.rlike(text, F.lit("[A-Za-z]")), F.rlike(text, F.lit("[0-9]"))
    return F.when(cjk & latin, "mixed").when(cjk, "cjk").when(latin, "latin").when(digit, "digit").otherwise("unknown")


def character_error_rate(told: Column, truth: Column) -> Column:
    """Edit distance of the plain lower-case texts over the truth's length, at least 1."""
    a, b = F.lower(plain(told)), F.lower(plain(truth))
    return F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(b))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which no built-in function has."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


#: The entities that strip_html resolves (fixed values).
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def strip_html(html: Column) -> Column:
    """Tags as spaces, common entities resolved, white space collapsed."""
    text = F.regexp_replace(html, r"<[^>]+>", " ")
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def number_text(value: Column) -> Column:
    """50 for 50.0, 4.5 for 4.50."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.3f", value), r"\.?0+$", ""))


def phrase_id(value: Column) -> Column:
    return F.replace(number_text(value), F.lit("."), F.lit("_"))


def title_of_code(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def stem(path: Column) -> Column:
    """A path's last part without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def base_variant(name: Column) -> Column:
    """An export's name before its ``.rf.`` hash."""
    return F.substring_index(name, ".rf.", 1)
