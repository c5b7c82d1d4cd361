"""Line-first cleaning, in DataFrame functions only: a map without any shuffle.

Every line is judged by itself: punctuation (runs of symbols or exclamation
marks, or a longer line without any sentence mark), navigation (items between
separators) and boilerplate phrases. Failing lines are removed; a document that
loses more than ``MOST_LOST`` percent of its word characters is rejected, as is
one that fails the base rules (too few words, or too many in repeated windows).

Defined cases: a null text has no words and no lines and is rejected as too
short; lines without a word are neither kept nor counted as lost; rows stay as
they are, repeated ids included; an empty input gives no rows; extra columns
are left alone. Time grows with the text's length, but for sorting its windows,
also in a text of one line or one unbroken word; a text is held whole by its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 20
#: Words of the windows whose repetition counts, and the percent of words in repeated ones that is too many.
REPEAT_WINDOW = 8
MOST_REPEATED = 30
#: Percent of a document's word characters that removed lines may hold.
MOST_LOST = 50

_BLANKS = r"[\x20\x09-\x0D]+"
_BLANK_CHARACTERS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"

#: Rules that fail a line, by name: a pattern anywhere in the line.
LINE_RULES = {
    "navigation": r"(\|[^|]*){3}|([»›•·>][^»›•·>]*){4}",
    "boilerplate": r"(?i)all rights reserved|cookie policy|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|click here|sign up (now|for)|subscribe (now|to our)|powered by|skip to (main )?content|share (this|on)|back to top",
    "punctuation": r"([#*$%&<>]{2,}[^#*$%&<>]+){4}|([!?]{2,}[^!?]+){4}",
}
#: A longer line without any of these is no sentence.
SENTENCE_MARK = r"[.!?:;…。！？]"
LONG_LINE = 12


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _count(text: Column, characters: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def line_fails(line: Column) -> Column:
    """True if some rule fails the line: ``LINE_RULES`` in forms whose time grows with the line's length only.

    Separators are counted; runs of symbols are tried from their first symbol
    on and never given back (possessive), words are counted by splitting.
    """
    navigation = (_count(line, "|") >= 3) | (_count(line, "»›•·>") >= 4)
    runs = lambda kind: F.rlike(line, F.lit(rf"(?<![{kind}])(?:[{kind}]{{2,}}+[^{kind}]++){{4}}"))
    no_sentence = ~F.rlike(line, F.lit(SENTENCE_MARK)) & (F.size(F.split(F.trim(line, F.lit(_BLANK_CHARACTERS)), _BLANKS)) >= LONG_LINE)
    return navigation | F.rlike(line, F.lit(LINE_RULES["boilerplate"])) | runs("#*$%&<>") | runs("!?") | no_sentence


def _window_hashes(words: Column, size: int) -> Column:
    n = F.size(words) - size + 1
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep..., text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, clean_text, lost_chars) for each row."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.trim(text, F.lit(_BLANK_CHARACTERS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    cut = docs.select(*keep, text.alias("text"), words.alias("words"), lines.alias("lines"))
    hashed = cut.select(
        *keep, "text", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "lines", F.transform("lines", line_fails).alias("fails"), _window_hashes(F.col("words"), REPEAT_WINDOW).alias("hashes"),
    )
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = hashed.select(
        *keep, "text", "n_words", "word_chars",
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array_join(F.filter("lines", lambda line, i: ~F.get("fails", i)), "\n").alias("clean_text"),
        F.length(_without(F.array_join(F.filter("lines", lambda line, i: F.get("fails", i)), ""), _BLANKS)).cast("long").alias("lost_chars"),
        ordered.alias("ordered"),
    )
    again = F.filter("ordered", lambda x, k: (x["h"] == F.get("ordered", k - 1)["h"]) | (x["h"] == F.get("ordered", k + 1)["h"]))
    placed = counted.withColumn("places", F.sort_array(F.transform(again, lambda x: x["i"])))
    steps = F.transform("places", lambda p, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(REPEAT_WINDOW))))
    return placed.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long")).drop("ordered", "places")


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """``measured`` with base_failed and kept."""
    rows = measured(docs, *keep)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
