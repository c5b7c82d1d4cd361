"""Benchmark decontamination by winnowing, in DataFrame functions only.

Each document keeps the least hash of every ``GUARD`` consecutive ``GRAM``-word
runs (GRAM + GUARD - 1 = WINDOW words) with its position, so any shared span of
WINDOW words leaves a common fingerprint in the document and in the item, at
the same word. Fingerprints are joined, and their positions put the item's words
on a place in the document. Each such placing is extended both ways, word by
word, to the longest stretches that agree; those of WINDOW words or more are hits.
Items shorter than a window are one window each, placed by their longest word.

Defined cases: null or wordless texts have no words, no hits and no items;
rows keep their number, repeated and null ids included (rows are told apart by
id and text); items without an id count as one item, null in the list; extra
columns are left alone; an empty benchmark leaves all documents clean; a text of
any length is worked on whole, and its windows are rows only if a fingerprint was found.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import freed, written

WINDOW = 10
GRAM = 4
GUARD = WINDOW - GRAM + 1
#: Rows of an item's fingerprints (24 bytes each) that may be broadcast; beyond, the same join shuffles both sides.
BROADCAST_ROWS = 500_000

#: Everything below 0x80 but digits and small letters.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """A-Z lower-cased, cut at everything but letters, digits and characters from 0x80 on."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), _SEPARATORS)
    return F.filter(cut, lambda w: w != "")


def _runs(words: Column, size: int) -> Column:
    """Starts (from 1) of the runs of ``size`` words; none if there are fewer words."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    return F.transform(_runs(words, GRAM), lambda i: F.xxhash64(*[F.get(words, i + j - 1) for j in range(GRAM)]))


def _least(hashes: Column) -> Column:
    """The least of each GUARD consecutive hashes as (print, at), the first of equals, once each; at: the number (from 0) of the gram."""
    n = F.size(hashes) - GUARD + 1
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    least = F.transform(starts, lambda i: F.least(*[F.struct(F.get(hashes, i + j).alias("print"), (i + j).alias("at")) for j in range(GUARD)]))
    # places never go back, so that equal ones stand side by side
    once = lambda held: F.filter(held, lambda x, k: (k == 0) | (x["at"] != F.get(held, k - 1)["at"]))
    return F.flatten(F.transform(F.array(least), once))


def fingerprints(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., n_words, prints) for rows with ``text``; prints: array of (print, at)."""
    words = rows.select(*keep, words_of(F.col("text")).alias("words"))
    hashed = words.select(*keep, F.size("words").cast("long").alias("n_words"), _hashes(F.col("words")).alias("hashes"))
    return hashed.select(*keep, "n_words", _least(F.col("hashes")).alias("prints"))


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, a written table, as broadcast if its rows, all of numbers, are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _matching(words: Column, own: Column, least: Column) -> Column:
    """(first, past), from 0, of the longest stretches of ``least`` or more places at which the two arrays of words are equal."""
    n = F.least(F.size(words), F.size(own))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    breaks = F.concat(F.array(F.lit(-1)), F.filter(places, lambda i: F.get(words, i) != F.get(own, i)), F.array(n))
    stretches = F.transform(F.slice(breaks, F.lit(1), F.size(breaks) - 1), lambda x, k: F.struct((x + 1).alias("first"), F.get(breaks, k + 1).alias("past")))
    return F.filter(stretches, lambda r: r["past"] - r["first"] >= least)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, hits): base has key, doc_id, n_words for each row; hits has key, doc_id, first, past (from 1), item_id: the longest stretches of an item's words."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    base = written(fingerprints(keyed, "key", "doc_id"), "prints")

    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = written(items.withColumns({"item": F.monotonically_increasing_id(), "size": F.size("words")}), "items")
    whole = items.where(F.col("size") >= WINDOW)
    prints = whole.select("item", "size", F.explode(_least(_hashes(F.col("words")))).alias("p")).select("item", "size", "p.print", F.col("p.at").alias("item_at"))
    prints = written(prints, "item-prints")

    # a fingerprint that both have puts the item's words on a place in the document; fingerprints of one placing agree
    seen = base.select("key", "doc_id", F.explode("prints").alias("p")).select("key", "doc_id", "p.print", "p.at")
    placed = seen.join(_bounded(prints), "print").select("key", "doc_id", "item", "size", (F.col("at") - F.col("item_at")).alias("begin"))
    short = items.where(F.col("size") < WINDOW)
    if not short.isEmpty():
        placed = placed.unionByName(_short_places(keyed, short))
    placed = written(placed.distinct(), "places")
    freed(prints)

    # each placing is extended both ways: the document's words there against the item's
    place = F.struct("item", "size", "begin")
    by_document = placed.groupBy("key", "doc_id").agg(F.collect_set(place).alias("places")).withColumnsRenamed({"key": "k", "doc_id": "d"})
    texts = keyed.join(by_document, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).dropDuplicates(["key", "doc_id"])
    there = texts.select("key", "doc_id", words_of(F.col("text")).alias("text_words"), "places").select("key", "doc_id", "text_words", F.explode("places").alias("p"))
    # from the item's first word that lies in the text; a slice of the item's length only
    lost = F.greatest(F.lit(0), -F.col("p.begin"))
    part = F.slice("text_words", F.greatest(F.lit(0), F.col("p.begin")) + 1, F.col("p.size") - lost)
    parts = there.select("key", "doc_id", "p.item", "p.begin", lost.alias("lost"), part.alias("part"))
    told = parts.join(items.select("item", "item_id", "size", "words"), "item")
    own = F.slice("words", F.col("lost") + 1, F.col("size"))
    stretches = told.select("key", "doc_id", "item_id", (F.col("begin") + F.col("lost") + 1).alias("at"), F.explode(_matching(F.col("part"), own, F.least("size", F.lit(WINDOW)))).alias("s"))
    return base.select("key", "doc_id", "n_words"), stretches.select("key", "doc_id", (F.col("at") + F.col("s.first")).alias("first"), (F.col("at") + F.col("s.past")).alias("past"), "item_id")


def _short_places(keyed: DataFrame, short: DataFrame) -> DataFrame:
    """(key, doc_id, item, size, begin): where a document holds the longest word of an item shorter than a window."""
    longest = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("n"), w.alias("w"), i.alias("i"))))
    anchors = short.select("item", "size", longest["w"].alias("word"), longest["i"].alias("item_at"))
    words = keyed.select("key", "doc_id", F.posexplode(words_of(F.col("text"))).alias("at", "word"))
    return words.join(anchors, "word").select("key", "doc_id", "item", "size", (F.col("at") - F.col("item_at")).alias("begin"))


def spans_by_document(hits: DataFrame) -> DataFrame:
    """(key, doc_id, n_hit, items, spans): hits of a document merged, bounded by its length."""
    places = hits.groupBy("key", "doc_id", "first").agg(F.max("past").alias("past"), F.collect_set(F.struct("item_id")).alias("items"))
    rows = places.groupBy("key", "doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("items")))["item_id"].alias("items"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda x, y: F.struct(F.greatest(x["end"], y["past"]).alias("end"), (x["n"] + F.greatest(F.lit(0), y["past"] - F.greatest(x["end"], y["first"]))).alias("n")),
    )
    return rows.select("key", "doc_id", covered["n"].alias("n_hit"), "items", F.col("places").alias("spans"))


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (ids of the items that occur), spans, contaminated."""
    base, hits = contaminated_spans(docs, benchmark)
    found = spans_by_document(hits).withColumnsRenamed({"key": "k", "doc_id": "d"})
    done = base.join(found, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return done.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"), F.coalesce("spans", F.array().cast("array<struct<first:int,past:int>>")).alias("spans"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that share a window with the benchmark."""
    _, hits = contaminated_spans(docs, benchmark)
    bad = hits.select(F.col("key").alias("_hit_key"), F.col("doc_id").alias("_hit_id")).distinct()
    return docs.join(bad, (F.xxhash64("doc_id", "text") == F.col("_hit_key")) & F.col("doc_id").eqNullSafe(F.col("_hit_id")), "left_anti")
