"""Document quality by hierarchical empirical Bayes.

A logistic classifier on measures of the text gives each document's own
evidence. The same evidence, summed by host and by path below it in grouped
aggregates, gives each site's share of good documents; a site's share is
shrunk toward its host's and the host's toward the corpus share, the more the
fewer its documents: theta = (good + strength * prior) / (n + strength), the
strengths estimated from the spread of the shares (method of moments). A
document's posterior moves its evidence by the log odds of its path against
the corpus; its own evidence is left out of the shares that judge it.

The classifier is fitted on at most ``SAMPLE`` labelled rows; shares come from
all rows. Here ``source`` is the host and ``lang`` the path below it.

Defined cases: null and blank texts have no evidence of being good (their
measures are those of an empty text); a null host or path is a site of its
own; rows stay as they are, repeated or null ids included; without labelled
rows of both kinds every document has the share of good labels (1 without
labels) as its own evidence; an empty input gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrowtext import Words, chunks
from lodestar.llm.shared import bounded_batches, written
from lodestar.llm.toxicity import fit_curve

#: Labelled documents that the classifier is fitted on at most.
SAMPLE = 20_000
#: Rows of the table of sites that may be broadcast (under 100 bytes each).
BROADCAST_ROWS = 200_000
MICRO = 1_000_000
KEEP = 0.5

_CLASSES = {"symbol": b"#*$%&<>", "bar": b"|", "shout": b"!?", "stop": b".,;:", "digit": b"0123456789", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "line": b"\n", "wide": bytes(range(128, 256))}
MEASURES = [*_CLASSES, "words", "length", "distinct", "adjacent", "again"]


def _flags(values: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(values)] = 1
    return out


_TABLES = [_flags(v) for v in _CLASSES.values()]


def measures(column: pa.Array) -> np.ndarray:
    """A row of bounded numbers for each text: shares of character classes, and of words that recur."""
    words = Words(column)
    n_bytes = np.diff(words.offsets)
    share = lambda x, n: x / np.maximum(n, 1)

    def by_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[words.offsets[1:]] - sums[words.offsets[:-1]]

    out = [share(by_text(t[words.data]), n_bytes) for t in _TABLES]
    n = words.counts
    text = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words.hashes, text))
    a, t = words.hashes[order], text[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[fresh], minlength=len(n))
    same = np.zeros(len(a), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    adjacent = np.bincount(text[same], minlength=len(n))
    starts, grams = words.grams(8)
    of = text[starts] if len(starts) else starts
    order = np.lexsort((grams, of))
    g, o = grams[order], of[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    total = np.bincount(o, minlength=len(n))
    again = total - np.bincount(o[new], minlength=len(n))
    out += [np.log1p(n) / 10, share(share(n_bytes, n), 20), share(distinct, n), share(adjacent, n), share(again, total)]
    return np.column_stack(out)


def expanded(x: np.ndarray) -> np.ndarray:
    """The measures, their square roots (small shares matter) and a one."""
    return np.column_stack([np.ones(len(x)), x, np.sqrt(np.clip(x, 0, None))])


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """Weights of the classifier, from at most ``size`` labelled rows drawn by the hash of their ids."""
    drawn = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", F.col("quality").cast("double").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = measures(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), part.column("quality")], ["x", "y"])

    rows = joined.mapInArrow(run, "x array<double>, y double").collect()
    n = 2 * len(MEASURES) + 1
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return np.concatenate([[math.log(rate / (1 - rate))], np.zeros(n - 1)])
    x = np.array([r["x"] for r in rows])
    order = np.lexsort(np.column_stack([x, y]).T)
    return fit_curve(expanded(x[order]), y[order], ridge=0.1)


def evidence(weights: np.ndarray) -> object:
    """An Arrow UDF: text to log odds of being good, in millionths, within +-20."""

    @F.arrow_udf("bigint")
    def of(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        parts = [np.round(np.clip(expanded(measures(p.column("text"))) @ weights, -20, 20) * MICRO).astype(np.int64) for p in chunks(batch)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return of


def _moments(groups: DataFrame, good: str, prior: Column) -> float:
    """The strength of a prior: from the variance of the groups' shares around it, by size; between 1 and 10**6."""
    share = F.col(good) / F.col("n")
    row = groups.select(F.col("n"), (share - prior).alias("d"), (prior * (1 - prior)).alias("v")).agg(F.sum(F.col("n") * F.col("d") * F.col("d")).alias("spread"), F.sum("v").alias("chance"), F.sum(F.col("n") * F.col("v")).alias("all"), F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if not row["k"] or row["k"] < 2 or not row["all"]:
        return 100.0
    excess = (row["spread"] - row["chance"]) / max(row["all"] - row["chance"], 1e-9)
    return float(min(1e6, max(1.0, 1 / max(round(excess, 9), 1e-9) - 1)))


def site_shares(rows: DataFrame) -> tuple[DataFrame, float, float, float]:
    """((host, path, host_n, host_good, path_n, path_good), corpus share, strengths of the corpus for hosts and of hosts for paths) from rows (host, path, evidence); each sum is of whole numbers."""
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(_chance()).alias("good")), "sites")
    paths = paths.withColumn("good", F.col("good") / MICRO)
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = min(1 - 1e-6, max(1e-6, (total["good"] / total["n"]) if total["n"] else 0.5))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    strength = _moments(hosts, "good", F.lit(mean))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    both = paths.join(hosts, "host")
    below = _moments(both.withColumn("share", _shrunk("host_n", "host_good", F.lit(mean), strength)), "good", F.col("share"))
    return both.select("host", "path", "host_n", "host_good", F.col("n").alias("path_n"), F.col("good").alias("path_good")), mean, strength, below


def _chance() -> Column:
    """A document's own chance of being good, in whole millionths."""
    return F.round(MICRO / (1 + F.exp(-F.col("evidence") / MICRO))).cast("long")


def _shrunk(n: str | Column, good: str | Column, prior: Column, strength: float) -> Column:
    n, good = (F.col(x) if isinstance(x, str) else x for x in (n, good))
    return (good + strength * prior) / (n + strength)


def judged(docs: DataFrame, labels: DataFrame, kept: list[str], host: str = "source", path: str = "lang") -> DataFrame:
    """(row, host_share, path_share, evidence, posterior, good) for each row of ``docs``; row holds its columns ``kept``.

    The shares that judge a document are those of the other documents of its
    site: its own evidence counts once. Without texts among the kept columns
    evidence is written; with them it is worked out twice instead of writing
    all texts.
    """
    bounded_batches(docs.sparkSession)
    own = evidence(fit(docs, labels)).asNondeterministic()  # else a filter on it works it out a second time
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), own("text").alias("evidence"))
    if "text" not in kept:
        packed = written(packed, "evidence")
    sites, mean, strength, below = site_shares(packed)
    if sites.count() <= BROADCAST_ROWS:
        sites = F.broadcast(sites)
    mine = _chance() / MICRO
    # sums of millionths: a site of one document leaves nothing, not a rounding error
    others = lambda good: F.greatest(F.lit(0.0), F.round(F.col(good) - mine, 6))
    shares = packed.join(sites, ["host", "path"]).withColumn("host_share", _shrunk(F.col("host_n") - 1, others("host_good"), F.lit(mean), strength))
    shares = shares.withColumn("path_share", _shrunk(F.col("path_n") - 1, others("path_good"), F.col("host_share"), below))
    odds = F.log(F.col("path_share") / (1 - F.col("path_share"))) - math.log(mean / (1 - mean))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") / MICRO + odds)))
    done = shares.withColumn("posterior", posterior)
    return done.select("row", "host_share", "path_share", "evidence", "posterior", (F.col("posterior") >= KEEP).alias("good"))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, evidence, host_share, path_share, posterior, good) for each row."""
    done = judged(docs, labels, ["doc_id"])
    return done.select(F.col("row.doc_id").alias("doc_id"), (F.col("evidence") / MICRO).alias("evidence"), "host_share", "path_share", "posterior", "good")


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows judged bad."""
    return judged(docs, labels, docs.columns).where("good").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
