"""Toxic spans by a linear-chain conditional random field over words.

Fitting uses a bounded sample of labelled documents (``SAMPLE``, drawn by the
hash of their ids). One half gives the evidence of words and word beginnings
(documents with and without the label that hold them); on the other half the
words of strong evidence in labelled documents are the labelled tokens, and
the field (a weight for each evidence class, transition weights) is fitted to
windows around them by the gradient of the conditional likelihood. A logistic
curve over the marginals of whole documents gives the document score.

Scoring is a map over whole texts: forward and backward recursions run over
the words with evidence, and stretches of words without any are crossed by a
closed-form power of their transition matrix, so the marginals are exact.

Defined cases: null, empty and blank texts have no words and get the curve's
lowest score; rows stay as they are, repeated or null ids included; without
labelled rows of both kinds the evidence is empty and the score is the rate of
the label (0 without labels); an empty input gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import bounded_batches, written

#: Labelled documents that the model is fitted on at most.
SAMPLE = 24_000
#: Words and beginnings that the model keeps at most.
VOCABULARY = 60_000
#: Lengths of the word beginnings that give evidence.
BEGINNINGS = range(4, 10)
#: Least evidence (log odds, less its uncertainty) of each class above 0, and the class of a labelled token.
CLASSES = (1.0, 1.75, 2.5, 3.25, 4.0)
LABELLED = 3
WINDOW = 64
#: Words that a worker remembers.
MEMORY = 150_000
THRESHOLD = 0.3

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[str]:
    """The word with its end marked, and its beginnings; lower case, without marks around it."""
    bare = _EDGE.sub("", word.lower())
    return [bare + "$", *(bare[:n] for n in BEGINNINGS if n < len(bare))] if len(bare) > 2 else []


@dataclass
class Model:
    """Everything that scoring needs; bounded by VOCABULARY."""

    evidence: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(CLASSES) + 1))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def prepared(self) -> Model:
        self.known = _Classes(self.evidence)
        self.steps = [np.exp(self.moves + np.array([0.0, w])) for w in self.weights]
        (a, b), (c, d) = self.steps[0]
        mean, root = (a + d) / 2, math.sqrt((a - d) ** 2 / 4 + b * c)
        high, low = mean + root, mean - root
        whole, unit = self.steps[0], np.eye(2)
        self.ratio = low / high
        self.lasting, self.fading = ((whole - low * unit) / (high - low)).tolist(), ((high * unit - whole) / (high - low)).tolist()
        self.lists = [s.tolist() for s in self.steps]
        return self

    def classes(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MEMORY:
            self.known.clear()
        return np.frombuffer(bytes(map(self.known.__getitem__, words)), np.uint8)

    def power(self, n: int) -> tuple[float, float, float, float]:
        """The neutral step n times, up to a factor."""
        r = self.ratio**n
        (a, b), (c, d) = self.lasting
        (e, f), (g, h) = self.fading
        return a + r * e, b + r * f, c + r * g, d + r * h

    def marginals(self, classes: np.ndarray) -> tuple[list[int], list[float]]:
        """(positions, probabilities of being toxic) of the words with evidence."""
        at = np.flatnonzero(classes).tolist()
        if not at:
            return [], []
        kinds = classes[at].tolist()
        x, y, last, ahead = 1.0, 0.0, -1, []
        for i, kind in zip(at, kinds, strict=True):
            a, b, c, d = self.power(i - last - 1)
            x, y = x * a + y * c, x * b + y * d
            (a, b), (c, d) = self.lists[kind]
            x, y = x * a + y * c, x * b + y * d
            total = x + y
            x, y, last = x / total, y / total, i
            ahead.append((x, y))
        out, x, y, last = [0.0] * len(at), 1.0, 1.0, len(classes)
        for j in range(len(at) - 1, -1, -1):
            a, b, c, d = self.power(last - at[j] - 1)
            x, y = a * x + b * y, c * x + d * y
            p, q = ahead[j][0] * x, ahead[j][1] * y
            out[j] = q / (p + q)
            (a, b), (c, d) = self.lists[kinds[j]]
            x, y = a * x + b * y, c * x + d * y
            total = x + y
            x, y, last = x / total, y / total, at[j]
        return at, out

    def summary(self, p: list[float]) -> tuple[float, float]:
        """What the curve looks at: the greatest marginal and the log of the expected number of toxic words."""
        return (max(p), math.log1p(sum(p))) if p else (0.0, 0.0)

    def score(self, p: list[float]) -> float:
        most, many = self.summary(p)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * most + c * many))))


class _Classes(dict):
    """The evidence class by word as it stands in a text."""

    def __init__(self, evidence: dict[str, int]) -> None:
        super().__init__()
        self.evidence = evidence

    def __missing__(self, word: str) -> int:
        get = self.evidence.get
        found = self[word] = max([get(f, 0) for f in features(word)], default=0)
        return found


def held_out(key: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, toxic, half) of at most ``size`` labelled documents; the drawn ids, bounded by ``size``, are broadcast."""
    drawn = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    joined = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return written(joined.select("text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")), "toxicity-sample")


def _evidence(sample: DataFrame) -> dict[str, int]:
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[label].update({f for w in set((text or "").split()) for f in features(w)})
            names = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())], ["feature", "t", "c"])

    rows = sample.select("text", "toxic").mapInArrow(run, "feature string, t bigint, c bigint").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    sure = F.log(t / (toxic + 1)) - F.log(c / (clean + 1)) - 0.7 * F.sqrt(1 / t + 1 / c)
    kept = rows.where("t >= 3").withColumn("sure", sure).where(F.col("sure") >= CLASSES[0]).orderBy(F.desc("sure"), "feature").limit(VOCABULARY)
    return {r["feature"]: sum(r["sure"] >= x for x in CLASSES) for r in kept.select("feature", "sure").collect()}


def _windows(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(classes, labels) of windows of WINDOW words, -1 beyond a text's end: two of each document at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepared()
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                classes = model.classes((text or "").split())
                strong = classes >= LABELLED
                if label and not strong.any():
                    continue
                first = int(np.argmax(strong if label else classes > 0)) if len(classes) else 0
                for begin in {max(0, first - WINDOW // 2), max(0, first - WINDOW // 4)}:
                    part = classes[begin : begin + WINDOW].astype(np.int8)
                    told = ((part >= LABELLED) & bool(label)).astype(np.int8)
                    pad = WINDOW - len(part)
                    out.append((np.pad(part, (0, pad), constant_values=-1).tobytes(), np.pad(told, (0, pad)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["classes", "labels"])

    rows = sample.select("text", "toxic").mapInArrow(run, "classes binary, labels binary").collect()
    return tuple(np.frombuffer(b"".join(bytes(r[i]) for r in rows), np.int8).reshape(-1, WINDOW).astype(np.int64) for i in range(2))


def _fit_field(model: Model, classes: np.ndarray, labels: np.ndarray, rounds: int = 200) -> None:
    """Gradient ascent (Adam) on the conditional log-likelihood of the windows' labels."""
    n, length = classes.shape
    valid = classes >= 0
    kinds = np.where(valid, classes, 0)
    size = len(CLASSES) + 1
    theta = np.concatenate([np.linspace(-3, 2, size), np.zeros(4)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    before = np.concatenate([np.zeros((n, 1), np.int64), labels[:, :-1]], axis=1)
    truth = np.zeros_like(theta)
    np.add.at(truth, kinds[valid & (labels == 1)], 1)
    np.add.at(truth, size + (before * 2 + labels)[valid], 1)
    for turn in range(1, rounds + 1):
        weights, moves = theta[:size], theta[size:].reshape(2, 2)
        step = np.exp(moves[None, None] + np.stack([np.zeros(kinds.shape), weights[kinds]], -1)[:, :, None, :])
        step = np.where(valid[:, :, None, None], step, np.eye(2))
        ahead, back = np.zeros((length + 1, n, 2)), np.ones((length + 1, n, 2))
        ahead[0, :, 0] = 1
        for t in range(length):
            x = np.einsum("ni,nij->nj", ahead[t], step[:, t])
            ahead[t + 1] = x / x.sum(1, keepdims=True)
        for t in range(length - 1, -1, -1):
            x = np.einsum("nij,nj->ni", step[:, t], back[t + 1])
            back[t] = x / x.sum(1, keepdims=True)
        pairs = ahead[:-1].transpose(1, 0, 2)[:, :, :, None] * step * back[1:].transpose(1, 0, 2)[:, :, None, :]
        pairs /= pairs.sum((2, 3), keepdims=True)
        expected = np.zeros_like(theta)
        np.add.at(expected, kinds[valid], pairs.sum(2)[:, :, 1][valid])
        expected[size:] = pairs[valid].sum(0).reshape(4)
        slope = (truth - expected) / n - 0.001 * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + 0.1 * first / (1 - 0.9**turn) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    model.weights, model.moves = theta[:size], theta[size:].reshape(2, 2)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps; x has a column of ones first."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """A model from at most ``size`` labelled rows, none of them held out."""
    bounded_batches(docs.sparkSession)
    sample = _sample(docs, labels, size)
    model = Model(_evidence(sample.where("half = 0")))
    rest = sample.where("half = 1")
    if not model.evidence:
        rate = sample.agg(F.avg("toxic")).first()[0] or 0.0
        model.curve = (math.log(rate / (1 - rate)) if 0 < rate < 1 else (30.0 if rate else -30.0), 0.0, 0.0)
        return model
    classes, told = _windows(rest, model)
    if len(classes):
        _fit_field(model, classes, told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.prepared()
        for batch in batches:
            found = [model.summary(model.marginals(model.classes((t or "").split()))[1]) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in found], pa.float64()), pa.array([s for _, s in found], pa.float64()), batch.column("toxic")], ["most", "many", "toxic"])

    rows = np.array([tuple(r) for r in rest.select("text", F.col("toxic").cast("double").alias("toxic")).mapInArrow(run, "most double, many double, toxic double").collect()]).reshape(-1, 3)
    rows = rows[np.lexsort(rows.T)]
    if len(rows):
        model.curve = tuple(fit_curve(np.column_stack([np.ones(len(rows)), rows[:, :2]]), rows[:, 2]).tolist())
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted, spans) for each row; spans: offset, length and marginal of the words likelier toxic than not."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.evidence, model.weights, model.moves, model.curve))
    word = re.compile(r"\S+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(*held.value).prepared()
        spans_type = pa.list_(pa.struct([("offset", pa.int32()), ("length", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            scores, spans = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                at, p = ready.marginals(ready.classes(text.split()))
                scores.append(ready.score(p))
                bad = {i: q for i, q in zip(at, p, strict=True) if q >= 0.5}
                found = []
                if bad:
                    found = [{"offset": m.start(), "length": m.end() - m.start(), "marginal": bad[i]} for i, m in enumerate(word.finditer(text)) if i in bad]
                spans.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(spans, spans_type)], [key, "score", "predicted", "spans"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int, spans array<struct<offset: int, length: int, marginal: double>>"
    return docs.select(key, "text").mapInArrow(run, schema)
