"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import periods, queries


def plain_runs(words):
    """(start, length, period) of all runs, from the definition."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(24, 3 * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def some_texts():
    rng = random.Random(13)
    for n in (0, 1, 23, 24, 25, 30, 48, 71, 72, 73, 100, 150, 200):
        for letters in ("a", "ab", "abc", "abcdefgh"):
            yield [rng.choice(letters) for _ in range(n)]
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
            run = (unit * (n // len(unit) + 1))[:n]
            yield run
            yield [rng.choice("xyz") for _ in range(rng.randrange(9))] + run + [rng.choice(letters) for _ in range(rng.randrange(40))] + run
    a, b = ["a"], ["a", "b"]
    while len(b) < 300:
        a, b = b, b + a
    yield b
    yield list("ab" * 12 + "ba" * 12 + "aab" * 9)


def test_runs_are_those_of_the_definition():
    texts = list(some_texts())
    ids = [np.array([ord(x) for x in t], np.int64) for t in texts]
    assert periods.text_runs(ids) == [plain_runs(t) for t in texts]
    assert sum(map(len, periods.text_runs(ids))) > 100


def test_lags_of_long_texts(monkeypatch):
    texts = list(some_texts())
    ids = [np.array([ord(x) for x in t], np.int64) for t in texts]
    for words in ids:
        lags = list(periods.likely_lags(words))
        assert lags == sorted(set(lags))
        assert {q for _, _, q in plain_runs(words.tolist())} <= set(lags)
    together = periods.text_runs(ids)
    monkeypatch.setattr(periods, "TOGETHER", 0)  # each text by itself, by its likely lags
    assert periods.text_runs(ids) == together


def test_a_very_long_text():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 50_000, 400_000)
    words[1000:31_000] = np.tile(words[1000:11_000], 3)
    words[200_000:200_030] = 7
    assert periods.text_runs([words])[0] == plain_ends(words, [(1000, 10_000), (200_000, 1)])


def plain_ends(words, seeds):
    """The runs around the given starts, extended both ways."""
    out = []
    for start, q in seeds:
        end = start + 3 * q
        while start and words[start - 1] == words[start - 1 + q]:
            start -= 1
        while end < len(words) and words[end] == words[end - q]:
            end += 1
        out.append((start, end - start, q))
    return out


def expected(doc_id, text):
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = plain_runs(words)
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(top or (None, None, None)), 1000 * top[1] // top[2] if top else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_whole_table(spark, small):
    """Every document of up to 1,500 words against the definition; the query runs over all."""
    told = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(told)
    checked = 0
    for row in rows:
        if len((told[row.doc_id] or "").split()) <= 1500:
            assert tuple(row)[1:] == expected(row.doc_id, told[row.doc_id]), row.doc_id
            checked += row.n_runs > 0
    assert checked > 5


def test_odd_documents(spark, odd_documents, no_documents):
    texts = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect() if len(r.text or "") < 5000]
    short = odd_documents.where("text is null or length(text) < 5000")
    found = periods.runs(periods.with_periods(short)).withColumn("top", periods.strongest(F.col("runs"))).collect()
    key = lambda x: repr(x)
    rows = sorted(((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in found), key=key)
    wanted = []
    for i, t in texts:
        words = planted(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        told = plain_runs(words)
        gone = {k for s, length, q in told for k in range(s + q, s + length)}
        wanted.append((i, len(words), tuple(told), " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert rows == sorted(wanted, key=key)
    assert any(r.top for r in found) and any(r.top is None for r in found)
    assert periods.runs(odd_documents).count() == odd_documents.count()
    assert periods.runs(no_documents).count() == 0


def test_words_are_told_apart_by_their_bytes(spark):
    """Thue-Morse words: polynomial hashes of them collide."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    frame = spark.createDataFrame([(1, " ".join([a, b] * 20)), (2, " ".join([a] * 40))], "doc_id long, text string")
    assert [[tuple(x) for x in r.runs] for r in periods.runs(frame).orderBy("doc_id").collect()] == [[(0, 40, 2)], [(0, 40, 1)]]
