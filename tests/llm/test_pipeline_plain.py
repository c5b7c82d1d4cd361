"""The whole pipeline over the small tables against plain Python, given what the quality stage keeps."""

import re

import pytest

import corpus_pipeline
from lodestar.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def first_copies(texts, size=5, percent=80):
    """The texts whose component has no smaller id."""
    sets = {}
    for d, text in texts.items():
        w = WORD.findall(text.translate(LOWER))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: t for d, t in texts.items() if find(d) == d}


def without_repeats(texts, window=13):
    """Words of windows that a smaller id has go, each with the white space after it; texts that lose all words go."""
    least, words = {}, {d: list(WORD.finditer(t)) for d, t in texts.items()}
    for d, found in words.items():
        for i in range(len(found) - window + 1):
            key = tuple(m.group() for m in found[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = {}
    for d, text in texts.items():
        found = words[d]
        gone = set()
        for i in range(len(found) - window + 1):
            if least[tuple(m.group() for m in found[i : i + window])] < d:
                gone |= set(range(i, i + window))
        if gone and len(gone) == len(found):
            continue
        ends = [m.start() for m in found[1:]] + [len(text)]
        lost = {k for i in gone for k in range(found[i].start(), ends[i])}
        out[d] = "".join(c for k, c in enumerate(text) if k not in lost)
    return out


def without_leaks(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = set()
    for text in items:
        w = word.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(g) for g in grams}
    kept = {}
    for d, text in texts.items():
        w = word.findall(text.translate(LOWER))
        if not any(tuple(w[i : i + n]) in grams for n in sizes for i in range(len(w) - n + 1)):
            kept[d] = text
    return kept


def test_run_equals_plain_stages(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    good = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, small).select("doc_id").collect()}
    assert 0 < len(good) < len(texts)
    left = first_copies({d: t for d, t in texts.items() if d in good})
    assert len(left) < len(good)
    cut = without_repeats(left)
    assert any(cut[d] != left[d] for d in cut)
    clean = without_leaks(cut, [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()])
    assert len(clean) < len(cut)
    library = tokenizers.Tokenizer.from_file(queries.vocabulary())
    library.no_truncation()
    library.no_padding()
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in clean.items()}
    rows = corpus_pipeline.run(spark, small).collect()
    got = {r.doc_id: [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)] for r in rows}
    assert got == want and len(rows) == len(want)
    assert all(r.n_tokens == len(want[r.doc_id]) for r in rows)
