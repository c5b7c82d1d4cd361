"""Substring dedup, n-gram join and decontamination against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, ngram_join, substrings
from lodestar.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_words(rows, window=13):
    least = {}
    for d, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d), d)
    out = []
    for d, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def linked(rows, size=5, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, root = {}, {}
    for d, text in rows:
        w = WORD.findall((text or "").translate(lower))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d)) for d in ids)


@pytest.fixture(scope="module")
def corpus():
    """Random texts over few words with copies, near copies and shared passages."""
    random.seed(11)
    vocabulary = [f"v{i}" for i in range(40)]
    passage = " ".join(random.choices(vocabulary, k=30))
    rows = []
    for d in range(60):
        w = random.choices(vocabulary, k=random.randrange(0, 90))
        if d % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        if d % 7 == 3 and rows:
            w = rows[-1][1].split()
            for _ in range(random.randrange(3)):
                if w:
                    w[random.randrange(len(w))] = "edit"
        rows.append((d, ("\n" if d % 2 else " ").join(w)))
    return rows


def test_substrings_equal_brute_force(spark, corpus):
    done = substrings.remove_repeats(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in done.collect()) == kept_words(corpus)


def test_join_equals_brute_force(spark, corpus):
    done = ngram_join.document_components(spark.createDataFrame(corpus, "doc_id long, text string"))
    assert sorted(tuple(r) for r in done.collect()) == linked(corpus)


def test_odd_documents(spark, odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.select("doc_id", "text").collect()]
    done = substrings.remove_repeats(odd_documents)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in done.where("doc_id IS NOT NULL").collect())
    assert got == kept_words([r for r in rows if r[0] is not None])
    assert done.where("doc_id IS NULL").first()["n_removed"] == 0
    cut = substrings.without_repeats(odd_documents)
    assert cut.columns == odd_documents.columns
    ids = sorted(r["doc_id"] for r in cut.where("doc_id IS NOT NULL").collect())
    assert 2 not in ids and {1, 3, 4, 5, 6, 7, 9} <= set(ids)
    links = ngram_join.document_components(odd_documents)
    assert links.count() == len(rows)
    by_id = {r["doc_id"]: r["component_id"] for r in links.collect()}
    assert by_id[2] == 1 and by_id[3] == 1 and by_id[8] == 7 and by_id[4] == 4 and by_id[5] == 5 and by_id[None] is None
    first = ngram_join.first_of_each(odd_documents)
    assert first.columns == odd_documents.columns
    assert sorted(r["doc_id"] or 0 for r in first.collect()) == [0, 1, 4, 5, 6, 7, 9, 11]


def test_empty_tables(spark, no_documents):
    assert substrings.remove_repeats(no_documents).count() == 0
    assert substrings.without_repeats(no_documents).count() == 0
    assert ngram_join.document_components(no_documents).count() == 0
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontamination(no_documents, benchmark).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(40, 30), (30, 40)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(links).collect()} == {**{i: 0 for i in range(21)}, 30: 30, 40: 30}


def test_decontamination_with_short_items(spark, odd_documents):
    items = [(1, "w5 W6 w7 w8 w9 w10 w11 w12 w13 w14 w15 zz"), (2, "one two"), (3, None), (4, "..."), (5, "absent words here"), (1, "w5 W6 w7 w8 w9 w10 w11 w12 w13 w14 w15 zz")]
    done = decontaminate.decontamination(odd_documents, spark.createDataFrame(items, "item_id long, text string"))
    assert done.count() == odd_documents.count()
    got = {r["doc_id"]: (r["n_hit"], sorted(r["items"])) for r in done.collect()}
    assert got[1] == (11, [1]) and got[10] == (11, [1]) and got[None] == (11, [1])
    assert got[7] == (2, [2]) and got[4] == (0, []) and got[9] == (0, [])
    kept = decontaminate.without_contaminated(odd_documents, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 9, 11]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.without_contaminated(odd_documents, none).count() == odd_documents.count()


def test_queries_over_the_small_tables(spark, small):
    from lodestar.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in kept_words(rows)]
    assert sorted(tuple(r) for r in QUERIES["op1_substrings"](spark, small).collect()) == want
    assert sorted(tuple(r) for r in QUERIES["op8_ngram_join"](spark, small).collect()) == linked(rows)


def test_hub_rounds_do_not_lose_links(spark):
    """Near copies that no hub links with, but that link with one another."""
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(12):
        w = list(base)
        for i in range(d):
            w[8 * i % 100] = f"e{i}"
        rows.append((d, " ".join(w)))
    done = ngram_join.document_components(spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)))
    assert sorted(tuple(r) for r in done.collect()) == linked(rows)


def test_one_common_shingle_in_thousands_of_unlike_documents(spark):
    """Short documents around one common passage, each with words of its own; every tenth is a near copy of the one before."""
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for d in range(3000):
        own = [f"o{d - (d % 10 == 9)}x{i}" for i in range(12)]
        if d % 10 == 9:
            own[11] = f"late{d}"
        rows.append((d, " ".join(passage[: 6 + d // 10 % 3] + own)))
    done = ngram_join.document_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in done.collect()} == {d: d - (d % 10 == 9) for d, _ in rows}


def test_rows_that_share_an_id(spark):
    base = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"u{i}" for i in range(50))
    rows = [(7, base), (7, other), (7, None), (7, base), (3, base.replace("w10", "x")), (9, other.replace("u9", "y")), (12, "alone here"), (12, "alone here"), (15, None), (15, None)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key long")
    done = ngram_join.document_components(docs)
    assert sorted((r["doc_id"], r["component_id"]) for r in done.collect()) == [(3, 3), (7, 3), (7, 3), (7, 3), (7, 3), (9, 3), (12, 12), (12, 12), (15, 15), (15, 15)]
    kept = ngram_join.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 12, 15]
    alone = ngram_join.first_of_each(docs.where("doc_id = 7"))
    assert sorted((r["text"] or "")[:2] for r in alone.collect()) == ["", "u0", "w0"]


def test_many_rows_of_one_id_share_their_marks(spark):
    base = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, base), (3, base + " end")] + [(2, base)] * 300, "doc_id long, text string")
    marks = {r["doc_id"]: len(r["marks"]) for r in substrings.repeated_spans(docs).collect()}
    assert marks[2] <= 68 and 1 not in marks
    done = substrings.remove_repeats(docs).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, done)) == [(1, 0, 1), (2, 80, 300), (3, 80, 1)]


def thue_morse(n):
    """A string of n letters a and b, and the same with the letters exchanged: polynomial hashes modulo 2**64 of the two are equal."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hashes_of_structured_words(spark):
    a, b = thue_morse(1024)
    runs = [" ".join(x) for x in (a, b)]
    frame = spark.createDataFrame([(1, " ".join([a] * 20)), (2, " ".join([b] * 20)), (3, runs[0]), (4, runs[1])], "doc_id long, text string")
    found = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame).collect()}
    assert found[1] == 0 and found[2] == 0 and found[3] == 0
    words = [w for w in runs[1].split()]
    earlier = {tuple(runs[0].split()[i : i + 13]) for i in range(1012)}
    gone = {k for i in range(1012) if tuple(words[i : i + 13]) in earlier for k in range(i, i + 13)}
    assert found[4] == len(gone)
    frame = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x y z u v"), (4, f"{b} x y z u v"), (5, f"{a} x y z u v")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.document_components(frame).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_word_and_span_hashes():
    import itertools
    import random

    import pyarrow as pa

    from lodestar.llm.arrowtext import Words, exact_grams, exact_ids

    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abAB") for _ in range(rng.randrange(1, 140))) for _ in range(3000)} | set(thue_morse(1024)) | set(thue_morse(64)))
    told = Words(pa.array([" ".join(words), "a", "", None, " ".join(words[::-1])]))
    assert len(set(told.hashes.tolist())) == len(words)
    assert (told.hashes[: len(words)] == told.hashes[len(words) + 1 :][::-1]).all()
    lower = Words(pa.array([" ".join(words)]), lower=True)
    assert len(set(lower.hashes.tolist())) == len({w.lower() for w in words})
    text = [rng.choice("ab") for _ in range(400)]
    told = Words(pa.array([" ".join(text), " ".join(text[100:])]))
    spans = [(i, j) for i, j in itertools.combinations(range(0, 400, 7), 2)] + [(400 + i, 400 + j) for i, j in itertools.combinations(range(0, 300, 7), 2)]
    import numpy as np

    starts, ends = np.array(spans).T
    both = text + text[100:]
    same: dict = {}
    for key in (0, 5):
        for (i, j), h in zip(spans, told.span_hashes(starts, ends, key).tolist(), strict=True):
            same.setdefault((key, tuple(both[i:j])), set()).add(h)
    assert all(len(x) == 1 for x in same.values())
    assert len({next(iter(x)) for x in same.values()}) == len(same)
    assert len(set(exact_ids(told).tolist())) == 2
    for n in (1, 2, 3, 5, 8, 13):
        starts, names = exact_grams(told, n)
        assert starts.tolist() == [*range(401 - n), *range(400, 701 - n)]
        groups: dict = {}
        for i, name in zip(starts.tolist(), names.tolist(), strict=True):
            groups.setdefault(tuple(both[i : i + n]), set()).add(name)
        assert all(len(x) == 1 for x in groups.values()) and len({min(x) for x in groups.values()}) == len(groups)
