"""Very long inputs, repeated rows and rows without an id."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, licenses, url_filter, warc


def test_huge_pages_and_repeated_rows(spark, tmp_path):
    rng = random.Random(2)
    huge = "".join(rng.choice("abcdefgh ") for _ in range(1 << 16)) * 800  # over 50 MB
    large = "x" * 300_000
    rows = [(1, "u1", huge), (2, "u2", large), (3, "u3", large), (4, None, "small " * 50), (5, "u5", "small " * 50), (6, "u6", "tiny"), (6, "u6", "tiny"), (7, "u7", None), (None, "u8", large), (9, "u\n9", huge), (4, None, "small " * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    found = warc.round_trip(pages, path).select("page_id", "record_type", "payload_bytes", "refers_to", F.sha2("payload", 256).alias("own"), "payload_digest").collect()
    want = [
        (1, "response", len(huge), None), (2, "response", 300_000, None), (3, "revisit", 300_000, 2), (4, "response", 300, None), (4, "response", 300, None), (5, "revisit", 300, 4),
        (6, "response", 4, None), (6, "response", 4, None), (7, "response", 0, None), (None, "revisit", 300_000, 2), (9, "revisit", len(huge), 1),
    ]
    assert sorted(((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in found), key=repr) == sorted(want, key=repr)
    assert all(r.own == r.payload_digest for r in found if r.record_type == "response")
    heads = [h for file in (tmp_path / "w").rglob("*.txt") for h, _ in warc.records_of(file.read_bytes())]
    assert len({h["warc-record-id"] for h in heads}) == len(rows)
    assert {h.get("warc-refers-to-target-uri") for h in heads if h["warc-type"] == "revisit"} == {"u1", "u2", None}


def test_urls_of_many_characters(spark):
    rows = [(i, f"http://site{i % 3}.org/page/{i}") for i in range(50)] + [(i, f"http://bad{i % 3}.com/de/{i}") for i in range(50, 100)]
    rows += [(200, "http://x.net/" + "a/b-c" * 20_000), (201, "http://x.com/de/" + "z" * 60_000)]
    began = time.time()
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 102 and got[200].verdict in ("allow", "block") and (got[201].rule, got[201].verdict) == ("com/de/", "block")
    assert len(got[200].path) == 100_001
    assert time.time() - began < 120


def test_thousands_of_notices_take_linear_time():
    notices = [text for _, text in licenses.CATALOGUE if len(text.split()) < 80]
    known = licenses.Templates(list(licenses.CATALOGUE))
    import pyarrow as pa

    from lodestar.llm.arrowtext import Words

    took = {}
    for n in (2_000, 16_000):
        text = " filler ".join(notices[i % len(notices)] for i in range(n))
        words = Words(pa.array([text]), lower=True, separators=licenses.SEPARATORS)
        _, hashes = words.grams(licenses.WORDS)
        began = time.process_time()
        found = known.matches(hashes)
        rows = [(t, f, p, c, len(known.sets[t]), np.arange(f, p)) for t, f, p, c in found]
        kept = licenses.best_of(rows)
        took[n] = time.process_time() - began
        assert len(kept) > n // 2
    assert took[16_000] < 16 * max(took[2_000], 0.5)


def test_items_without_an_id(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x " + " ".join(words[5:20]) + " y"), (3, "none of it"), (4, "short item here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(words[4:16])), (7, " ".join(words[8:30])), (None, "item here"), (8, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, sorted(r["items"], key=repr), r.contaminated) for r in decontaminate.decontamination(docs, items).collect()}
    assert got == {1: (26, [7, None], True), 2: (15, [7, None], True), 3: (0, [], False), 4: (2, [None], True)}


def test_stretches_on_one_diagonal_and_several(spark):
    """Repeated and broken passages: every window of the definition, no other."""
    rng = random.Random(6)
    unit = [f"u{i}" for i in range(14)]
    item = unit * 3 + ["q"] + [rng.choice("abc") for _ in range(60)]
    docs = []
    for i in range(60):
        text = list(item)
        for _ in range(rng.randrange(12)):
            text[rng.randrange(len(text))] = "changed"
        at = rng.randrange(len(text) - 5)
        docs.append((i, " ".join(text[at:] + unit * rng.randrange(3) + text[:at])))
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, " ".join(unit[:11])), (3, " ".join(item[20:29]))], "item_id long, text string")
    windows = {}
    for key, text in ((1, item), (2, unit[:11]), (3, item[20:29])):
        n = min(10, len(text))
        for i in range(len(text) - n + 1):
            windows.setdefault(tuple(text[i : i + n]), set()).add(key)
    for row in decontaminate.decontamination(frame, items).collect():
        words = docs[row.doc_id][1].split()
        hit, found = set(), set()
        for n in (9, 10):
            for i in range(len(words) - n + 1):
                keys = windows.get(tuple(words[i : i + n]))
                if keys:
                    hit |= set(range(i, i + n))
                    found |= keys
        assert (row.n_hit, set(row["items"])) == (len(hit), found)
