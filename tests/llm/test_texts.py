"""BPE, URL filter, WARC, line rules, quality, licenses, toxicity."""

import gzip
import io
import math
from array import array
from collections import Counter, defaultdict
from random import Random

import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, licenses, line_rules, quality, toxicity, url_filter, warc
from lodestar.llm.queries import QUERIES, SQL, vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary())
    found.no_truncation()
    found.no_padding()
    return found


def test_bpe_equals_the_library(spark, small, library, odd_documents):
    strange = ["Hello<|endoftext|>World's <|startoftext|> ΟΔΥΣΣΕΥΣ İstanbul ﬁ Å 1234 ½ 한글 日本語 é​\x1c x\x85y\xa0z don't WE'RE", "a" * 3000, "!!!???" * 20, "\U00016ea0՘x"]
    docs = odd_documents.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(strange)], "doc_id long, text string"))
    docs = docs.unionByName(spark.read.parquet(f"{small}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    done = bpe.encode(docs, vocabulary())
    for r in done.collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(array("I", bytes(r["ids"]))) == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
    again = {(r["doc_id"], r["decoded"]) for r in bpe.decode(done, vocabulary()).collect()}
    assert again == {(r["doc_id"], r["decoded"]) for r in done.collect()}


def test_forced_boundaries_are_safe():
    model = bpe.codec(vocabulary()).model
    for word in ["thequickxqzjvbrown", "éèçàüß", "zzzzqqqqxxxx", "a" * 100]:
        letters = "".join(model.letters[b] for b in word.encode())
        assert [i for f, e in model.fragments(letters) for i in model.merged(f, e)] == model.merged(letters, True) == model.long_merged(letters, True)


def test_words_merged_side_by_side_equal_single_ones():
    model, random = bpe.codec(vocabulary()).model, Random(7)
    alphabets = ["ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz0123456789.,'", "éßжщ한글語ü\x07"]
    words = ["".join(random.choices(random.choice(alphabets), k=random.randint(1, 64))) for _ in range(3000)] + ["x"]
    assert model.words_ids(words) == [bpe.le_bytes(model.word_ids(word)) for word in words]
    assert model.words_ids([]) == []


def test_memory_of_stretches_is_bounded_and_changes_nothing(library):
    small, random = bpe.Codec(vocabulary(), memory=20), Random(8)
    for _ in range(30):
        texts = [" ".join("".join(random.choices("abc", k=random.choice([1, 2, 3, 100]))) for _ in range(random.randint(0, 12))) + "<|endoftext|>" * random.randint(0, 1) for _ in range(3)]
        assert [list(array("I", x)) for x in small.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(small.known) <= 20 + 39 and all(len(x) <= bpe.REMEMBERED for x in small.known)


def test_bpe_and_others_on_empty_tables(spark, no_documents, odd_labels):
    assert bpe.encode(no_documents, vocabulary()).count() == 0
    assert licenses.scan(no_documents).count() == 0
    assert line_rules.judged(no_documents, "doc_id").count() == 0
    assert quality.good_only(no_documents, odd_labels).count() == 0
    assert toxicity.scored(no_documents, toxicity.fit(no_documents, odd_labels)).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0
    assert url_filter.judged(pages).count() == 0


def test_urls_equal_brute_force(spark):
    urls = ["http://A.b.org/x", "https://example.org/es/1", "http://q.example.org/en/12", "http://z.com/fr/2?x#y", "http://z.com/de/", "http://z.com", "http://u.net/en/3", None, "", "no scheme", "http://z.com/fr/2?x#y", "ftp://org/a/b", "http://notorg/fr/"]
    rows = [(i, u) for i, u in enumerate(urls)]
    got = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string").withColumn("gram", F.lit(1))).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(8)] == [("a.b.org", "/x", "org/"), ("example.org", "/es/1", "example.org/es/"), ("q.example.org", "/en/12", "example.org/en/1"), ("z.com", "/fr/2", "com/fr/"), ("z.com", "/de/", "com/de/"), ("z.com", "", None), ("u.net", "/en/3", None), ("", "", None)]
    told = {i: r["verdict"] for i, r in got.items() if r["rule"]}
    assert told[0] == "allow" and told[1] == "block"
    counts = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}
    for i, u in rows:
        if i in told:
            padded = "\x02" * 4 + u
            for at in range(4, len(padded)):
                for order in range(5):
                    counts[told[i]][padded[at - order : at]][padded[at]] += 1

    def chance(kind, context, c):
        p = 1 / url_filter.ALPHABET
        for order in range(5):
            seen = counts[kind].get(context[4 - order :])
            if seen:
                p = (seen[c] + len(seen) * p) / (sum(seen.values()) + len(seen))
        return p

    for i, u in rows:
        padded = "\x02" * 4 + (u or "")
        want = sum(round((math.log(chance("allow", padded[at - 4 : at], padded[at])) - math.log(chance("block", padded[at - 4 : at], padded[at]))) * 1e6) for at in range(4, len(padded))) / max(1, len(u or "")) / 1e6
        assert abs(got[i]["score"] - want) < 2e-6


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "payload " * 40
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", big), (3, "http://b/", big), (10, "ü", "ü" * 60), (11, "v", "\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("salt", F.lit(1))
    path = str(tmp_path / "archives")
    found = warc.round_trip(pages, path).collect()
    assert len(found) == len(rows)
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    n = len(big)
    assert got == [(-1, "revisit", 3, n), (3, "response", None, n), (3, "response", None, n), (4, "response", None, 5), (5, "revisit", 3, n), (6, "response", None, 5), (7, "response", None, 0), (8, "response", None, 0), (9, "revisit", 3, n), (10, "response", None, 120), (11, "response", None, 280)]
    payloads = {r["page_id"]: bytes(r["payload"]) for r in found if r["payload"] is not None}
    assert payloads[3] == big.encode() and payloads[10] == ("ü" * 60).encode() and payloads[11] == b"\r\n\r\nWARC/1.1\r\n" * 20
    for file in (tmp_path / "archives").glob("*.txt"):
        data = file.read_bytes()
        assert gzip.GzipFile(fileobj=io.BytesIO(data)).read() == b"".join(warc.members_of(data))


def test_warc_errors():
    good = warc.member(warc.record(1, "u", b"abc", __import__("hashlib").sha256(b"abc").hexdigest(), None))
    assert [b for _, b in warc.records_of(good + good)] == [b"abc", b"abc"]
    with pytest.raises(ValueError, match="inside a member"):
        list(warc.members_of(good[:-9]))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records_of(warc.member(warc.record(1, "u", b"abc", "0" * 64, None))))
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_line_rules(spark, odd_documents):
    got = {r["doc_id"]: r for r in line_rules.judged(odd_documents, "doc_id").collect()}
    assert len(got) == 12
    assert got[4]["n_words"] == 0 and got[4]["base_failed"] and not got[4]["kept"]
    assert got[11]["n_repeat_words"] == 120 and got[11]["base_failed"]
    assert got[9]["n_repeat_words"] == 12_000
    text = "\n".join(["A clean sentence stands here, and it ends as it should end."] * 2 + ["home | news | about | contact | more", "Accept our cookie policy to go on."] + [f"Another clean sentence, number {i}, that is long enough to carry text {i} on its own." for i in range(9)])
    row = line_rules.judged(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id").first()
    assert row["n_dup_lines"] == 1 and row["kept"] and row["clean_text"].count("\n") == 10 and "cookie" not in row["clean_text"]
    bad = line_rules.judged(spark.createDataFrame([(1, " | ".join(f"item{i}" for i in range(30)))], "doc_id long, text string"), "doc_id").first()
    assert not bad["base_failed"] and not bad["kept"]


def test_line_rules_equal_their_patterns(spark):
    """The linear forms against the rules' patterns, on random lines of few symbols."""
    import random
    import re

    random.seed(3)
    parts = ["#", "##", "***", "!", "!?", "??", "a", "word ", " ", "|", "> ", "· ", ".", "privacy policy", "\t", "é", "<>"]
    lines = ["".join(random.choices(parts, k=random.randrange(1, 30))) for _ in range(2000)] + ["w " * 11, "w " * 12, "w " * 11 + "w", "  " + "w " * 12]
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", line_rules.line_fails(F.col("line")).alias("bad")).collect()
    want = {i: any(re.search(p, x) for p in line_rules.LINE_RULES.values()) or (not re.search(line_rules.SENTENCE_MARK, x) and len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= line_rules.LONG_LINE) for i, x in enumerate(lines)}
    assert {r["i"]: r["bad"] for r in got} == want and 200 < sum(want.values()) < 1900


def test_line_rules_on_unbroken_megabytes(spark):
    import time

    texts = ["x" * 1_000_000, "#" * 1_000_000, "!?" * 500_000, "| " * 300_000, "word " * 200_000, "##a#" * 250_000]
    began = time.time()
    got = line_rules.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6), "doc_id").select("doc_id", "n_words", "kept").collect()
    assert {r["doc_id"]: r["n_words"] for r in got} == {0: 1, 1: 1, 2: 1, 3: 300_000, 4: 200_000, 5: 1} and not any(r["kept"] for r in got)
    assert time.time() - began < 120


def test_quality(spark, small, odd_documents, odd_labels):
    kept = quality.good_only(odd_documents, odd_labels)
    assert kept.columns == odd_documents.columns
    assert quality.scores(odd_documents, odd_labels).count() == odd_documents.count()
    none = odd_labels.limit(0)
    assert quality.good_only(odd_documents, none).count() == odd_documents.count()
    labels = spark.read.parquet(f"{small}/labels.parquet")
    done = quality.scores(spark.read.parquet(f"{small}/documents.parquet"), labels).join(labels, "doc_id")
    right = done.agg(F.avg((F.col("good").cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.9


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    done = quality.scores(docs, labels.where(~held)).join(labels.where(held), "doc_id")
    wrong, n = done.agg(F.count_if(F.col("good").cast("int") != F.col("quality")), F.count("*")).first()
    assert n > 80 and wrong <= 0.03 * n


def test_quality_equals_plain_shares(spark):
    """Posteriors against the formula, given the documents' evidence."""
    rows = [(i, f"text {i} " * (i % 7 + 1), ["a", "b", "c"][i % 3 % (1 + i % 2)], None if i % 5 else "en") for i in range(60)] + [(60, "alone", "z", "en"), (61, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 7 > 2), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.scores(docs, labels).collect()}
    chance = {d: round(1e6 / (1 + math.exp(-r["evidence"]))) / 1e6 for d, r in got.items()}
    site = {d: (s or "", l or "") for d, _, s, l in rows}
    mean = sum(chance.values()) / len(rows)

    def strength(groups):
        part = [(len(g), sum(chance[d] for d in g), p) for g, p in groups]
        spread = sum(n * (x / n - p) ** 2 for n, x, p in part)
        spare, total = sum(p * (1 - p) for _, _, p in part), sum(n * p * (1 - p) for n, _, p in part)
        return min(1e6, max(1.0, 1 / max(round((spread - spare) / max(total - spare, 1e-9), 9), 1e-9) - 1))

    members = lambda key: {k: [d for d in site if key(site[d]) == k] for k in {key(v) for v in site.values()}}
    hosts, paths = members(lambda v: v[0]), members(lambda v: v)
    top = strength([(g, mean) for g in hosts.values()])
    shrunk = lambda g, prior, s: (sum(chance[d] for d in g) + s * prior) / (len(g) + s)
    below = strength([(g, shrunk(hosts[k[0]], mean, top)) for k, g in paths.items()])
    for d, r in got.items():
        host = shrunk([x for x in hosts[site[d][0]] if x != d], mean, top)
        share = shrunk([x for x in paths[site[d]] if x != d], host, below)
        odds = r["evidence"] + math.log(share / (1 - share)) - math.log(mean / (1 - mean))
        assert r["posterior"] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-5)
        assert r["good"] == (r["posterior"] >= 0.5)


def test_sparse_sites_shrink(spark):
    rows = [("a", "x", 4_000_000)] * 50 + [("b", "x", -4_000_000)] * 50 + [("c", "x", -4_000_000)]
    shares, mean, strength, below = quality.site_shares(spark.createDataFrame(rows, "host string, path string, evidence long"))
    by = {r["host"]: (r["path_good"] + below * mean) / (r["path_n"] + below) for r in shares.collect()}
    assert by["b"] < by["c"] < mean < by["a"] and strength >= 1


def test_licenses(spark, odd_documents):
    texts = ["word " * 30 + "Released under the MIT License." + " tail" * 9, "Licensed under the Apache License, Version 2.0", "licensed under nothing at all", None, licenses.TEMPLATES[2][1].replace("copy, modify", "copy and modify"), "Released under the MIT License. " * 2]
    got = [r["licenses"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()]
    assert got == [["MIT"], ["Apache-2.0"], [], [], ["MIT"], ["MIT"]]
    assert licenses.scan(odd_documents).where(F.size("licenses") > 0).isEmpty()
    assert licenses.collision_chance(0.6) > 1 - 1e-6


def test_license_scan_equals_full_containment(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    import re

    grams = lambda t: [tuple(w[i : i + 5]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())] for i in range(len(w) - 4)]
    templates = [(name, set(grams(t))) for name, t in licenses.TEMPLATES]
    want = {}
    for d, text in rows:
        g = grams(text or "")
        want[d] = sorted({name for name, t in templates for i in range(len(g)) if len(t & set(g[i : i + len(t) + 2])) >= 0.8 * len(t)})
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert got == want and any(want.values())


def test_toxicity_on_held_out_rows(spark):
    import random

    random.seed(4)
    bad, fine = ["vileword", "nastyterm", "foulthing"], [f"plain{i}" for i in range(200)]
    rows, labels = [], []
    for d in range(900):
        w = random.choices(fine, k=random.randrange(20, 60))
        toxic = d % 5 == 0
        for _ in range(3 if toxic else 0):
            w.insert(random.randrange(len(w)), random.choice(bad) + random.choice(["", "!", "s"]))
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, told)
    done = toxicity.scored(docs, model).join(told, "doc_id").where(toxicity.held_out())
    assert done.where("predicted <> toxic").isEmpty() and done.count() > 150
    spans = done.where("toxic = 1").first()
    text = dict(rows)[spans["doc_id"]]
    assert spans["spans"] and all(text[s["offset"] : s["offset"] + s["length"]].strip("!").rstrip("s") in bad for s in spans["spans"])
    assert not toxicity.scored(docs, model).where("score < 0 OR score > 1").count()


def test_marginals_equal_plain_recursion():
    import numpy as np

    model = toxicity.Model({"bad$": 3, "poor$": 1}, np.array([-2.0, -0.5, 0.3, 1.5, 2.0, 3.0]), np.array([[0.4, -0.6], [-0.2, 0.7]])).prepared()
    words = "a b bad c d poor e bad bad f g h i".split()
    at, p = model.marginals(model.classes(words))
    classes = model.classes(words)
    paths = {}
    for code in range(2 ** len(words)):
        y, before, score = [code >> i & 1 for i in range(len(words))], 0, 0.0
        for c, s in zip(classes, y):
            score += model.moves[before, s] + s * model.weights[c]
            before = s
        paths[tuple(y)] = math.exp(score)
    total = sum(paths.values())
    for i, q in zip(at, p):
        assert abs(sum(v for y, v in paths.items() if y[i]) / total - q) < 1e-9


def test_toxicity_odd_rows(spark, odd_documents, odd_labels):
    assert toxicity.scored(odd_documents, toxicity.fit(odd_documents, odd_labels)).count() == odd_documents.count()
    lonely = toxicity.fit(odd_documents, odd_labels.limit(0))
    assert toxicity.scored(odd_documents, lonely).where("score > 0.01").isEmpty()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_same_rows(spark, small, duck, name):
    found = QUERIES[name](spark, small)
    told = duck.execute(SQL[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted(told.fetchall(), key=repr)


def _licenses_of(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    return [r["licenses"] for r in rows]


def test_one_line_license_wordings(spark):
    want = {
        "Licensed under the MIT License.": ["MIT"], "Code is MIT licensed": ["MIT"], "SPDX-License-Identifier: MIT": ["MIT"],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0"], "Shared under CC BY-SA 3.0": ["CC-BY-SA-3.0"], "licensed under CC BY-NC-ND 4.0": ["CC-BY-NC-ND-4.0"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"],
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
        "Distributed under the terms of the GNU Lesser General Public License v2.1": ["LGPL-2.1"], "released under the GPLv3": ["GPL-3.0"],
        "Use of this source code is governed by a BSD-style license": ["BSD"], "Released under the 2-clause BSD license": ["BSD-2-Clause"],
        "licensed under the Apache License 2.0": ["Apache-2.0"], "released under the GNU General Public License": ["GPL"],
        "The mit of this text and a license to kill": [], "he went mit dem hund": [],
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.": ["GPL-3.0"],
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": ["GPL-2.0"],
    }
    assert dict(zip(want, _licenses_of(spark, list(want)), strict=True)) == want


def test_whole_license_texts(spark):
    """Also texts as Debian ships them, which hold preambles and notices that the templates lack."""
    from pathlib import Path

    held = dict(licenses.texts())
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "Apache-2.0", "MPL-2.0"} <= held.keys()
    got = _licenses_of(spark, [f"some words before\n{t}\nand after" for t in held.values()])
    assert dict(zip(held, got, strict=True)) == {name: [name] for name in held}
    isc = """Copyright (c) 2014, A B <a@b.c>

Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    lone = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    both = held["MIT"] + "\n" + held["GPL-2.0"] + "\n" + held["BSD-2-Clause"]
    assert _licenses_of(spark, [isc, lone, both]) == [["ISC"], ["BSD"], ["BSD-2-Clause", "GPL-2.0", "MIT"]]
    shipped = Path("/usr/share/common-licenses")
    names = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "Apache-2.0": "Apache-2.0", "MPL-1.1": "MPL-1.1", "BSD": "BSD-3-Clause"}
    there = {path: name for path, name in names.items() if (shipped / path).exists()}
    got = _licenses_of(spark, [(shipped / path).read_text(errors="replace") for path in there])
    assert all(name in found for name, found in zip(there.values(), got, strict=True)), got
