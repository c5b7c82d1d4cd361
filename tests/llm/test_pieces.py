"""SentencePiece encoding against the library."""

import hashlib
import random
import struct
from array import array

import pytest
from pyspark.sql import functions as F

from lodestar.llm import pieces, queries


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(queries.piece_model())


def same(codec, library, texts):
    for text, found in zip(texts, codec.encode(texts), strict=True):
        ids = array("i", found).tolist()
        assert ids == library.encode(text), text
        assert codec.model.decode(ids) == library.decode(ids), text


def test_odd_texts(codec, library):
    same(codec, library, ["", " ", "  a", "▁a", "a\nb", "<s> x", "<unk><0x0A>", "a\x00b", "é é", "漢字☃ \U0001f600", " a  b ", " " * 50, "▁" * 37 + "漢", "a" * 3000, "\n", "\t\tx\r\n", "﻿￾\U0010ffff", "word " * 3000, "x" * 200 + " " * 200])


def test_random_texts(codec, library):
    rng = random.Random(11)
    known = list(codec.model.ids)
    same(codec, library, ["".join(rng.choice("aeinrst  ▁\n\té漢ß☃the.,01'") for _ in range(rng.randrange(60))) for _ in range(2000)])
    same(codec, library, ["".join(rng.choice(known) for _ in range(rng.randrange(1, 8))) for _ in range(5000)])
    same(codec, library, ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x4E00, 0xD800), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(40))) for _ in range(2000)])


def test_decode_of_any_ids(codec, library):
    rng = random.Random(12)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(rng.randrange(8))]
        assert codec.model.decode(ids) == library.decode(ids), ids


def test_compatible_is_merging_the_pair(codec):
    rng = random.Random(13)
    model = codec.model
    marks = [i for t, i in model.ids.items() if set(t) == {"▁"}]
    pairs = [(a, b) for a in marks for b in marks]
    codec.encode(["the same words and others, unlike these"])
    pairs += [(pair >> 15, pair & 32767) for pair in model.known_pairs]
    pairs += [(rng.randrange(260, 32000), rng.randrange(260, 32000)) for _ in range(20000)]
    for a, b in pairs:
        x, y = model.texts[a], model.texts[b]
        assert model.compatible(a, b) == (model.merged(x + y) == [x, y]), (x, y)


def test_bounded_memory_gives_the_same(library):
    small = pieces.Codec(queries.piece_model(), memory=20)
    texts = [f"some words number {i} and {i % 7} more" for i in range(200)]
    for at in range(0, 200, 10):
        same(small, library, texts[at : at + 10])
    assert len(small.known) <= 60


def test_whole_tables(spark, small, library):
    told = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = queries.op11_sentencepiece(spark, small).collect()
    assert len(found) == len(told)
    for row in found:
        ids = library.encode(told[row.doc_id] or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_odd_documents(spark, odd_documents, no_documents, library):
    path = queries.piece_model()
    encoded = pieces.encode(odd_documents, path)
    rows = encoded.collect()
    texts = [(r.doc_id, r.text or "") for r in odd_documents.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in rows), key=repr) == sorted(((i, tuple(library.encode(t)), library.decode(library.encode(t))) for i, t in texts), key=repr)
    decoded = pieces.decode(encoded.select("doc_id", F.expr("if(n_tokens = 0, null, ids)").alias("ids")), path).collect()
    assert sorted(((r.doc_id, r.decoded) for r in decoded), key=repr) == sorted(((r.doc_id, r.decoded) for r in rows), key=repr)
    assert pieces.encode(no_documents, path).count() == 0


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    piece = b"\x0a\x01a\x15" + struct.pack("<f", 0.0)
    path.write_bytes(b"\x0a" + bytes([len(piece)]) + piece + b"\x12\x02\x18\x01\x1a\x02\x18\x01")  # a unigram model
    with pytest.raises(ValueError, match="only BPE"):
        pieces.PieceModel(str(path))
