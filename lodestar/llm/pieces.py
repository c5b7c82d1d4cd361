"""SentencePiece (BPE) encoding by a table of each prefix's last token, and decoding.

A row of tokens is the encoding of a text exactly if each two neighbours are:
if merging the text of the two, best score and then leftmost first, gives them
back. So every prefix of a text has one last token, that which the automaton
of all pieces finds at the prefix's end and which is compatible with the last
token of the prefix before it. The table is filled from the left, and the ids
are recovered backwards from the text's end. Compatible pairs are remembered.

Where no piece goes on (from a letter to a sign that follows letters in no
piece, before space marks, around line breaks) the table starts anew, so the
stretches between such places are encoded once and remembered (bounded). The job is a map over the documents: nothing is shuffled.
Time and memory are linear in a text, also in one without spaces.

Defined cases: a null text counts as empty and an empty text has no ids; rows
stay as they are, repeated ids included; an input without rows gives no rows;
columns that are not named are not returned; a text of any length is encoded
whole, by one task.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.arrowtext import chunks
from lodestar.llm.shared import bounded_batches

#: Stretches and pairs that a worker remembers (some 300 and 100 bytes each), and characters of the longest such stretch.
MEMORY = 250_000
PAIRS = 400_000
REMEMBERED = 64

#: Fixed values of the format: the space mark, kinds of pieces, the text of the unknown piece.
MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_UNKNOWN_TEXT = " ⁇ "

codecs.register_error("lodestar-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def _number(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out, shift, at = out | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        if tag & 7 == 0:
            value, at = _number(data, at)
        else:
            size, at = _number(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceModel:
    """The pieces of a model file with byte fallback, without a character map and without user-defined or unused pieces; others are refused."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            told = list(_fields(file.read()))
        trainer, normalizer = ({k: v for key, part in told if key == number for k, v in _fields(part)} for number in (2, 3))
        self.texts, self.scores, self.kinds = [], [], []
        for piece in (dict(_fields(v)) for key, v in told if key == 1):
            self.texts.append(piece.get(1, b"").decode())
            self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            self.kinds.append(piece.get(3, _NORMAL))
        plain = trainer.get(3, 1) == 2 and trainer.get(35, 0) == 1 and not trainer.get(24, 0) and not normalizer.get(2)
        if not plain or normalizer.get(3, 1) != 1 or normalizer.get(4, 1) != 0 or normalizer.get(5, 1) != 1 or not {1, 2, 3, 6}.issuperset(self.kinds):
            raise ValueError(f"{path}: only BPE models with byte fallback, a leading space mark, all white space kept and no character map are known")
        self.score = {t: s for t, s, kind in zip(self.texts, self.scores, self.kinds, strict=True) if kind == _NORMAL}
        self.ids = {t: i for i, t in enumerate(self.texts) if self.kinds[i] == _NORMAL}
        self.byte_ids = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if self.kinds[i] == _BYTE}
        known = set().union(*self.ids)
        self.barrier = next(c for c in "\n\x00\x01\x02￾\U0010ffff" if c not in known)
        self.stretches = self._stretches(known)
        self.sizes = list(map(len, self.texts))
        self.automaton = ahocorasick.Automaton()
        for text, i in self._reached():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.known_pairs: dict[int, bool] = {}
        # what each id decodes to; bytes take the place of their piece
        self.decoded = [bytes([int(t[3:5], 16)]) if kind == _BYTE else b"" if kind == _CONTROL else _UNKNOWN_TEXT.encode() if kind == _UNKNOWN else t.replace(MARK, " ").encode() for t, kind in zip(self.texts, self.kinds, strict=True)]

    def merged(self, text: str, least: int = 1) -> list[str]:
        """The symbols that are left when the neighbours of best score, the leftmost of equals, are merged until ``least`` are left."""
        parts, get, none = list(text), self.score.get, float("-inf")
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while len(parts) > least and scores:
            best = max(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i] += parts.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], none)
        return parts

    def _stretches(self, known: set[str]) -> re.Pattern:
        """Stretches between certain boundaries of the vocabulary, as a pattern.

        Certain are boundaries from a Latin letter to an ASCII sign that follows
        such a letter in no piece, those around line breaks that no piece holds
        and, if no piece holds one after another character, those before space marks.
        """
        follows = {(a, b) for t in self.ids for a, b in zip(t, t[1:], strict=False)}
        if any(b == MARK and a != MARK for a, b in follows):
            return re.compile("(?s:.+)")
        breaks = "".join(c for c in "\n\r\t" if c not in known)
        letters = "".join(filter(str.isalpha, map(chr, range(256))))
        signs = {c for c in map(chr, range(33, 127)) if not c.isalnum()} - {b for a, b in follows if a in letters}
        word = f"{MARK}*[{letters}]++(?=[{re.escape(''.join(sorted(signs)))}{MARK}{breaks}]|\\Z)" if signs else "(?!)"
        return re.compile(f"{word}|{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|[{breaks}]+" if breaks else ""))

    def _reached(self) -> Iterator[tuple[str, int]]:
        """The pieces that merging their own text gives; notes the last merge of each and when it comes.

        ``when`` is the worst cost (negative score) among a piece's merges: of two
        pieces side by side, that of the lower is made first.
        """
        self.when: dict[str, float] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        for text, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            parts = self.merged(text, 2)
            if len(parts) == 1:  # a single character
                self.when[text] = float("-inf")
            elif len(parts) == 2 and text in self.score:
                left, right = parts
                self.halves[text] = left, right
                self.when[text] = max(-self.score[text], self.when[left], self.when[right])
            else:
                continue
            yield text, i

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stay what they are side by side.

        Merges are undone from the last one back; the pieces part if at some point
        the symbols at the boundary would have merged before either was used up.
        """
        a, b = self.texts[left], self.texts[right]
        when, halves, cost, limit, mine = self.when, self.halves, self.score.get, float("inf"), False
        while True:
            score = cost(a + b)
            # an equal cost comes first if it stands further left: before a merge inside the right piece
            if score is not None and (-score < limit or (-score == limit and not mine)):
                return False
            if when[a] > when[b]:
                limit, mine, a = when[a], True, halves[a][1]
            elif b in halves:
                limit, mine, b = when[b], False, halves[b][0]
            else:
                return True

    def last_tokens(self, text: str) -> list[int]:
        """The last token of each prefix of ``text``; -1 where its last character is in no piece."""
        last, sizes, known, done = [-1] * (len(text) + 1), self.sizes, self.known_pairs, -1
        bits = len(sizes).bit_length()
        for end, token in self.automaton.iter(text):
            if end == done:
                continue
            before = last[end - sizes[token]]  # the entry before the first is the last of the list, -1 too
            if before >= 0:
                pair = before << bits | token
                if pair not in known:
                    if len(known) >= PAIRS:
                        known.clear()
                    known[pair] = self.compatible(before, token)
                if not known[pair]:
                    continue
            last[end] = token
            done = end
        return last

    def recovered(self, text: str, last: list[int], start: int, end: int) -> bytes:
        """The ids of ``text[start:end]``, from its end back, as little-endian 32-bit integers."""
        ids, at = [], end - 1
        while at >= start:
            token = last[at]
            if token >= 0:
                ids.append(token)
                at -= self.sizes[token]
            else:
                ids += [self.byte_ids[x] for x in reversed(text[at].encode())]
                at -= 1
        ids.reverse()
        return np.array(ids, "<i4").tobytes()

    def decode(self, ids: list[int] | array) -> str:
        """The text of ``ids``; bytes that are no UTF-8 become U+FFFD, one each."""
        out = list(map(self.decoded.__getitem__, ids))
        for i, part in enumerate(out):  # the first space of the text is the model's own
            if part:
                if self.kinds[ids[i]] == _NORMAL and part.startswith(b" "):
                    out[i] = part[1:]
                break
        return b"".join(out).decode("utf-8", "lodestar-each-byte")


class Codec:
    """Encodes whole texts, a chunk of them at once, with a bounded memory of stretches."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.model, self.memory = PieceModel(path), memory
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        model = self.model
        rows = [model.stretches.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        used = set().union(*rows)
        fresh = list(used.difference(self.known))
        if len(self.known) + len(fresh) > self.memory:
            self.known = {x: self.known[x] for x in used if x in self.known}
        joined = model.barrier.join(fresh)
        last, at = model.last_tokens(joined), 0
        for stretch in fresh:
            self.known[stretch] = model.recovered(joined, last, at, at + len(stretch))
            at += len(stretch) + 1
        out = [b"".join(map(self.known.__getitem__, row)) for row in rows]
        if len(self.known) > self.memory:
            self.known = {}
        for stretch in fresh:
            if len(stretch) > REMEMBERED:
                self.known.pop(stretch, None)
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model file and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids: array<int>, decoded) for each row of ``docs``, without begin or end ids."""
    bounded_batches(docs.sparkSession)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in chunks(batch.rename_columns([key, "text"])):
                found = own.encode([value or "" for value in part.column(1).to_pylist()])
                counts = np.array([len(x) // 4 for x in found], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                decoded = pa.array([own.model.decode(array("i", x)) for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), ids, decoded], [key, "n_tokens", "ids", "decoded"])
            batch = part = found = None  # not held while the next one is read

    return docs.select(key, text).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) for rows with ids as ``encode`` gives them; null counts as no ids."""
    bounded_batches(tokens.sparkSession)
    schema = f"`{key}` {tokens.schema[key].dataType.simpleString()}, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path).model
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(value.as_py() or []) for value in batch.column(1)], pa.string())], [key, "decoded"])

    return tokens.select(key, ids).mapInArrow(run, schema)
