"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side in no vocabulary entry can
never end up in one token, so a cut between them is certain. A text is cut
there, at white space and at the pre-tokenizer's boundaries, the fragments are encoded
independently, and the results concatenated. The fragments of all new words of
a chunk of texts are merged side by side in NumPy, a pair of each a round;
stretches recur, so each worker keeps a bounded memory of those it has encoded.

The job is a map over the documents: nothing is shuffled, and the memory a
task needs is one Arrow batch, the vocabulary and the bounded memory of
stretches, or some 100 times the bytes of its longest text.

Defined cases: a null text counts as empty (no ids); rows stay as they are,
repeated ids included; an input without rows gives no rows; columns of the
input that are not named are not returned by ``encode``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodestar.llm.arrowtext import chunks
from lodestar.llm.shared import bounded_batches

#: Stretches between white space that a worker remembers; when there are more, those of the present chunk stay. An
#: entry takes some 250 bytes, and as only stretches of up to ``REMEMBERED`` characters stay, 1 kB at most.
MEMORY = 100_000
#: Characters of the longest stretch that is remembered, and of the longest word that is merged beside others.
REMEMBERED = 64

#: Above every rank of a pair.
_NONE = 1 << 60

#: Fixed values of the byte-level alphabet: bytes that stand for themselves.
_OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: White space of the normalizer's pattern.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


#: Letters and numbers of Unicode 17, which the vocabulary's own pattern does not know (fixed values).
_YOUNG = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_ANY_YOUNG = re.compile(f"[{_YOUNG}]")

#: Capitals of Unicode 16 and 17 and their small letters (fixed values): first, last, distance.
_LATER = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
_LATER_LOWER = {c: c + d for a, b, d in _LATER for c in range(a, b + 1)}
_ANY_LATER = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in _LATER) + "]")


#: Runs of letters, single numbers, runs of other signs: how the file's pattern ends (fixed value).
_PLAIN_END = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from 256 on."""
    free, out = iter(range(256, 512)), []
    for byte in range(256):
        out.append(chr(byte) if byte in set(_OWN_BYTES) else chr(next(free)))
    return out


class WordBpe:
    """The model of a ``tokenizers`` file: BPE with a word-end suffix over byte-level pre-tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.texts = {i: s for s, i in (self.ids | self.special).items()}
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.letters = byte_alphabet()
        split = next(x["pattern"]["Regex"] for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        told_split = split
        split = split.replace(r"\s", _SPACE.pattern[1:-2])
        self.words = regex.compile(split)
        # rare texts with characters younger than the vocabulary's tables take a slower pattern
        self.old_words = regex.compile(split.replace(r"[\p{L}]", rf"[\p{{L}}--[{_YOUNG}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{_YOUNG}]]").replace(r"\p{L}\p{N}]+", rf"[\p{{L}}--[{_YOUNG}]][\p{{N}}--[{_YOUNG}]]]+"), regex.V1)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # whether the pattern ends in these alternatives, and all before them begin with a sign
        self.plain = re.fullmatch(r"(?:[^\w\s|][^|]*\|)*", told_split.removesuffix(_PLAIN_END)) is not None and told_split.endswith(_PLAIN_END)
        self.mark = os.path.commonprefix(list(self.special))
        self.inner = self._inner_pairs()
        self._number_pairs()

    def _number_pairs(self) -> None:
        """The merges by numbers: left id * base + right id gives rank * base + merged id."""
        self.base = 1 << len(self.ids).bit_length()
        self.begins = {c: self.ids[c] for c in self.letters if c in self.ids}
        self.ends = {c: self.ids[c + self.suffix] for c in self.letters if c + self.suffix in self.ids}
        self.joined = {}
        for (left, right), rank in self.ranks.items():
            if left in self.ids and right in self.ids and left + right in self.ids:
                self.joined[self.ids[left] * self.base + self.ids[right]] = rank * self.base + self.ids[left + right]
        # only then do numbers say all that the merges say
        self.numbered = max(self.ids.values(), default=0) < self.base and len(self.joined) == len(self.ranks) and len(self.begins) == len(self.ends) == len(self.letters)
        if self.numbered:
            self.ranks = {}
            self.pairs = np.array(sorted(self.joined), np.int64)
            self.merges = np.array([self.joined[x] for x in self.pairs.tolist()], np.int64)
            self.byte_begins, self.byte_ends = (np.array([x[c] for c in self.letters], np.int64) for x in (self.begins, self.ends))
            byte = {c: i for i, c in enumerate(self.letters)}
            self.cuts = np.ones((256, 256), bool)
            for left, right in self.inner:
                if left in byte and right in byte:
                    self.cuts[byte[left], byte[right]] = False

    def words_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, none empty, as bytes."""
        if not self.numbered or not words:
            return [le_bytes(self.word_ids(word)) for word in words]
        told = [word.encode("utf-8", "surrogatepass") for word in words]
        sizes = np.fromiter(map(len, told), np.int64, len(told))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(told), np.uint8)
        parts, opens = self.byte_begins[data], np.ones(len(data), bool)
        parts[ends - 1] = self.byte_ends[data[ends - 1]]
        opens[1:] = self.cuts[data[:-1], data[1:]]
        opens[ends[:-1]] = True
        kept = self._merge_all(parts, opens)
        after = np.cumsum(np.add.reduceat(kept.astype(np.int64), ends - sizes)) * 4
        ids, bounds = parts[kept].astype("<u4").tobytes(), [0, *after.tolist()]
        return [ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank * base + merged id of each pair, ``_NONE`` for those that never merge."""
        keys = left * self.base + right
        found = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[found] == keys, self.merges[found], _NONE)

    def _merge_all(self, parts: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Merges the fragments that begin at ``opens`` in ``parts``, each as ``merged`` does; gives the places where ids are left."""
        kept, at, rank = np.ones(len(parts), bool), np.arange(len(parts)), np.full(len(parts), _NONE)
        inside = np.flatnonzero(~opens[1:])
        rank[inside] = self._ranks(parts[inside], parts[inside + 1])
        while len(at):
            first = np.flatnonzero(opens[at])
            sizes = np.diff(first, append=len(at))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            place = np.flatnonzero((rank == least) & (rank < _NONE))
            of = np.repeat(np.arange(len(first)), sizes)[place]
            place = place[np.diff(of, prepend=-1) > 0]  # the leftmost of each fragment
            parts[at[place]] = rank[place] & (self.base - 1)
            kept[at[place + 1]] = False
            still = least < _NONE
            still[place + 1] = False
            place = (np.cumsum(still) - 1)[place]
            at, rank = at[still], rank[still]
            # only pairs with a new symbol have a new rank
            rank[place] = _NONE
            changed = np.concatenate([place[~opens[at[place]]] - 1, place[place + 1 < len(at)]])
            changed = changed[~opens[at[changed + 1]]]
            rank[changed] = self._ranks(parts[at[changed]], parts[at[changed + 1]])
        return kept

    def has_special(self, text: str) -> bool:
        return self.specials is not None and self.mark in text and self.specials.search(text) is not None

    def _inner_pairs(self) -> set[str]:
        """Pairs of symbols that are neighbours inside some vocabulary entry; any other pair is a forced boundary."""
        pairs = set()
        for entry in self.ids:
            body = entry[: -len(self.suffix)] if self.suffix and entry.endswith(self.suffix) and entry != self.suffix else entry
            pairs.update(map("".join, zip(body, body[1:], strict=False)))
        return pairs

    def normalized(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _ANY_LATER.search(text):
                text = text.translate(_LATER_LOWER)
            text = text.replace("Σ", "σ")  # lower case by single characters: a final sigma is no exception
        return text.lower()

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a normalized piece of text."""
        if self.plain and text.isascii():
            # letters are one pre-token, a single sign after them another: no need of the pattern
            if text.isalpha():
                return [text]
            head, last = text[:-1], text[-1:]
            if head.isalpha() and last.isprintable() and last != " " and not last.isalnum():
                return [head, last]
        rare = not text.isascii() and _ANY_YOUNG.search(text)
        return (self.old_words if rare else self.words).findall(text)

    def fragments(self, word: str) -> list[tuple[str, bool]]:
        """A word in byte letters, cut at its forced boundaries; the flag marks the word's end."""
        if self.inner.issuperset(map(add, word, word[1:])):
            return [(word, True)]
        out, begin = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.inner:
                out.append((word[begin:i], False))
                begin = i
        out.append((word[begin:], True))
        return out

    def merged(self, fragment: str, ends: bool) -> list[int]:
        """Ids of one fragment: the pair of least rank is merged first, the leftmost of equals."""
        if not self.numbered:
            return self._merged_texts(fragment, ends)
        parts = list(map(self.begins.__getitem__, fragment))
        if ends:
            parts[-1] = self.ends[fragment[-1]]
        get, base, none = self.joined.get, self.base, 1 << 60
        ranks = [get(left * base + right, none) for left, right in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] = new = least & (base - 1)
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] * base + new, none)
            if i < len(ranks):
                ranks[i] = get(new * base + parts[i + 1], none)
        return parts

    def _merged_texts(self, fragment: str, ends: bool) -> list[int]:
        """As ``merged``, for vocabularies with symbols or merges outside their entries."""
        parts = list(fragment)
        if ends:
            parts[-1] += self.suffix
        rank, none = self.ranks.get, 1 << 60
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return [self.ids[p] for p in parts if p in self.ids]

    def long_merged(self, fragment: str, ends: bool) -> list[int]:
        """As ``merged`` in n log n steps, for long fragments: a heap of pairs over linked symbols."""
        import heapq

        parts: list = list(map(self.begins.__getitem__, fragment)) if self.numbered else list(fragment)
        if ends:
            parts[-1] = self.ends[fragment[-1]] if self.numbered else fragment[-1] + self.suffix
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts):
                left, right = parts[i], parts[after[i]]
                found = self.joined.get(left * self.base + right) if self.numbered else self.ranks.get((left, right))
                if found is not None:
                    heapq.heappush(heap, (found, i, left, right))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            found, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j] = found & (self.base - 1) if self.numbered else left + right, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        if self.numbered:
            return [p for p in parts if p is not None]
        return [self.ids[p] for p in parts if p is not None and p in self.ids]

    def word_ids(self, word: str) -> list[int]:
        # printable ASCII stands for itself
        letters = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode("utf-8", "surrogatepass")))
        return [i for f, ends in self.fragments(letters) for i in self.encode_fragment(f, ends)]

    def encode_fragment(self, fragment: str, ends: bool) -> list[int]:
        return (self.merged if len(fragment) < 64 else self.long_merged)(fragment, ends)


_AS_STORED = sys.byteorder == "little" and array("I").itemsize == 4


def le_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if _AS_STORED else b"".join(i.to_bytes(4, "little") for i in ids)


class Codec:
    """Encodes whole texts, a chunk of them at once, with a bounded memory of stretches without white space."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.model, self.memory = WordBpe(path), memory
        # special tokens stand in tuples, so that no stretch is taken for one
        self.fixed: dict = {(text,): le_bytes([i]) for text, i in self.model.special.items()}
        self.known: dict = dict(self.fixed)

    def _stretches(self, text: str) -> list:
        model = self.model
        if not model.has_special(text):
            return _SPACE.split(model.normalized(text))
        out: list = []
        for i, part in enumerate(model.specials.split(text)):
            out += [(part,)] if i % 2 else _SPACE.split(model.normalized(part))
        return out

    def _learn(self, fresh: list[str]) -> None:
        words = list(map(self.model.split, fresh))
        distinct = set().union(*words)
        short = [word for word in distinct if len(word) <= REMEMBERED]
        ids = dict(zip(short, self.model.words_ids(short), strict=True))
        ids |= {word: le_bytes(self.model.word_ids(word)) for word in distinct if len(word) > REMEMBERED}
        for stretch, of in zip(fresh, words, strict=True):
            self.known[stretch] = ids[of[0]] if len(of) == 1 else b"".join(map(ids.__getitem__, of))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        rows = list(map(self._stretches, texts))
        used = set().union(*rows)
        fresh = list(used.difference(self.known))
        if len(self.known) + len(fresh) > self.memory:
            self.known = self.fixed | {x: self.known[x] for x in used if x in self.known}
        self._learn(fresh)
        out = [b"".join(map(self.known.__getitem__, row)) for row in rows]
        for stretch in fresh:
            if len(stretch) > REMEMBERED:
                del self.known[stretch]
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.model.texts.__getitem__, array("I", ids)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary file and Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded) for each row of ``docs``; ids: little-endian unsigned 32-bit integers, one after another."""
    bounded_batches(docs.sparkSession)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens bigint, ids binary, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            for part in chunks(batch.rename_columns([key, "text"])):
                found = model.encode([value or "" for value in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) // 4 for b in found], pa.int64()), pa.array(found, pa.binary()), pa.array(map(model.decode, found), pa.string())], [key, "n_tokens", "ids", "decoded"])
            batch = part = found = None  # not held while the next one is read

    return docs.select(key, text).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) for rows with ids as ``encode`` gives them; null counts as no ids."""
    bounded_batches(tokens.sparkSession)
    schema = f"`{key}` {tokens.schema[key].dataType.simpleString()}, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(value.as_py() or b"") for value in batch.column(1)], pa.string())], [key, "decoded"])

    return tokens.select(key, ids).mapInArrow(run, schema)
