"""Words of Arrow string columns as NumPy arrays: boundaries, 64-bit hashes, n-gram hashes.

All functions work on flat arrays over the texts of one chunk, so the cost a
word does not depend on how the texts are divided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 512 << 10

#: Bytes of the words that are hashed side by side; longer ones are hashed one by one.
SHORT = 64

U64 = np.uint64
_WORD_KEY = 0x9E3779B97F4A7C15
_SPAN_KEY = U64(0xD1342543DE82EF95)
_PAIR_KEY = U64(0xA0761D6478BD642F)
#: What is left of eight bytes when only the first 0 to 8 of them count.
_HELD = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _separators(codes: list[int]) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[codes] = True
    return flags


#: Space and the control characters from tab to carriage return.
BLANKS = _separators([32, *range(9, 14)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each ordered pair of hashes. No polynomial of them: each level of a longer hash is scrambled, so that no pattern of the words cancels out."""
    return mix(left * _PAIR_KEY + (right ^ _SPAN_KEY))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``most`` bytes of text at most."""
    if batch.num_rows == 0:
        return
    _, offsets = flat(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of a chunk's texts.

    ``starts``/``ends``: byte positions in ``data``, which is lower-cased (A-Z)
    where asked for; ``first[i]:first[i + 1]`` are the words of text i;
    ``hashes``: a 64-bit hash for each word.
    """

    def __init__(self, column: pa.Array, lower: bool = False, separators: np.ndarray = BLANKS) -> None:
        self.data, self.offsets = flat(column)
        if lower:
            self.data = _LOWER[self.data]
        data, offsets = self.data, self.offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~separators[data]
        body = inside[1:-1]
        opens, closes = body & ~inside[:-2], body & ~inside[2:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges] |= body[edges]
        closes[edges - 1] |= body[edges - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self._hashes: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self._hashed()
        return self._hashes

    def _hashed(self) -> np.ndarray:
        sizes = self.ends - self.starts
        eights = np.lib.stride_tricks.sliding_window_view(np.append(self.data, np.zeros(8, np.uint8)), 8)
        out = mix(sizes.astype(U64) + U64(_WORD_KEY))
        at, done = np.flatnonzero(sizes <= SHORT), 0
        while len(at):
            part = np.ascontiguousarray(eights[self.starts[at] + done]).view("<u8")[:, 0] & _HELD[np.minimum(sizes[at] - done, 8)]
            out[at] = mix(out[at] ^ part)
            done += 8
            at = at[sizes[at] > done]
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), _WORD_KEY)
        return out

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, key: int = 0) -> np.ndarray:
        """A hash for each run of words from ``starts`` to before ``ends``; equal runs of words have equal hashes anywhere. Other keys give independent hashes.

        A run is put together of runs of 1, 2, 4, ... words, those whose sizes add up to its own.
        """
        sizes, at = ends - starts, starts.copy()
        out, have = mix(sizes.astype(U64) + U64(key)), 1
        level, most = mix(self.hashes ^ U64(key)), int(sizes.max(initial=0))
        while have <= most:
            if (sizes & have == have).all():
                out, at = pair(out, level[at]), at + have
            else:
                some = np.flatnonzero(sizes & have)
                out[some] = pair(out[some], level[at[some]])
                at[some] += have
            if 2 * have <= most:
                level = pair(level[:-have], level[have:])
            have *= 2
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every run of n words inside one text."""
        starts = np.arange(max(0, len(self) - n + 1))
        starts = starts[self.text_of(starts) == self.text_of(starts + n - 1)] if len(starts) else starts
        return starts, self.span_hashes(starts, starts + n)

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The text that each word is of."""
        if not hasattr(self, "_texts"):
            self._texts = np.repeat(np.arange(len(self.counts)), self.counts)
        return self._texts[words]


def strings(data: np.ndarray, mask: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The bytes under ``mask``, as strings divided at ``offsets``."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(sums[offsets])), pa.py_buffer(data[mask])]).cast(pa.string())


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in some range from ``starts`` to before ``ends``."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The words with the given numbers, ascending, of each text, joined by single spaces."""
    mask = covered(len(words.data), words.starts[kept], words.ends[kept])
    data = words.data.copy()
    text = words.text_of(kept) if len(kept) else kept
    inner = words.ends[kept[:-1]][text[:-1] == text[1:]] if len(kept) else kept
    mask[inner], data[inner] = True, 32
    return strings(data, mask, words.offsets)


def exact_ids(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words only (by the words' bytes, not by hashes)."""
    sums = np.zeros(len(words) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=sums[1:])
    held = words.data[covered(len(words.data), words.starts, words.ends)]
    told = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(sums), pa.py_buffer(held)])
    return np.asarray(told.dictionary_encode().indices).astype(np.int64)


def exact_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, number) of every run of n words inside one text; numbers are equal for equal runs only, by the words themselves."""
    names, have = exact_ids(words), 1
    for bit in bin(n)[3:]:  # the size is doubled, and where the next binary digit is 1 grows by a word
        for step, other in [(have, names)] + ([(2 * have, exact_ids(words))] if bit == "1" else []):
            size = min(len(names), max(0, len(other) - step))
            names = np.unique(names[:size] * (len(words) + 1) + other[step : step + size], return_inverse=True)[1].astype(np.int64)
        have = 2 * have + (bit == "1")
    starts = np.arange(max(0, len(words) - n + 1))
    whole = words.text_of(starts) == words.text_of(starts + n - 1) if len(starts) else np.zeros(0, bool)
    return starts[whole], names[: len(starts)][whole]


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    have, out = 1, x
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)
