"""Words and segments of whole Arrow batches of text as 64-bit hashes, without a Python loop per word.

A hash is a sum over the bytes of a random 64-bit number per byte value times a power of an odd base,
mixed at the end. Prefix sums over a stretch of text then give all hashes of its words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time; a single longer word is hashed alone.
STRETCH = 1 << 20

#: Bytes of text that one step of an operator handles; a longer text makes a step of its own.
STEP_BYTES = 2 << 20

_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of each 64-bit number over the whole number."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STRETCH + 1)
        one = np.ones(1, np.uint64)
        _POWERS["up"] = np.concatenate([one, np.cumprod(np.full(size - 1, _BASE))])
        _POWERS["down"] = np.concatenate([one, np.cumprod(np.full(size - 1, _BASE_INVERSE))])
    return _POWERS["up"], _POWERS["down"]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end] for ascending spans that do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STRETCH, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo)
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s])
        i = j
    return out


class Texts:
    """The texts of a part of a batch: `buf` holds their bytes, text i is buf[at[i]:at[i + 1]]."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        n = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        self.buf = (
            np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])) if data is not None else np.zeros(0, np.uint8)
        )
        self.at = at - at[0]
        self.n = n

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words `[^\\x20\\x09-\\x0D]+`, and the first word of each text (n + 1 numbers)."""
        if not len(self.buf):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        inside = ~_SPACE[self.buf]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        border = self.at[:-1][np.diff(self.at) > 0]
        first[border] = inside[border]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[border[1:] - 1] = inside[border[1:] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.at)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words with A-Z lowered, and the first word of each text."""
        starts, ends, first = self.words()
        return hash_spans(LOWER[self.buf], starts, ends), first


def steps(batch: pa.RecordBatch, text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has at most `limit` bytes of text or one row."""
    size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size.astype(np.int64))
    i = 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + limit, "right")))
        yield batch.slice(i, j - i)
        i = j


def shingles(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the first shingle of each text.

    A text with fewer than k words, but at least one, has its whole sequence as its only shingle.
    """
    n = np.diff(first)
    up, _ = _powers(max(k, 2) + 1)
    many = len(words) - k + 1
    if many > 0:
        h = np.zeros(many, np.uint64)
        for j in range(k):
            h += words[j : many + j] * up[j + 1]
        keep = np.zeros(len(words) + 1, np.int32)  # +1 where a text's shingles begin, -1 behind the last
        long = n >= k
        np.add.at(keep, first[:-1][long], 1)
        np.add.at(keep, first[1:][long] - k + 1, -1)
        h = mix(h)[np.cumsum(keep[:many]) > 0]
    else:
        h = np.zeros(0, np.uint64)
    counts = np.maximum(n - k + 1, 0)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            whole[has] += words[first[short[has]] + j] * up[j + 1]
        whole = mix(whole + n[short].astype(np.uint64))
        where = np.concatenate([[0], np.cumsum(counts)])[short]
        h = np.insert(h, where, whole)
        counts[short] = 1
    return h, np.concatenate([[0], np.cumsum(counts)])


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order, their counts, and the first of each text."""
    v = values.copy()
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        v[i:j].sort()
    t = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    where = np.flatnonzero(new)
    counts = np.diff(np.append(where, len(v)))
    return v[where], counts, np.searchsorted(t[where], np.arange(len(first)))


def gather(values: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs values[first[w]:first[w + 1]] for each w; also where each begins."""
    n = np.diff(first)[which]
    at = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1][which], n)
    return values[index], at
