"""Tables of bounded size that thin rows out before a shuffle. They never decide a result: what they let through by
chance, the join behind them drops. A table has ROOM entries for each of its keys, within bounds, so that it lets through as
few others of a large corpus as of a small one.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries for each key.
ROOM = 16

#: Entries of a table, one byte each, at least and at most.
SLOTS, MOST_SLOTS = 1 << 21, 1 << 25


def _entries(keys: int, least: int, most: int) -> int:
    """ROOM for each key, as a power of two."""
    return min(max(1 << (ROOM * keys - 1).bit_length(), least), most)


class Levels:
    """For each slot (key modulo their number) the largest ceil(log2(n)) + 1 of its keys; 0 where there is none.

    Sent to tasks compressed: a table of few keys is small.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    def __reduce__(self):
        return _unpack, (zlib.compress(self.table.tobytes(), 1),)

    def at(self, keys: np.ndarray) -> np.ndarray:
        """The entries of uint64 or int64 keys."""
        return self.table[keys.astype(np.uint64) & np.uint64(len(self.table) - 1)]


def _unpack(raw: bytes) -> Levels:
    return Levels(np.frombuffer(zlib.decompress(raw), np.uint8))


def levels(counts: DataFrame, key: str = "key", n: str = "n") -> Levels:
    """The table of the rows (key, n). At most a row per slot comes to the driver."""
    level = (F.ceil(F.log2(F.col(n).cast("double"))) + 1).cast("int")
    slots = _entries(counts.count(), SLOTS, MOST_SLOTS)
    rows = counts.groupBy(F.pmod(F.col(key), F.lit(slots)).cast("int").alias("slot")).agg(F.max(level).alias("level")).toArrow()
    table = np.zeros(slots, np.uint8)
    table[rows.column("slot").to_numpy()] = rows.column("level").to_numpy()
    return Levels(table)


def table_of(keys: np.ndarray, values: np.ndarray) -> Levels:
    """The table of a driver's keys; where several share a slot, it has the largest value."""
    table = np.zeros(_entries(len(keys), SLOTS, MOST_SLOTS), np.uint8)
    np.maximum.at(table, keys & np.uint64(len(table) - 1), values.astype(np.uint8))
    return Levels(table)


#: Bits of a membership table, at least (8 MB) and at most (32 MB).
BITS, MOST_BITS = 1 << 26, 1 << 28


class Members:
    """A bit per key modulo the number of bits. Keys in the set are always found, others seldom while the set is far smaller."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def __reduce__(self):
        return _unpack_members, (zlib.compress(self.words.tobytes(), 1),)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = keys.astype(np.uint64) & np.uint64(len(self.words) * 64 - 1)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0


def _unpack_members(raw: bytes) -> Members:
    return Members(np.frombuffer(zlib.decompress(raw), np.uint64))


def members(keys: DataFrame, key: str = "key") -> Members:
    """The table of a long column. Bits are combined in Spark; at most MOST_BITS / 64 rows come to the driver."""
    bits = _entries(keys.count(), BITS, MOST_BITS)
    bit = F.pmod(F.col(key), F.lit(bits))
    word = F.shiftright(bit, 6).cast("int").alias("word")
    rows = keys.select(word, F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("b")).groupBy("word").agg(F.bit_or("b").alias("b"))
    found = rows.toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("word").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return Members(words)
