"""Harmonic packing of token sequences into bins of one fixed capacity.

Lengths fall into reciprocal classes: class k holds pieces of capacity // k ids, and k of them fill a bin. A document
is cut into full bins and then into the largest class that fits what is left, so that every piece has exactly the
length of its class. A bin's contents then follow from a piece's number within its class alone: bin = number // k,
offset = (number % k) * length. No task has to see another task's pieces.

1. `cut` tokenises every whole text once (Arrow batches in) and numbers the pieces of each class within its task.
2. The counts per task and class (not the pieces) are summed up to give each task its first number.
3. The few pieces of each class that fill no whole bin, at most k - 1 of them whatever the input, are put together
   by first fit from the longest down. Their number is bounded by the capacity; only their counts reach the driver.

Defined cases: a NULL or empty text is a document of one id, the closing 0; documents with a NULL id, and repeated
ids, are packed like others; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywing.llm.common import Scratch
from tallywing.llm.spans import Texts, gather, hash_spans, steps

CAPACITY = 1024

#: The id that closes a document.
CLOSE = 0

#: Segments whose ids a task remembers; beyond them it starts anew.
REMEMBERED = 1_000_000

_SAFE = np.zeros(256, bool)  # first bytes of characters that are no white space in any alphabet
_SAFE[0x21:0x7F] = True
_SAFE[0xC3:0xF5] = True
_SAFE[0xE1:0xE4] = False


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True

#: How these tokenizers cut a text before they merge bytes: a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_character() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: visible ones as they are, others from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Ids of many texts by a byte-level BPE tokenizer file, each different segment encoded once.

    The tokenizer never joins what stands on both sides of a space before a visible character, of a line end, or of a
    full stop behind a letter, so a text's ids are those of its segments in order. Segments are encoded by tiktoken
    with the ranks of the same file, which takes a quarter of the time. A text with the string of a special token is
    one segment and goes through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte = byte_of_character()
        ranks = {
            bytes(byte[c] for c in word): i for word, i in self.tokenizer.get_vocab().items() if word not in self.special
        }
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _starts(self, t: Texts) -> np.ndarray:
        buf, at = t.buf, t.at
        before, cur, after = np.roll(buf, 1), buf, np.roll(buf, -1)
        cut = (((cur == 0x20) | (cur == 0x0A)) & _SAFE[after]) | ((before == 0x0A) & _SAFE[cur])
        cut |= ((cur == 0x2E) | (cur == 0x2C)) & _ASCII_LETTER[before]
        some = np.flatnonzero(np.diff(at) > 0)
        last = at[some + 1] - 1
        cut[last] &= (cur[last] != 0x20) & (cur[last] != 0x0A)  # what follows stands in another text
        raw = None
        for s in self.special:
            raw = buf.tobytes() if raw is None else raw
            place = raw.find(s.encode())
            while place >= 0:
                i = int(np.searchsorted(at, place, "right")) - 1
                cut[at[i] : at[i + 1]] = False
                place = raw.find(s.encode(), int(at[i + 1]))
        cut[at[some]] = True
        return np.flatnonzero(cut)

    def _ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and the first of each text."""
        if not len(t.buf):
            return np.zeros(0, np.uint32), np.zeros(t.n + 1, np.int64)
        starts = self._starts(t)
        ends = np.append(starts[1:], len(t.buf))
        keys, where, which = np.unique(hash_spans(t.buf, starts, ends), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new) and len(new) + len(self.keys) > REMEMBERED:
            self.forget()
            new = np.arange(len(keys))
        if len(new):
            raw = t.buf.tobytes()
            texts = [raw[i:j].decode() for i, j in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            found = [self._ids(x) for x in texts]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            slots = len(self.at) - 1 + np.arange(len(new))
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum()))])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
            into = np.searchsorted(self.keys, keys[new])
            self.keys, self.slots = np.insert(self.keys, into, keys[new]), np.insert(self.slots, into, slots)
        slot = self.slots[np.searchsorted(self.keys, keys)]
        ids, at = gather(self.flat, self.at, slot[which])
        return ids, at[np.searchsorted(starts, t.at)]


def class_length(k: int, capacity: int = CAPACITY) -> int:
    return capacity // k


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids: each the longest class length that still fits."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        out.append(capacity // (capacity // (n + 1) + 1))
        n -= out[-1]
    return out


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, task, number): number counts a length's pieces within a task."""
    rest = [cuts(n, capacity) for n in range(capacity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, numbers = Encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        closed = np.array([CLOSE], "<u4")
        for batch in batches:
            for part in steps(batch, "text"):
                ids, first = encoder.encode(Texts(part.column("text")))
                ids = ids.astype("<u4")
                rows: list[tuple] = []
                for doc, i, j in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own, total, start = np.concatenate([ids[i:j], closed]), j - i + 1, 0
                    for n in [capacity] * (total // capacity) + rest[total % capacity]:
                        rows.append((doc, start, n, zlib.crc32(own[start : start + n]), total, task, int(numbers[n])))
                        numbers[n] += 1
                        start += n
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.record_batch(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "number"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, number long"
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Bins of whole classes and places of the rest, from the number of pieces of each length.

    Gives {length: (first bin, pieces in whole bins)} and, for the others, rows (length, number, bin, offset).
    """
    whole, rest, bins = {}, [], 0
    for length in sorted(counts, reverse=True):
        k = capacity // length
        whole[length] = (bins, counts[length] // k * k)
        bins += counts[length] // k
    room: list[int] = []
    for length in sorted(counts, reverse=True):
        for number in range(whole[length][1], counts[length]):
            b = next((i for i, free in enumerate(room) if free >= length), len(room))
            if b == len(room):
                room.append(capacity)
            rest.append((length, number, bins + b, capacity - room[b]))
            room[b] -= length
    return whole, rest


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row per piece.

    `path` is a tokenizer file that every executor has. The pieces are written to the shared folder once, so their
    numbers stay the same however often the result is read.
    """
    spark = docs.sparkSession
    pieces, _ = Scratch(spark, "packing").write(cut(docs, path, capacity), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # One row per length: at most 2 * sqrt(capacity) rows, and fewer than capacity * (log(capacity) + 1) places.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole, rest = plan(counts, capacity)
    classes = spark.createDataFrame(
        [(length, b, n) for length, (b, n) in whole.items()], "length long, first_bin long, in_whole long"
    )
    places = spark.createDataFrame(rest, "length long, nr long, rest_bin long, rest_offset long")
    k = F.expr(f"{capacity} div length")
    nr = F.col("nr")
    return (
        pieces.join(starts, ["task", "length"])
        .withColumn("nr", F.col("before") + F.col("number"))
        .join(F.broadcast(classes), "length")
        .join(F.broadcast(places), ["length", "nr"], "left")
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            F.coalesce("rest_bin", F.col("first_bin") + F.floor(nr / k)).alias("sequence_id"),
            F.coalesce("rest_offset", F.pmod(nr, k) * F.col("length")).alias("offset"),
        )
    )
