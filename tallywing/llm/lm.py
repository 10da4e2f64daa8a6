"""Language-model scoring by deleted interpolation of n-gram estimates.

The chance of a token is a mixture of its maximum-likelihood estimates of order n down to 1 and of the uniform chance. The weights
depend on how often the context occurred (a bucket per power of two) and are learnt by expectation-maximisation:
every training token is held out in turn, its estimates being taken from the counts without it.

Counts move as packed columns, not as rows. A chunk is the texts of one step of a task. Its different n-grams go to
`parts` by ranges of their hash, each once, as sorted differences in byte planes with the chunk's own count; a part sums
them up and answers each chunk in the order it asked. So no n-gram is hot (a chunk sends it once). A chunk and a part
exchange one message each way: chunks and parts both grow with the square root of the input (`sizes`), so messages stay as
long and their number is in proportion to the input, up to GROWN times the least sizes.

1. `chunks` writes tokens as codes into each chunk's vocabulary.
2. `asked` and `answers` exchange counts; `counted` writes each token's counts of every order.
3. The statistics of the held-out estimates, a table of bounded size over all training tokens, go to the driver for EM.
4. `scores` sums up each text.

Defined cases: a NULL text is empty; an empty text has one token, the end; rows with a NULL id or with equal ids are scored
each; an empty training set gives every token the uniform chance; an empty table gives an empty result; texts of any length
are scored whole; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import Scratch, fold, small_batches
from tallywing.llm.spans import Texts, mix, steps

#: Order of the model by default; 1, 2 and 3 are possible.
ORDER = 2

#: Bytes of text in a chunk, at least.
CHUNK_BYTES = 3 << 19

#: Bytes that the n-grams of one part take, about, at least.
PART_BYTES = 4 << 20

#: Chunks and parts are larger by the square root of the text over this many bytes, but GROWN times at most.
BASE_BYTES = 1 << 30
GROWN = 6

#: Bytes of messages that a task hands over at a time, about.
SEND_BYTES = 2 << 20

#: Held-out estimates are counted in steps of this many to a doubling; only the weights depend on it.
FINENESS = 8

#: Stands for an estimate of 0.
NONE = -10_000

EM_ROUNDS = 60

END, START = np.uint64(0x452821E638D01377), np.uint64(0xBE5466CF34E90C6C)


def sizes(text_bytes: int) -> tuple[int, int]:
    """Bytes of text in a chunk and of n-grams in a part, for a table with so many bytes of text."""
    grown = min(max(math.sqrt(text_bytes / BASE_BYTES), 1), GROWN)
    return int(CHUNK_BYTES * grown), int(PART_BYTES * grown)


def pack(values: np.ndarray) -> bytes:
    """64-bit numbers as planes of their bytes, as many as the largest number has, behind the number of planes."""
    width = max((int(values.max()).bit_length() + 7) // 8, 1) if len(values) else 1
    planes = np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8)[1:].reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    for i, plane in enumerate(planes):
        out[:, i] = plane
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that have about `limit` bytes of text, or one row."""
    open_: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in steps(batch, "text", max(limit // 8, 1)):
            own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if open_ and size + own > limit:
                yield from pa.Table.from_batches(open_).combine_chunks().to_batches()
                open_, size = [], 0
            open_.append(part)
            size += own
    if open_:
        yield from pa.Table.from_batches(open_).combine_chunks().to_batches()


def chunks(docs: DataFrame, held_out: Column, chunk_bytes: int) -> DataFrame:
    """(chunk, doc_ids, held, lengths, vocabulary, codes, tokens, train, texts): tokens of a chunk's texts and their number, `train` and
    `texts` counting training tokens and texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in gathered(batches, chunk_bytes):
            hashes, first = Texts(part.column("text")).word_hashes()
            n = np.diff(first) + 1
            tokens = np.insert(hashes, first[1:], END)
            vocabulary, codes = np.unique(tokens, return_inverse=True)
            held = part.column("held").fill_null(False).to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                [
                    pa.array([number], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([held.tolist()], pa.list_(pa.bool_())), pa.array([n.tolist()], pa.list_(pa.int64())),
                    pa.array([pack_sorted(vocabulary)], pa.binary()), pa.array([pack(codes)], pa.binary()), pa.array([len(codes)], pa.int64()),
                    pa.array([int(n[~held].sum())], pa.int64()), pa.array([int((~held).sum())], pa.int64()),
                ],
                ["chunk", "doc_ids", "held", "lengths", "vocabulary", "codes", "tokens", "train", "texts"],
            )
            number += 1

    schema = (
        "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, vocabulary binary, codes binary, "
        "tokens long, train long, texts long"
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


class Chunk:
    """The n-grams of a chunk: per order the different ones, and which of them each token ends."""

    def __init__(self, row: dict, order: int):
        vocabulary, codes = unpack_sorted(row["vocabulary"]), unpack(row["codes"])
        self.lengths = np.array(row["lengths"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.train = np.repeat(~np.array(row["held"], bool), self.lengths)
        token = vocabulary[codes]
        place = np.arange(len(token)) - np.repeat(self.first[:-1], self.lengths)
        self.starts = place  # tokens before this one in its text
        self.keys, self.which = [], []
        gram = token
        for o in range(1, order + 1):
            if o > 1:
                # The token o - 1 places back, or the start of the text for all places before it.
                back = np.where(place >= o - 1, token[np.maximum(np.arange(len(token)) - o + 1, 0)], START)
                gram = mix(gram ^ mix(back + np.uint64(o)))
            keys, which = np.unique(gram, return_inverse=True)
            self.keys.append(keys)
            self.which.append(which)


def asked(chunked: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, chunk, keys, counts): of each order, the chunk's different n-grams in the part's range and its own training counts."""
    # A key's part is the product of its upper half and `parts`, over 2 ** 32; these are the least keys of each.
    least = ((np.arange(parts, dtype=np.uint64) << np.uint64(32)) + np.uint64(parts - 1)) // np.uint64(parts) << np.uint64(32)

    def message(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()))
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "chunk", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = Chunk(row, order)
                counts = [np.bincount(w[c.train], minlength=len(k)).astype(np.uint64) for k, w in zip(c.keys, c.which, strict=True)]
                cuts = [np.append(np.searchsorted(k, least), len(k)).tolist() for k in c.keys]
                out, size = [], 0
                for p in range(parts):
                    own = [slice(x[p], x[p + 1]) for x in cuts]
                    if any(x.stop > x.start for x in own):
                        keys = [pack_sorted(k[x]) for k, x in zip(c.keys, own, strict=True)]
                        out.append((p, row["chunk"], keys, [pack(n[x]) for n, x in zip(counts, own, strict=True)]))
                        size += sum(map(len, keys))
                    if size > SEND_BYTES:
                        yield message(out)
                        out, size = [], 0
                if out:
                    yield message(out)

    return chunked.select("chunk", "held", "lengths", "vocabulary", "codes").mapInArrow(
        run, "part long, chunk long, keys array<binary>, counts array<binary>"
    )


def answers(questions: DataFrame, order: int) -> DataFrame:
    """(chunk, part, totals, known): of each order, counts over all chunks, in the order of the keys asked; `known`, in a row
    with chunk -1, is the number of different training n-grams of the part.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part, asking = table.column("part")[0].as_py(), table.column("chunk").to_pylist()
        totals: list[list[bytes]] = [[] for _ in asking]
        known = []
        for o in range(order):
            keys = [unpack_sorted(x) for x in pc.list_element(table.column("keys"), o).to_pylist()]
            cuts = np.cumsum([0, *map(len, keys)])
            every = np.concatenate(keys)
            by = np.argsort(every)
            every = every[by]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else by
            counts = np.concatenate([unpack(x) for x in pc.list_element(table.column("counts"), o).to_pylist()])
            summed = np.add.reduceat(counts[by], first) if len(every) else counts
            known.append(int((summed > 0).sum()))
            total = np.empty(len(every), np.uint64)
            total[by] = np.repeat(summed, np.diff(np.append(first, len(every))))
            for own, i, j in zip(totals, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own.append(pack(total[i:j]))
        rows = [*zip(asking, [part] * len(asking), totals, [None] * len(asking), strict=True), (-1, part, None, known)]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["chunk", "part", "totals", "known"])

    return questions.groupBy("part").applyInArrow(run, "chunk long, part long, totals array<binary>, known array<long>")


def counted(chunked: DataFrame, replies: DataFrame, order: int) -> DataFrame:
    """(doc_ids, held, lengths, c1..): for every token its training count of each order, packed one after another."""
    per = replies.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "totals")).alias("replies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c = Chunk(row, order)
                found = sorted(row["replies"], key=lambda r: r["part"])  # parts are ranges of keys
                counts = []
                for o, which in enumerate(c.which):
                    total = np.concatenate([unpack(r["totals"][o]) for r in found])
                    counts.append(pa.array([pack(total[which])], pa.binary()))
                yield pa.record_batch(
                    [batch.slice(i, 1).column(x) for x in ("doc_ids", "held", "lengths")] + counts,
                    ["doc_ids", "held", "lengths", *(f"c{o}" for o in range(1, order + 1))],
                )

    columns = ", ".join(f"c{o} binary" for o in range(1, order + 1))
    rows = chunked.select("chunk", "doc_ids", "held", "lengths", "vocabulary", "codes").join(per, "chunk")
    return rows.mapInArrow(run, f"doc_ids array<long>, held array<boolean>, lengths array<long>, {columns}")


class Estimates:
    """Per token of a counted row: the bucket of each context and the estimates of each order."""

    def __init__(self, row: dict, order: int, texts: int):
        self.lengths = np.array(row["lengths"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.counts = [unpack(row[f"c{o}"]).astype(np.float64) for o in range(1, order + 1)]
        n = len(self.counts[0])
        place = np.arange(n) - np.repeat(self.first[:-1], self.lengths)
        # The context of order o is the n-gram of order o - 1 that the token before ends; at the start of a text, the text.
        self.context = [None] + [
            np.where(place > 0, np.roll(self.counts[o - 2], 1), float(texts)) for o in range(2, order + 1)
        ]
        self.held = np.repeat(np.array(row["held"], bool), self.lengths)

    def bucket(self, deleted: bool) -> np.ndarray:
        """0 for a context that never occurred, else one more than its count's power of two."""
        c = (self.context[-1] if len(self.context) > 1 else np.full(len(self.held), 1.0)) - deleted
        return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)

    def chances(self, total: int, deleted: bool) -> list[np.ndarray]:
        """Estimates of orders 1 and up; 0 where the context never occurred."""
        out = []
        for o, c in enumerate(self.counts):
            context = np.full(len(c), float(total)) if o == 0 else self.context[o]
            context = context - deleted
            out.append(np.where(context > 0, np.maximum(c - deleted, 0) / np.maximum(context, 1), 0.0))
        return out


def held_out_statistics(rows: DataFrame, order: int, total: int, texts: int, uniform: float) -> DataFrame:
    """(bucket, s1.., n): training tokens by bucket and by each estimate's ratio to the uniform chance, in steps of
    1 / FINENESS of a doubling. Each token's estimates leave that token out. At most a few ten thousand rows.
    """
    names = [f"s{o}" for o in range(1, order + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                e = Estimates(batch.slice(i, 1).to_pylist()[0], order, texts)
                code = e.bucket(True)  # a cell as one number, 16 bits to an estimate
                for q in e.chances(total, True):
                    step = np.where(q > 0, np.round(np.log2(np.maximum(q, 1e-300) / uniform) * FINENESS), NONE).astype(np.int64)
                    code = (code << 16) + (step + (1 << 15))
                found, n = np.unique(code[~e.held], return_counts=True)
                cells = [pa.array(found >> (16 * order))]
                cells += [pa.array(((found >> (16 * j)) & 0xFFFF) - (1 << 15)) for j in reversed(range(order))]
                yield pa.record_batch([*cells, pa.array(n)], ["bucket", *names, "n"])

    schema = ", ".join(f"{x} long" for x in ("bucket", *names, "n"))
    return rows.mapInArrow(run, schema).groupBy("bucket", *names).agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, order: int, rounds: int = EM_ROUNDS) -> dict[int, np.ndarray]:
    """{bucket: weights of the uniform chance and of orders 1 and up} by expectation-maximisation."""
    out = {}
    for b in np.unique(cells[:, 0]).tolist():
        own = cells[cells[:, 0] == b]
        steps_, n = own[:, 1 : order + 1], own[:, -1].astype(float)
        q = np.concatenate([np.ones((len(own), 1)), np.where(steps_ > NONE, np.exp2(steps_ / FINENESS), 0.0)], axis=1)
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            share = q * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) / n.sum()
        w = np.maximum(w, 1e-6)
        out[b] = w / w.sum()
    return out


def weight_table(learnt: dict[int, np.ndarray], order: int, buckets: int = 64) -> np.ndarray:
    """Weights of every bucket; one without training tokens takes those of the nearest bucket below, else an even split."""
    table = np.full((buckets, order + 1), 1 / (order + 1))
    last = None
    for b in range(buckets):
        last = learnt.get(b, last)
        if last is not None:
            table[b] = last
    return table


def scores(rows: DataFrame, order: int, total: int, words: int, texts: int, table: np.ndarray) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                e = Estimates(row, order, texts)
                weights, q = table[e.bucket(False)], e.chances(total, False)
                chance = weights[:, 0] / (words + 1)
                missing = np.zeros(len(chance))
                for o in range(order):
                    known = np.ones(len(chance), bool) if o == 0 else e.context[o] > 0
                    chance = chance + weights[:, o + 1] * np.where(known, q[o], 0)
                    missing = missing + weights[:, o + 1] * ~known
                # An order whose context never occurred gives its weight to the uniform chance: all chances sum to one.
                chance = chance + missing / (words + 1)
                first = e.first[:-1]
                base = np.log10((e.counts[0] + 1) / (total + words + 1))
                yield pa.record_batch(
                    [
                        batch.column("doc_ids").slice(i, 1).flatten(), batch.column("held").slice(i, 1).flatten(),
                        pa.array(e.lengths), pa.array(np.add.reduceat(e.counts[0] > 0, first, dtype=np.int64)),
                        pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(chance), first)),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, held_out: Column | None = None, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learnt from those that
    aren't held out (by default, those whose crc32 of the id is not 2 modulo 7).
    """
    with small_batches(docs.sparkSession):
        return _score_documents(docs, held_out, order)


def _score_documents(docs: DataFrame, held_out: Column | None, order: int) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    held_out = fold("doc_id", 7) == 2 if held_out is None else held_out
    chunk_bytes, part_bytes = sizes(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    chunked, chunk_path = scratch.write(chunks(docs, held_out, chunk_bytes), "chunks")
    sums = chunked.agg(F.sum("train").alias("n"), F.sum("texts").alias("t"), F.sum("tokens").alias("b")).first()
    total, texts = sums["n"] or 0, sums["t"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((sums["b"] or 0) * 9 * (order - 0.5) / part_bytes))
    replies, reply_path = scratch.write(answers(asked(chunked, order, parts), order), "replies")
    words = replies.where("chunk = -1").agg(F.sum(F.col("known")[0])).first()[0] or 0
    rows, rows_path = scratch.write(counted(chunked, replies, order), "counted")
    scratch.drop(chunk_path, reply_path)
    cells = held_out_statistics(rows, order, total, texts, 1 / (words + 1)).toArrow()
    learnt = learn_weights(np.stack([cells.column(x).to_numpy() for x in cells.column_names], axis=1), order) if len(cells) else {}
    out, _ = scratch.write(scores(rows, order, total, words, texts, weight_table(learnt, order)), "scores")
    scratch.drop(rows_path)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
