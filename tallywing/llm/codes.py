"""Codes for vectors: product quantisation in whole numbers, nearest entries found by Orchard's search.

Components become floor(1024 * x), a vector is cut into four equal parts, and each position has a codebook of at most 256
entries, first the parts of the smallest ids. A round of `fit_codebooks` assigns every part of every vector to its nearest
entry, ties to the lower index, and replaces each entry by the floored mean of its parts; an unused one stays. A task sends one row
of sums per position and entry, so a round shuffles and collects a fixed number of rows a task however large the table.

Orchard's search goes from an entry along the list of all entries sorted by their distance from it. An entry nearer to the
vector's part is jumped to, and its own list begins; entries looked at once are marked and not looked at again. Beyond twice the
current distance no entry can be as near, so the search ends there. `nearest` does this for many parts at a time: those
at the same entry walk its list together, a few entries at a step.

All arithmetic is exact: in doubles while every sum stays below 2**53, else in 64-bit integers.

Defined cases: vectors that are NULL or hold NULL or non-finite components are dropped, as the contract says; so are empty vectors
and those whose length isn't a multiple of four or differs from that of the smallest kept id, since they have no such
parts. Components so large that a squared distance would leave 64 bits are clamped (beyond 2**17 for 64 components). With fewer than
256 vectors a codebook has fewer entries. Rows with equal ids are encoded each; as first entries they stand in the order of their
components. A NULL id is encoded but gives no first entry; if there are only such rows, their smallest vectors do. Equal
vectors get equal codes. An empty table gives an empty result. Columns other than vec_id, embedding and label aren't read. A sum
of errors over a label that leaves 64 bits is NULL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

#: Entries of a list that are looked at in one step, and entries of which the nearest one is where a search begins.
STEP, PILOTS = 64, 16

#: Labels whose sums are sent to every executor, at most.
LABELS = 1_000_000


@dataclass(frozen=True)
class Book:
    """The entries of one position, their distances from each other, and for each entry all of them by distance."""

    entries: np.ndarray
    apart: np.ndarray
    lists: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Book:
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        return cls(entries, apart, np.argsort(apart, axis=1, kind="stable"))


def nearest(book: Book, parts: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of every part, its squared distance, and how many distances were computed."""
    n, size = len(parts), len(book.entries)
    entries = book.entries
    largest = max(int(np.abs(entries).max(initial=0)), int(np.abs(parts).max(initial=0)))
    if largest**2 * 4 * max(parts.shape[1], 1) < 1 << 52:
        parts, entries = parts.astype(np.float64), entries.astype(np.float64)  # exact, and products of matrices are fast
    own_square, entry_square = (parts * parts).sum(axis=1), (entries * entries).sum(axis=1)
    seen = np.zeros((n, size), bool)
    rows = np.arange(n)
    if start is None:
        pilots = np.arange(0, size, max(size // PILOTS, 1))
        d = own_square[:, None] - 2 * (parts @ entries[pilots].T) + entry_square[pilots][None, :]
        at, far, looked = pilots[d.argmin(axis=1)], d.min(axis=1), d.size
        seen[:, pilots] = True
    else:
        at, looked = start.astype(np.int64), n
        far = own_square - 2 * (parts * entries[at]).sum(axis=1) + entry_square[at]
        seen[rows, at] = True
    best = at.copy()
    most = np.inf if parts.dtype == np.float64 else np.iinfo(np.int64).max
    # Parts that wait for the list of their entry; a round takes the waiting ones of one entry after the other.
    while len(rows):
        rows = rows[np.argsort(at[rows], kind="stable")]
        begins = np.flatnonzero(np.diff(at[rows], prepend=-1))
        moved_on = []
        for here in np.split(rows, begins[1:]):
            c = at[here[0]]
            order = book.lists[c]
            gap = book.apart[c][order]
            for i in range(0, size, STEP):
                # The list is done for a part once the next entry is beyond twice its distance (four times the square).
                reach = 4 * far[here]
                on = gap[i] <= reach
                if not on.all():
                    here, reach = here[on], reach[on]
                    if not len(here):
                        break
                these = order[i : i + STEP]
                cell = here[:, None] * size + these[None, :]
                fresh = ~seen.ravel()[cell] & (gap[None, i : i + STEP] <= reach[:, None])
                looked += int(np.count_nonzero(fresh))
                seen.ravel()[cell[fresh]] = True
                d = own_square[here][:, None] - 2 * (parts[here] @ entries[these].T) + entry_square[these][None, :]
                d[~fresh] = most
                near, now = d.min(axis=1), far[here]
                close = near <= now
                if not close.any():
                    continue
                index = np.where(d[close] == near[close][:, None], these[None, :], size).min(axis=1)
                to = here[close]
                # Equally near: the lower index counts, the list goes on. Nearer: on to that entry's list.
                jump = near[close] < now[close]
                tie = ~jump & (index < best[to])
                best[to[tie]] = index[tie]
                if jump.any():
                    gone = to[jump]
                    far[gone] = near[close][jump]
                    best[gone] = at[gone] = index[jump]
                    moved_on.append(gone)
                    stay = np.ones(len(here), bool)
                    stay[np.flatnonzero(close)[jump]] = False
                    here = here[stay]
                    if not len(here):
                        break
        rows = np.concatenate(moved_on) if moved_on else rows[:0]
    return best, far.astype(np.int64), looked


def _clamp(size: int) -> int:
    """The largest power of two for which squared distances of vectors of this size fit into 62 bits."""
    return 1 << ((60 - max(size, 1).bit_length() + 1) // 2)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): the vectors that can be encoded, in whole numbers; `x` has the length of the smallest id's."""
    x = F.col("embedding")
    known = F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label")
    rows = vectors.select(*known, x.cast("array<double>").alias("embedding")).where(
        "size(embedding) > 0 and size(embedding) % 4 = 0"
        " and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"
    )
    smallest = rows.groupBy().agg(F.min_by(F.size("embedding"), F.struct(F.col("vec_id").isNull(), "vec_id", "embedding")).alias("n")).first()
    length = (smallest and smallest["n"]) or 0
    most = float(_clamp(length))
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c * F.lit(float(SCALE)), F.lit(most)), F.lit(-most))).cast("int"))
    return rows.where(F.size("embedding") == length).select("vec_id", "label", whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with their numbers, about `limit` of these at a time: parts at one entry then come in large groups."""

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.concat_batches(parts)
        return whole, _matrix(whole.column("x"))

    waiting, size = [], 0
    for batch in batches:
        width = len(batch.column("x")[0]) if batch.num_rows else 1
        step = max(limit // width, 64)
        for i in range(0, batch.num_rows, step):
            waiting.append(batch.slice(i, step))
            size += waiting[-1].num_rows * width
            if size >= limit:
                yield joined(waiting)
                waiting, size = [], 0
    if waiting:
        yield joined(waiting)


def _assign(x: np.ndarray, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of every row and position."""
    width = x.shape[1] // PARTS
    found = [nearest(b, x[:, p * width : (p + 1) * width])[:2] for p, b in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def first_entries(rows: DataFrame, entries: int = ENTRIES) -> list[np.ndarray]:
    """Each position's parts of the smallest ids; a fixed number of rows comes to the driver."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("vec_id", "x").collect()
    named = [r["x"] for r in least if r["vec_id"] is not None]
    x = np.array(named or [r["x"] for r in least], np.int64)
    return list(np.split(x, PARTS, axis=1)) if len(x) else []


def fit_codebooks(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The entries of each position after so many rounds over all of `rows` (vec_id, x)."""
    books = first_entries(rows, entries)
    for _ in range(rounds if books else 0):
        now = [Book.of(b) for b in books]
        size, width = books[0].shape

        def sums(batches: Iterator[pa.RecordBatch], now: list[Book] = now, size: int = size, width: int = width) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(PARTS * size, np.int64), np.zeros((PARTS * size, width), np.int64)
            for _, x in _blocks(batches):
                index, _ = _assign(x, now)
                for p in range(PARTS):
                    at = p * size + index[:, p]
                    count += np.bincount(at, minlength=PARTS * size)
                    np.add.at(total, at, x[:, p * width : (p + 1) * width])
            used = np.flatnonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(used) * width + 1, width), pa.int32()), pa.array(total[used].ravel()))
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(count[used]), lists], ["place", "n", "total"])

        partial = rows.select("x").mapInArrow(sums, "place int, n long, total array<long>")
        # Sums of at most PARTS * entries rows a task.
        added = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)]
        means = partial.groupBy("place").agg(F.sum("n").alias("n"), *added).toArrow()
        n, place = means.column("n").to_numpy(), means.column("place").to_numpy()
        moved = np.stack([means.column(f"t{j}").to_numpy() for j in range(width)], axis=1) // n[:, None]
        flat = np.concatenate(books)
        flat[place] = moved
        books = list(np.split(flat, PARTS))
    return books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components as decimals, by position, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every row of `whole_numbers`: two hex digits a position, the sum of squared distances."""
    now = [Book.of(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches):
            index, far = _assign(x, now)
            code = pa.array([row.tobytes().hex() for row in index.astype(np.uint8)])
            columns = [batch.column("vec_id"), batch.column("label"), code, pa.array(far.sum(axis=1))]
            yield pa.record_batch(columns, ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id long, label string, code string, error long")


def decode(codes: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The columns of `codes` and `approximation`: the entries that a code names, as floating-point components again."""
    table = [(b / SCALE).tolist() for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [[c for p, i in enumerate(bytes.fromhex(code)) for c in table[p][i]] for code in batch.column("code").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(back, pa.list_(pa.float64()))], [*batch.schema.names, "approximation"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema]
    return codes.mapInArrow(run, ", ".join([*kept, "approximation array<double>"]))


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that can be encoded.

    Errors are summed per label and partition before they are shuffled, and the sums joined back: they are sent to all
    executors up to LABELS labels, so that no label's rows meet in one task, and go through a shuffled join beyond.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    rows, path = scratch.write(whole_numbers(vectors), "rows")
    books = fit_codebooks(rows, rounds, entries)
    done, _ = scratch.write(encode(rows, books), "coded")
    scratch.drop(path)
    per_label = done.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "own_label")
    per_label, _ = scratch.write(per_label, "labels")
    if per_label.count() <= LABELS:
        per_label = F.broadcast(per_label)
    return done.join(per_label, F.col("label").eqNullSafe(F.col("own_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
