"""N-gram Jaccard join of whole texts by signature trees, with the components of its links.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of 0.75 or more. Sets are
joined in blocks of bounded size, each by a signature tree (`signature_tree`): nodes with OR-combined bitmaps and
size ranges, walked in pairs, node pairs being left out by their largest possible overlap.

1. `summaries`: size and digest of every set, and counts of common words and shingles, in one pass over the texts. Equal sets
   form a class; one of it stands for all from here on.
2. First blocks: documents that share one of their HEADS smallest shingles. Most similar documents meet here, and a
   tree finds links that connect them, whole sets being compared. Blocks of frequent shingles are split.
3. Second blocks, which make the join exact: two similar sets share a shingle among the first (n - 0.75 n + 1) of each,
   in any fixed order. Ours (`Order`) begins with shingles of rare words; those of common words, which unrelated documents share by
   chance, come late, and those frequent in the corpus last. Shingles that meet documents of different components bring these into a block. Here a tree over bitmaps of fixed size leaves out pairs that can't be similar, and the
   whole sets of what is left are compared.
4. Components of all links.

What reaches the driver has a fixed bound: the frequent shingles (each seen in a FREQUENT share of the documents or more), the common
words (a COMMON share of all words or more), and tables that thin out rows before a shuffle, which follow the number of their keys
up to MOST_SLOTS bytes or MOST_BITS bits.

Defined cases: NULL and empty texts have no shingles and link with nothing; fewer than five words are one shingle;
rows with equal ids are one node, each with its own size (`one_of_each` keeps one of those with equal texts); a NULL id has no links and a NULL component; an empty table
gives an empty result; ties can't occur, as the least id names a component; further columns aren't read by
`link_documents` and pass through `one_of_each` as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.llm import sketches
from tallywing.llm.common import Scratch, rows_by_id
from tallywing.llm.components import components
from tallywing.llm.signature_tree import FANOUT, Tree, bitmaps, join_sets, least_overlap, traverse
from tallywing.llm.spans import STEP_BYTES, Texts, distinct_per_text, mix, shingles, steps

K = 5
SIMILAR = 75

#: Smallest shingles by which documents meet first.
HEADS = 4

#: Documents in a block, about.
BLOCK = 256

#: A shingle is frequent if steps that have it twice have it in this share of all documents.
FREQUENT = 1 / 16_000

#: A word is common if this share of all words are it.
COMMON = 1 / 50_000

#: Bytes of text, about, within which `summaries` counts words and shingles.
COUNT_BYTES = 8 << 20

#: Bits of the bitmaps that rows carry.
SKETCH_BITS = 1024

#: Blocks up to this size are one leaf, whose pairs are compared at once with those of other such blocks.
LEAF = 128

#: Pairs whose bitmaps are compared at a time.
PAIRS = 1 << 16

Batches = Iterator[pa.RecordBatch]


def sets_of(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, ascending, and the first of each text."""
    h, first = shingles(*Texts(column).word_hashes(), k)
    values, _, first = distinct_per_text(h, first)
    return values, first


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))


def _per_text(batches: Batches, make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], k: int) -> Batches:
    for batch in batches:
        for part in steps(batch, "text"):
            yield make(part, *sets_of(part.column("text"), k))


def _counted(values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Different values that occur `least` times or more, and how often."""
    values = np.sort(values)
    where = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    counts = np.diff(np.append(where, len(values)))
    much = counts >= least
    return values[where[much]].view(np.int64), counts[much]


def summaries(texts: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n, d1, d2, head, grams, gram_counts, words, word_counts): size, digest and smallest shingles of each set. Some
    rows also have the shingles that are in several of the last COUNT_BYTES' sets and the common words there, with their counts.
    """

    def make(part: pa.RecordBatch, seen: list[tuple[np.ndarray, np.ndarray]], last: bool) -> pa.RecordBatch:
        words, at = Texts(part.column("text")).word_hashes()
        values, _, first = distinct_per_text(*shingles(words, at, k))
        seen.append((values, words))
        n = np.diff(first)
        some = n > 0
        digests = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            d = np.zeros(len(n), np.uint64)
            if some.any():
                d[some] = np.add.reduceat(mix(values ^ np.uint64(salt)), first[:-1][some])
            digests.append(pa.array(d.view(np.int64)))
        head = np.minimum(n, HEADS)
        at = np.concatenate([[0], np.cumsum(head)])
        index = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], head)
        counted: list = [None] * 4
        if last:
            grams, words = (np.concatenate(x) for x in zip(*seen, strict=True))
            counted = [*_counted(grams, 2), *_counted(words, max(4, len(words) * COMMON))]
            seen.clear()
        return pa.record_batch(
            [
                part.column("doc_id"), pa.array(n, pa.int64()), *digests, _lists(values[index], at),
                *(pa.array([x, *[None] * (len(n) - 1)], pa.list_(pa.int64())) for x in counted),
            ],
            ["doc_id", "n", "d1", "d2", "head", "grams", "gram_counts", "words", "word_counts"],
        )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            parts = [*steps(batch, "text")]
            for i, part in enumerate(parts, 1):
                yield make(part, seen, i == len(parts) or i % (COUNT_BYTES // STEP_BYTES) == 0)

    lists = ", ".join(f"{c} array<long>" for c in ("head", "grams", "gram_counts", "words", "word_counts"))
    return texts.mapInArrow(run, f"doc_id long, n long, d1 long, d2 long, {lists}")


def _common(counts: DataFrame, keys: str, uses: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys whose counts come to `least` or more, and these."""
    each = counts.where(f"{keys} is not null").select(F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(uses).alias("n"))).alias("x"))
    rows = each.groupBy("x.key").agg(F.sum("x.n").alias("n")).where(F.col("n") >= least).toArrow()
    return rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()


@dataclass
class Order:
    """The order of shingles: a number whose upper byte is higher for commoner words and highest for frequent shingles, above the
    upper 56 bits of the hash.
    """

    words: sketches.Levels
    often: sketches.Levels

    def keys(self, column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of each text in this order, and the first of each."""
        words, at = Texts(column).word_hashes()
        h, first = shingles(words, at, k)
        weight = np.zeros(len(words) + 1, np.int64)
        weight[1:] = self.words.at(words)
        total = np.cumsum(weight)
        n = np.diff(first)
        start = np.arange(len(h)) - np.repeat(first[:-1] - at[:-1], n)
        level = total[np.minimum(start + k, len(words))] - total[start]
        level[np.repeat(np.diff(at) < k, n)] = 0
        level = np.minimum(level, 254)
        level[self.often.at(h) > 0] = 255
        values, _, first = distinct_per_text((level.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8)), first)
        return values, first


def order_of(own: DataFrame, k: int = K) -> Order:
    """The order that the counts of `summaries` give. It decides how much work is left for later steps, not what is found."""
    total = own.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    words, uses = _common(own, "words", "word_counts", max(4, (total["n"] or 0) * COMMON))
    # A doubling is two steps; k words come to 254 at most.
    weights = np.minimum(1 + np.round(2 * np.log2(uses / uses.min())), 254 // k) if len(uses) else uses
    often, _ = _common(own, "grams", "gram_counts", max(8, int(total["rows"] * FREQUENT)))
    return Order(sketches.table_of(words, weights), sketches.table_of(often, np.ones(len(often))))


def first_blocks(texts: DataFrame, levels: sketches.Levels, reps: sketches.Members, k: int = K) -> DataFrame:
    """(key, salt, doc_id, text): each document that may stand for a class once for every head that may be in different sets."""

    def make(part: pa.RecordBatch, values: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        n = np.minimum(np.diff(first), HEADS)
        row = np.repeat(np.arange(len(n)), n)
        keys = values[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[:-1][row]]
        ids = part.column("doc_id").fill_null(0).to_numpy().view(np.uint64)[row]
        level = levels.at(keys).astype(np.int64)
        # 2 ** (level - 1) documents at most have the shingle.
        salts = np.left_shift(1, np.maximum(level - 1 - int(np.log2(BLOCK)), 0))
        salt = (mix(keys ^ mix(ids)) >> np.uint64(1)).astype(np.int64) % salts
        keep = (level >= 2) & ~part.column("doc_id").is_null().to_numpy(zero_copy_only=False)[row]
        take = pa.array(row[keep])
        return pa.record_batch(
            [pa.array(keys[keep].view(np.int64)), pa.array(salt[keep]), part.column("doc_id").take(take), part.column("text").take(take)],
            ["key", "salt", "doc_id", "text"],
        )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            yield from _per_text(iter([batch.filter(pa.array(reps.has(ids)))]), make, k)

    return texts.where("doc_id is not null").mapInArrow(run, "key long, salt long, doc_id long, text string")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def link_blocks(blocks: DataFrame, similar: int, k: int = K) -> DataFrame:
    """(a, b): links that connect what is similar within each block of `first_blocks`."""

    def links(block: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
        own = {s.tobytes(): (doc, s) for doc, s in block}  # equal sets are linked by their digest
        if len(own) < 2:
            return []
        ids, sets = zip(*own.values(), strict=True)
        return [(ids[i], ids[j]) for i, j in join_sets(list(sets), similar)]

    def run(batches: Batches) -> Batches:
        now, block = None, []
        for batch in batches:
            for part in steps(batch, "text"):
                values, first = sets_of(part.column("text"), k)
                found: list[tuple[int, int]] = []
                keys = zip(part.column("key").to_pylist(), part.column("salt").to_pylist(), strict=True)
                for key, doc, i, j in zip(keys, part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if key != now:
                        found += links(block)
                        now, block = key, []
                    block.append((doc, values[i:j].copy()))
                yield _pairs(found)
        yield _pairs(links(block))

    return blocks.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(run, "a long, b long")


def prefixes(texts: DataFrame, order: Order, reps: sketches.Members, similar: int, k: int = K) -> DataFrame:
    """(doc_id, n, prefix, sketch) of documents that may stand for a class: the first shingles of each set and a bitmap of the set."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        values, first = order.keys(part.column("text"), k)
        n = np.diff(first)
        size = np.where(n > 0, n - -(-similar * n // 100) + 1, 0)
        keep = np.arange(len(values)) - np.repeat(first[:-1], n) < np.repeat(size, n)
        sketch = bitmaps([values[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], SKETCH_BITS)
        return pa.record_batch(
            [
                part.column("doc_id"), pa.array(n, pa.int64()), _lists(values[keep], np.concatenate([[0], np.cumsum(size)])),
                pa.array([row.tobytes() for row in sketch], pa.binary()),
            ],
            ["doc_id", "n", "prefix", "sketch"],
        )

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            for part in steps(batch.filter(pa.array(reps.has(ids))), "text"):
                yield make(part)

    return texts.where("doc_id is not null").mapInArrow(run, "doc_id long, n long, prefix array<long>, sketch binary")


def postings(sets: DataFrame, meet: sketches.Members) -> DataFrame:
    """(key, doc_id, comp, n, sketch): a row per prefix shingle that may meet several components."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("prefix")
                keys = lists.flatten().to_numpy()
                row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                keep = meet.has(keys)
                take = pa.array(row[keep])
                cols = [part.column(c).take(take) for c in ("doc_id", "comp", "n", "sketch")]
                yield pa.record_batch([pa.array(keys[keep]), *cols], ["key", "doc_id", "comp", "n", "sketch"])

    return sets.mapInArrow(run, "key long, doc_id long, comp long, n long, sketch binary")


def split_groups(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Add `salt` and `major`. A group of more than BLOCK rows is split: its largest component's rows are dealt out, and
    those of the others are in every part, so that each meets all rows of other components.
    """
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("c"))
    big = per.groupBy("key").agg(F.sum("c").alias("size"), F.max_by("comp", F.struct("c", "comp")).alias("major")).where(F.col("size") > BLOCK)
    big, _ = scratch.write(big.select("key", "major", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "big")
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("comp") == F.col("major"), F.array(own)).otherwise(every)
    return rows.join(big, "key", "left").withColumn("salt", F.explode(parts)).drop("parts")


class _Rows:
    """Columns of posting rows that are in order of their block."""

    FIELDS = ("key", "salt", "doc_id", "comp", "n", "major")

    def __init__(self, batch: pa.RecordBatch):
        for c in self.FIELDS:
            setattr(self, c, batch.column(c).fill_null(0).to_numpy().astype(np.int64))
        raw, size = batch.column("sketch").cast(pa.binary(SKETCH_BITS // 8)), SKETCH_BITS // 8
        self.maps = np.frombuffer(raw.buffers()[1], np.uint64, len(raw) * size // 8, raw.offset * size).reshape(-1, SKETCH_BITS // 64)

    def take(self, rows: np.ndarray | slice) -> _Rows:
        out = object.__new__(_Rows)
        for c in (*self.FIELDS, "maps"):
            setattr(out, c, getattr(self, c)[rows])
        return out

    def behind(self, other: _Rows | None) -> _Rows:
        if other is None:
            return self
        out = object.__new__(_Rows)
        for c in (*self.FIELDS, "maps"):
            setattr(out, c, np.concatenate([getattr(other, c), getattr(self, c)]))
        return out

    def counts(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a pair of different components is this part's to report: one of minor components only in the first part."""
        whole = (self.salt[i] == 0) | (self.comp[i] == self.major[i]) | (self.comp[j] == self.major[i])
        return (self.comp[i] != self.comp[j]) & whole & (self.doc_id[i] != self.doc_id[j])


def _leaf_pairs(r: _Rows, starts: np.ndarray, sizes: np.ndarray, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within many blocks of at most LEAF rows that may be similar."""
    i = np.repeat(np.arange(len(starts)), sizes)
    within = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = starts[i] + within
    after = sizes[i] - within - 1
    a = np.repeat(row, after)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
    ok = r.counts(a, b)
    a, b = a[ok], b[ok]
    need, most = least_overlap(r.n[a] + r.n[b], similar), np.minimum(r.n[a], r.n[b])
    ok = most >= need
    a, b, need = a[ok], b[ok], need[ok]
    hidden = r.n - np.bitwise_count(r.maps).sum(axis=1, dtype=np.int64)
    shared = np.minimum(hidden[a], hidden[b])
    for i in range(0, len(a), PAIRS):
        shared[i : i + PAIRS] += np.bitwise_count(r.maps[a[i : i + PAIRS]] & r.maps[b[i : i + PAIRS]]).sum(axis=1, dtype=np.int64)
    return a[shared >= need], b[shared >= need]


def _tree_pairs(r: _Rows, start: int, size: int, similar: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a larger block, by a walk over pairs of tree nodes."""
    own = slice(start, start + size)
    rows = start + np.lexsort((r.n[own], r.comp[own] == r.major[own]))
    comp = r.comp[rows]
    if (comp == comp[0]).all():
        return rows[:0], rows[:0]
    tree = Tree(r.maps[rows], r.n[rows])
    # Parts but the first report no pair of minor components; nodes with rows of the largest one are marked.
    ranges = [(comp, comp, (comp == r.major[rows]) | (r.salt[start] == 0))]
    while len(ranges) < len(tree.maps):
        lo, hi, marked = ranges[-1]
        cuts = np.arange(0, len(lo), FANOUT)
        ranges.append((np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), np.logical_or.reduceat(marked, cuts)))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def same(level: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        lo, hi, marked = ranges[level]
        one = (lo[p] == hi[p])[:, None] & (lo[p][:, None] == lo[q][None, :]) & (lo[q] == hi[q])[None, :]
        return one | ~(marked[p][:, None] | marked[q][None, :])

    traverse(tree, similar, same, lambda i, j: found.append((rows[i], rows[j])))
    a = np.concatenate([rows[:0], *(x for x, _ in found)])
    b = np.concatenate([rows[:0], *(y for _, y in found)])
    ok = r.counts(a, b)
    return a[ok], b[ok]


def candidate_pairs(rows: DataFrame, similar: int) -> DataFrame:
    """(a, b), each once: documents of different components that neither a bitmap tree nor their prefixes tell apart.

    A pair is found at every shingle that is in both prefixes. The sets share at most these and what is behind the
    prefix that ends first, which settles most pairs without their texts.
    """

    def pairs(r: _Rows) -> pa.RecordBatch:
        starts = np.flatnonzero((np.diff(r.key, prepend=r.key[:1] - 1) != 0) | (np.diff(r.salt, prepend=r.salt[:1] - 1) != 0))
        sizes = np.diff(np.append(starts, len(r.key)))
        small = (sizes > 1) & (sizes <= LEAF)
        found = [_leaf_pairs(r, starts[small], sizes[small], similar)]
        found += [_tree_pairs(r, s, n, similar) for s, n in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True)]
        i, j = (np.concatenate([f[x] for f in found]) for x in (0, 1))
        swap = r.doc_id[i] > r.doc_id[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        return pa.record_batch([pa.array(x) for x in (r.doc_id[i], r.doc_id[j], r.n[i], r.n[j])], ["a", "b", "na", "nb"])

    def run(batches: Batches) -> Batches:
        open_: _Rows | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            r = _Rows(batch).behind(open_)
            last = int(np.flatnonzero((r.key != r.key[-1]) | (r.salt != r.salt[-1]))[-1]) + 1 if (r.key != r.key[-1]).any() or (
                r.salt != r.salt[-1]
            ).any() else 0
            open_ = r.take(slice(last, None))
            if last:
                yield pairs(r.take(slice(0, last)))
        if open_ is not None:
            yield pairs(open_)

    found = rows.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(run, "a long, b long, na long, nb long")
    behind = "greatest(ceil(na * {0} / 100), ceil(nb * {0} / 100)) - 1".format(similar)
    need = f"ceil({similar} * (na + nb) / {100 + similar})"
    common = found.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return common.where(F.expr(f"c + {behind} >= {need}")).select("a", "b").distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, similar: int, k: int = K) -> DataFrame:
    """The pairs whose whole sets are similar. Only sets of documents in a pair are sent."""
    wanted = sketches.members(pairs.select(F.col("a").alias("key")).union(pairs.select("b")))

    def make(part: pa.RecordBatch, values: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([part.column("doc_id"), _lists(values, first)], ["doc_id", "s"])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            yield from _per_text(iter([batch.filter(pa.array(wanted.has(ids)))]), make, k)

    sets = texts.where("doc_id is not null").mapInArrow(run, "doc_id long, s array<long>")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("o", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("o") * 100 >= (F.size("sa") + F.size("sb") - F.col("o")) * similar).select("a", "b").distinct()


def link_documents(docs: DataFrame, similar: int = SIMILAR, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own, _ = scratch.write(summaries(texts, k), "summaries")
    some = own.where("n > 0 and doc_id is not null")
    ends = F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.any_value("head").alias("head")
    classes, _ = scratch.write(some.groupBy("d1", "d2", "n").agg(*ends), "classes")
    reps = sketches.members(classes.select(F.col("rep").alias("key")))
    copies = some.join(classes.where("rep != other"), ["d1", "d2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    heads = classes.select(F.explode("head").alias("key"), "d1").groupBy("key").agg(
        F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.count("*").alias("n")
    )
    heads, heads_path = scratch.write(heads.where("lo != hi").select("key", "n"), "heads")
    levels = sketches.levels(heads)
    links, links_path = scratch.write(link_blocks(first_blocks(texts, levels, reps, k), similar, k), "links")
    copies, copies_path = scratch.write(copies.where("a != b"), "copies")
    groups, _ = scratch.write(components(links.union(copies), scratch), "groups")

    # From here on one document stands for its class.
    comps = classes.select("rep").join(groups, F.col("rep") == F.col("id"), "left").select("rep", F.coalesce("component", "rep").alias("comp"))
    sets = prefixes(texts, order_of(own, k), reps, similar, k).join(comps, F.col("doc_id") == F.col("rep")).drop("rep")
    sets, sets_path = scratch.write(sets, "prefixes")
    meet = (
        sets.select("comp", F.explode("prefix").alias("key"))
        .groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .where("lo < hi")
        .select("key")
    )
    meet, meet_path = scratch.write(meet, "meet")
    rows = postings(sets, sketches.members(meet)).join(meet, "key", "left_semi")
    rows, rows_path = scratch.write(rows, "postings")
    pairs, pairs_path = scratch.write(candidate_pairs(split_groups(rows, scratch), similar), "pairs")
    scratch.drop(sets_path, meet_path, rows_path)
    more, _ = scratch.write(similar_pairs(pairs, texts, similar, k), "more")
    if not more.isEmpty():
        groups = components(groups.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), scratch)
    scratch.drop(heads_path, links_path, copies_path, pairs_path)
    return own.join(groups, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, similar: int = SIMILAR, k: int = K) -> DataFrame:
    """The rows of `docs` whose id names their component: one document of each group, with all its columns. Of rows that agree in
    id and text one stays; rows of one id and different texts stay both, and so do all with a NULL id.
    """
    groups = link_documents(docs, similar, k)
    rows = rows_by_id(docs, groups.where("doc_id != component_id").select("doc_id").distinct(), "left_anti")
    twice = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    twice, path = Scratch(docs.sparkSession, "jaccard").write(twice, "twice")
    if twice.isEmpty():
        Scratch(docs.sparkSession, "jaccard").drop(path)
        return rows
    # Only texts whose id stands several times are grouped. Which of two rows stays doesn't depend on the order of rows.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = rows_by_id(rows, twice, "left_semi").select(row.alias("row"))
    several = several.groupBy("row.doc_id", "row.text").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return rows_by_id(rows, twice, "left_anti").union(several)
