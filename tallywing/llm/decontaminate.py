"""Benchmark decontamination. DataFrame and SQL functions only.

A document is contaminated by an item if one of its windows of the item's length reaches the similarity: the weighted
Jaccard similarity of the shingles of both, a shingle weighing as often as it occurs. Every window
that shares a shingle with an item of its length is looked at, wherever the shingle stands in the two: parts may have changed
places. A window that shares no shingle has similarity 0.

1. Items become rows (shingle hash, length). The hashes of all shingles of all whole texts are looked up in them; the windows
   of that length that hold the shingle, whatever their start, are the ones to fingerprint. Items are taken in blocks of bounded size, so that a block can be sent to every executor.
2. A window and an item of the same length have SimHash fingerprints. Cut into RADIUS + 1 blocks, two fingerprints
   that differ in at most RADIUS bits agree in one block at least: pairs are joined on (length, block, bits), and
   those within the radius stay.
3. The similarity of these pairs is counted exactly, from the words themselves.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lowered, shingles have five words; an item with fewer has its whole sequence
as its only shingle. Windows at the border of a text are cut there.
All of them count; but a cut window of which no shared shingle stands at its place in the item is reported only where no other
window of the document reaches the similarity, as it gains by the words that the cut leaves out.

Defined cases: NULL and empty texts and items have no words and match nothing; items of equal words each match; rows
repeated in `docs` give the same rows once; an empty table on either side gives an empty result; further columns
aren't read by `matches` and pass through `clean` as they are; the longest texts are looked up whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import Scratch, rows_by_id

K = 5

#: Per cent of similarity from which on a window counts.
SIMILAR = 75

BITS, RADIUS = 64, 22

#: Shingles of items that are sent to every executor at a time (about 100 MB at most).
ITEM_SHINGLES = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def gram_hashes(w: str, k: int) -> Column:
    """Hash of the k words from each place of the array column `w` on that has as many."""
    parts = ", ".join(f"get({w}, i + {j})" for j in range(k))
    return F.expr(f"if(size({w}) < {k}, array(), transform(sequence(0, size({w}) - {k}), i -> xxhash64({parts})))")


def shingle_texts(w: str) -> Column:
    """All shingles of the word array column `w` as text; the whole sequence where it has fewer than K words."""
    return F.expr(
        f"case when size({w}) = 0 then array() when size({w}) < {K} then array(array_join({w}, ' '))"
        f" else transform(sequence(1, size({w}) - {K - 1}), i -> array_join(slice({w}, i, {K}), ' ')) end"
    )


def simhash(hashes: str) -> Column:
    """64 signs of the summed bit votes of all shingle hashes (repeated ones vote again)."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1L as int))"
    return F.expr(f"aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L))")


def fingerprinted(df: DataFrame) -> DataFrame:
    """Add `sh`, the shingles of column `w`, and `print`, their SimHash."""
    return (
        df.withColumn("sh", shingle_texts("w"))
        .withColumn("sh_h", F.transform("sh", lambda s: F.xxhash64(s)))
        .withColumn("print", simhash("sh_h"))
        .drop("sh_h")
    )


def block_edges() -> list[tuple[int, int]]:
    """(first bit, bits) of RADIUS + 1 blocks that cover the fingerprint."""
    edges = [BITS * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def print_blocks(column: str) -> Column:
    """(number, bits) of each block of a fingerprint."""
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned({column}, {a}) & {(1 << n) - 1}L").alias("bits"))
        for i, (a, n) in enumerate(block_edges())
    ])


def item_rows(items: DataFrame) -> DataFrame:
    """(item_id, w, n, k): items with words; k is the length of their shingles."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w"))
    return rows.where(F.size("w") > 0).withColumn("n", F.size("w")).withColumn("k", F.least(F.lit(K), F.col("n")))


def windows(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(doc_id, item_n, start, w): all windows of `docs` that hold a k-word shingle of an item in `rows` of their length.

    `start` is below 0 where a window would begin before its text.
    """
    grams = rows.select("n", F.explode_outer(gram_hashes("w", k)).alias("gram")).where("gram is not null").distinct()
    texts = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("grams", gram_hashes("w", k))
    found = (
        texts.select("doc_id", "w", F.posexplode_outer("grams").alias("at", "gram"))
        .join(F.broadcast(grams), "gram")  # `rows` is one block: a fixed bound
        .select("doc_id", "w", "n", F.explode(F.expr(f"sequence(at + {k} - n, at)")).alias("start"))
        .withColumn("begin", F.greatest("start", F.lit(0)))
        .select("doc_id", F.col("n").alias("item_n"), "start", F.expr("slice(w, begin + 1, n + start - begin)").alias("w"))
    )
    return found.distinct()


def matches(docs: DataFrame, items: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, item_id, start, shared, total) of the best window per document and item that is similar enough.

    shared and total are the two counts whose ratio is the similarity. Windows that are whole, or hold a shared shingle at
    its place in the item (`aligned`), come before others; ties go to the aligned ones, then to the first window.
    """
    rows = item_rows(items)
    sizes = rows.select(F.max("k").alias("k"), F.count("*").alias("n"), F.sum("n").alias("words")).first()
    found = [
        _matches(docs, rows.where((F.col("k") == k) & (F.pmod(F.xxhash64("item_id", "w"), F.lit(blocks)) == b)), k, similar)
        for k in range(1, (sizes["k"] or 0) + 1)
        for blocks in [1 + (sizes["words"] or 0) // ITEM_SHINGLES]
        for b in range(blocks)
        if k == K or not rows.where(F.col("k") == k).isEmpty()
    ]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, shared long, total long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.max_by(F.struct("start", "shared", "total"), F.struct("proper", F.col("shared") / F.col("total"), "aligned", -F.col("start")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _matches(docs: DataFrame, rows: DataFrame, k: int, similar: int) -> DataFrame:
    """`matches` for one block of items, all with k-word shingles. The item side is of bounded size."""
    # Both sides are written once: else filters derived from the joins would push the fingerprints' expressions down to
    # every place of every text. Windows are few, and no later step reads the texts again.
    scratch = Scratch(docs.sparkSession, "decontaminate")
    own = fingerprinted(rows).select("item_id", F.col("n").alias("item_n"), F.col("sh").alias("item_sh"), F.col("print").alias("item_print"))
    own, _ = scratch.write(own, "items")
    seen, _ = scratch.write(fingerprinted(windows(docs, rows, k)).select("doc_id", "item_n", "start", "sh", "print"), "windows")
    left = seen.select("*", F.explode(print_blocks("print")).alias("b")).select("*", "b.*").drop("b")
    right = own.drop("item_sh").select("*", F.explode(print_blocks("item_print")).alias("b")).select("*", "b.*").drop("b")
    # A pair within the radius meets in every block in which it agrees; it counts in the first of them.
    agree = F.expr("transform({}, e -> shiftrightunsigned(diff, e.a) & e.m = 0)".format(
        "array(" + ", ".join(f"named_struct('a', {a}, 'm', {(1 << n) - 1}L)" for a, n in block_edges()) + ")"
    ))
    near = (
        left.join(F.broadcast(right), ["item_n", "block", "bits"])
        .withColumn("diff", F.col("print").bitwiseXOR(F.col("item_print")))
        .where(F.bit_count("diff") <= RADIUS)
        .where(F.array_position(agree, True) == F.col("block") + 1)
        .join(F.broadcast(own.select("item_id", "item_sh")), "item_id")
        .select("doc_id", "item_id", "start", "sh", "item_sh")
    )
    # Counts of one side for each of its different shingles, against those of the other side.
    count = "size(filter({}, x -> x = s))"
    shared = f"aggregate(array_distinct(sh), 0L, (n, s) -> n + least({count.format('sh')}, {count.format('item_sh')}))"
    aligned = "exists(sequence(0, size(sh) - 1), j -> get(sh, j) = get(item_sh, j - least(start, 0)))"
    return (
        near.withColumn("aligned", F.expr(aligned))
        .withColumn("proper", F.expr("aligned or size(sh) = size(item_sh)"))
        .withColumn("shared", F.expr(shared))
        .withColumn("total", F.expr("cast(size(sh) + size(item_sh) as long) - shared"))
        .where(F.col("shared") * 100 >= F.col("total") * similar)
        .select("doc_id", "item_id", F.greatest("start", F.lit(0)).alias("start"), "shared", "total", "aligned", "proper")
    )


def clean(docs: DataFrame, items: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The rows of `docs` that no item contaminates, with all their columns."""
    bad = matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, similar)
    return rows_by_id(docs, bad.select("doc_id").distinct(), "left_anti")
