"""Nearest stored examples: exact by vectors over pivot cells, exact by words over an inverted index.

Both return (query_id, example_id, similarity, rank), ties in similarity going to the smaller example. Queries are a
DataFrame at every size, and a search that can't change the k best is left out by a bound, never by a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallywing.operators.ranking import first_per_group
from tallywing.session import scratch_path

#: Pivots at most, rings of distances around each, and rows of a block of a cell and of a chunk of queries, about.
PIVOTS, RINGS, BLOCK_ROWS, CHUNK_ROWS = 128, 64, 4096, 2048

#: What distances and bounds may be off by; nothing within it is left out.
SLACK = 1e-9

#: A term is hot if it has more than one in so many of all postings, so there are at most as many hot terms.
HOT = 1000

WORD_BORDER = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """The mean vector of each group; sums are combined per task and component before the shuffle."""
    parts = df.select(group, F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy(group, "i").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy(group).agg(F.transform(ordered, lambda c: c["x"]).alias(vector))


def _unit_rows(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column without NULLs, all of one length; squares of very large numbers stay finite."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    scaled = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True), 1e-300)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _as_lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * rows @ others.T, 0))


@dataclass(frozen=True)
class Cells:
    """Pivots, and the blocks of rows nearest to each: their cell, range of distances from the pivot, and number of parts.

    `counts[c, b]` rows of cell c have a distance in ring b. A block is a run of rings; one with more rows than a block should
    have is cut into parts by a hash of the example.
    """

    pivots: np.ndarray
    counts: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    block_of: np.ndarray

    @classmethod
    def of(cls, pivots: np.ndarray, counts: np.ndarray, size: int) -> Cells:
        cell, low, high, parts = [], [], [], []
        block_of = np.full(counts.shape, -1)
        for c in range(len(counts)):
            held = 0
            for b in np.flatnonzero(counts[c]):
                if held and held + counts[c, b] <= size:
                    held += counts[c, b]
                    high[-1] = int(b)
                else:
                    held = counts[c, b]
                    cell.append(c)
                    low.append(int(b))
                    high.append(int(b))
                    parts.append(-(-int(held) // size))
                block_of[c, b] = len(cell) - 1
        to = np.array(high, float) + 1
        return cls(pivots, counts, np.array(cell, int), np.array(low, float) * 2 / RINGS, to * 2 / RINGS, np.array(parts, int), block_of)

    def reach(self, apart: np.ndarray, k: int) -> np.ndarray:
        """For each query a distance within which at least k rows lie, from its distances to the pivots."""
        c, b = np.nonzero(self.counts)
        n = self.counts[c, b]
        out = np.empty(len(apart))
        for i, row in enumerate(apart):
            bound = row[c] + (b + 1) * 2 / RINGS
            order = np.argsort(bound)
            at = int(np.searchsorted(np.cumsum(n[order]), k))
            out[i] = bound[order[at]] if at < len(order) else np.inf
        return out

    def wanted(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, block) that the triangle inequality can't rule out."""
        apart = _distances(rows, self.pivots)
        reach = self.reach(apart, k) + SLACK
        to = apart[:, self.cell]
        near = (to - self.high[None, :] <= reach[:, None]) & (self.low[None, :] - to <= reach[:, None])
        # A row of another cell is nearer to that pivot than to the query's own one, so it lies beyond the plane between.
        own = apart.argmin(axis=1)
        between = _distances(self.pivots, self.pivots)
        gap = (to**2 - (apart.min(axis=1) ** 2)[:, None]) / np.maximum(2 * between[own][:, self.cell], 1e-12)
        return np.nonzero(near & ((gap <= reach[:, None]) | (self.cell[None, :] == own[:, None])))


def _usable(df: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Id and vector of the rows whose vector is present, finite and not empty."""
    rows = df.toDF(*names).select(names[0], F.col(names[1]).cast("array<double>").alias(names[1]))
    return rows.where(f"size({names[1]}) > 0 and forall({names[1]}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")


def _is_zero(vector: str) -> Column:
    return F.forall(vector, lambda x: x == 0)


def nearest_examples(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK_ROWS, chunk: int = CHUNK_ROWS) -> DataFrame:
    """The k most similar corpus rows of each query: (query_id, example_id, similarity, rank), by the cosine, exactly.

    Both frames hold an id and a vector. Corpus rows go to the cell of their nearest pivot (at most PIVOTS of them, spread by a
    hash of the id), and a cell is cut into blocks by distance from the pivot. A query's k best lie within a distance known from the
    counts of rows per cell and ring; blocks that the triangle inequality puts beyond it aren't searched. A block meets
    its queries in chunks, so no task holds more than a block and a chunk, however many rows or queries are alike.

    Defined cases: vectors that are NULL, empty or not finite are left out on both sides, and so are those of other lengths than
    the pivots'; a zero vector has similarity 0 to everything; queries with equal ids and different vectors are
    answered each, rows that agree in both once; fewer than k examples give fewer rows; similarities that agree in
    12 digits are equal.
    """
    spark = corpus.sparkSession
    kinds = [queries.schema[0].dataType.simpleString(), corpus.schema[0].dataType.simpleString()]
    wanted_pivots = min(PIVOTS, corpus.count() * 4 // block + 1)
    corpus, queries = _usable(corpus, ("example_id", "vector")), _usable(queries, ("query_id", "vector"))
    whole = corpus.where(~_is_zero("vector"))
    spread = whole.withColumn("order", F.xxhash64("example_id")).orderBy("order", "example_id").limit(wanted_pivots)
    found = spread.select("vector").toArrow().column("vector").combine_chunks()
    size = len(found[0]) if len(found) else 0
    found = pa.array([v for v in found.to_pylist() if len(v) == size], pa.list_(pa.float64()))
    pivots = np.unique(_unit_rows(found), axis=0) if size else np.zeros((0, 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit_rows(batch.column("vector"))
                apart = _distances(unit, pivots)
                cell = apart.argmin(axis=1)
                ring = np.minimum((apart.min(axis=1) * RINGS / 2).astype(np.int32), RINGS - 1)
                yield pa.record_batch([batch.column("example_id"), _as_lists(unit), pa.array(cell, pa.int32()), pa.array(ring)], ["example_id", "unit", "cell", "ring"])

    placed = whole.where(F.size("vector") == size).mapInArrow(place, f"example_id {kinds[1]}, unit array<double>, cell int, ring int")
    path = scratch_path(spark, "nearest-placed")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    # At most PIVOTS * RINGS rows.
    counted = placed.groupBy("cell", "ring").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros((len(pivots), RINGS), np.int64)
    counts[counted.column("cell").to_numpy(), counted.column("ring").to_numpy()] = counted.column("n").to_numpy()
    cells = Cells.of(pivots, counts, block)

    # Zero vectors: similarity 0 to everything, so only the least k ids of either kind matter.
    least_zero = corpus.where(_is_zero("vector")).select("example_id").orderBy("example_id").limit(k)
    least_any = corpus.select("example_id").orderBy("example_id").limit(k)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit = _unit_rows(part.column("vector"))
                query, where = cells.wanted(unit, k)
                if not len(query):
                    continue
                # A block cut into parts is searched in each of them.
                times = cells.parts[where]
                query, where = np.repeat(query, times), np.repeat(where, times)
                piece = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(query)
                columns = [part.column("query_id").take(take), part.column("query_key").take(take), _as_lists(unit[query]), pa.array(where, pa.int32()), pa.array(piece, pa.int32())]
                yield pa.record_batch(columns, ["query_id", "query_key", "unit", "block", "piece"])

    asked = queries.distinct().withColumn("query_key", F.md5(F.col("vector").cast("string")))
    zero = asked.where(_is_zero("vector"))
    asked = asked.where(~_is_zero("vector") & (F.size("vector") == (size or F.size("vector"))))
    planned = f"query_id {kinds[0]}, query_key string, unit array<double>, block int, piece int"
    wanted = (asked if size else asked.limit(0)).mapInArrow(plan, planned)
    # Chunks of queries per block and piece, and as many copies of the block's rows.
    chunks = wanted.groupBy("block", "piece").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
    wanted = wanted.join(chunks, ["block", "piece"]).withColumn("chunk", F.pmod(F.xxhash64("query_id", "query_key"), "chunks").cast("int"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = cells.block_of[batch.column("cell").to_numpy(), batch.column("ring").to_numpy()]
            piece = batch.column("spread").to_numpy() % cells.parts[where]
            columns = [batch.column("example_id"), batch.column("unit"), pa.array(where, pa.int32()), pa.array(piece, pa.int32())]
            yield pa.record_batch(columns, ["example_id", "unit", "block", "piece"])

    dealt = placed.withColumn("spread", F.pmod(F.xxhash64("example_id", F.lit("piece")), F.lit(1 << 30)))
    rows = dealt.mapInArrow(cut, f"example_id {kinds[1]}, unit array<double>, block int, piece int")
    rows = rows.join(chunks, ["block", "piece"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    ids_as = [to_arrow_type(df.schema[0].dataType) for df in (queries, corpus)]
    empty = pa.schema([("query_id", ids_as[0]), ("query_key", pa.string()), ("example_id", ids_as[1]), ("similarity", pa.float64())]).empty_table()

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        """The best k of a block's rows for each query of a chunk; a hash may leave either side empty."""
        if not len(mine) or not len(theirs):
            return empty
        ids = mine.column("example_id").combine_chunks()
        order = pc.sort_indices(ids)
        ids = ids.take(order)
        unit = _matrix(mine.column("unit"))[order.to_numpy()]
        similar = np.round(_matrix(theirs.column("unit")) @ unit.T, 12)
        best = np.argsort(-similar, axis=1, kind="stable")[:, :k]
        query = np.repeat(np.arange(len(theirs)), best.shape[1])
        take = pa.array(query)
        return pa.table({
            "query_id": theirs.column("query_id").combine_chunks().take(take), "query_key": theirs.column("query_key").combine_chunks().take(take),
            "example_id": ids.take(pa.array(best.ravel())), "similarity": similar[query, best.ravel()],
        })

    by = ["block", "piece", "chunk"]
    met = rows.select(*by, "example_id", "unit").groupBy(*by).cogroup(wanted.select(*by, "query_id", "query_key", "unit").groupBy(*by))
    near = met.applyInArrow(search, f"query_id {kinds[0]}, query_key string, example_id {kinds[1]}, similarity double")
    nothing = F.lit(0.0).alias("similarity")
    # The few zero examples meet the queries; zero queries meet the least ids. Both sides of k rows.
    beside = asked.crossJoin(F.broadcast(least_zero)).select("query_id", "query_key", "example_id", nothing)
    of_zero = zero.crossJoin(F.broadcast(least_any))
    every = near.unionByName(beside).unionByName(of_zero.select("query_id", "query_key", "example_id", nothing))
    return first_per_group(every, ["query_id", "query_key"], k, F.desc("similarity"), "example_id").drop("query_key")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


# --- words


def terms_of(df: DataFrame) -> DataFrame:
    """(id, term, n): how often each word stands in each text; words are what white space parts, A-Z lowered.

    `df` holds an id and a text. Texts of equal ids count as one; a text without words has no rows.
    """
    words = F.split(F.translate("text", UPPER, LOWER), WORD_BORDER)
    spread = df.toDF("id", "text").select("id", F.explode(words).alias("term")).where("term != ''")
    return spread.groupBy("id", "term").agg(F.count("*").alias("n"))


def _weight(n: str, df: str, total: Column) -> Column:
    """Whole-number TF-IDF: thousandths of (1 + ln n) * ln((total + 1) / (df + 1)). Sums are exact in any order."""
    return F.round((F.ln(F.col(n).cast("double")) + 1) * F.ln((total + 1.0) / (F.col(df) + 1.0)) * 1000).cast("long")


@dataclass(frozen=True)
class WordIndex:
    """An inverted index. `postings` (term, example_id, w, norm): weights and the text's length; `terms` (term, df, top): in how many
    texts, and the largest share w / norm that a text has of it; `hot` (term, parts): at most HOT terms with many postings.
    """

    postings: DataFrame
    terms: DataFrame
    hot: DataFrame
    total: int


def word_index(corpus: DataFrame) -> WordIndex:
    """Index an (id, text) frame; the tables are written to the shared folder once."""
    spark = corpus.sparkSession

    def write(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"words-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    counts = write(terms_of(corpus), "counts")
    total = corpus.toDF("id", "text").select("id").distinct().count()
    df = write(counts.groupBy("term").agg(F.count("*").alias("df")), "df")
    many = (df.agg(F.sum("df").alias("n")).first()["n"] or 0) // HOT
    hot = df.where(F.col("df") > F.lit(many)).select("term", F.ceil(F.col("df") / F.lit(max(many, 1))).cast("int").alias("parts"))
    # The texts of a hot term stay where they are: its row comes to them. The others go through a shuffle by term.
    hot_df = F.broadcast(hot.join(df, "term").select("term", F.col("df").alias("hot_df")))
    seen = counts.join(hot_df, "term", "left")
    cold = seen.where("hot_df is null").drop("hot_df").join(df, "term")
    known = cold.unionByName(seen.where("hot_df is not null").withColumnRenamed("hot_df", "df"))
    weighed = known.select("id", "term", _weight("n", "df", F.lit(total)).alias("w")).where("w > 0")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")).cast("double"))
    postings = write(weighed.select("term", F.col("id").alias("example_id"), "w", length.alias("norm")), "postings")
    top = postings.groupBy("term").agg(F.max(F.col("w") / F.col("norm")).alias("top"))
    return WordIndex(postings, write(df.join(top, "term", "left").na.fill({"top": 0.0}), "terms"), hot, total)


def similar_texts(queries: DataFrame, index: WordIndex, k: int) -> DataFrame:
    """The k indexed texts most similar to each (id, text) by the cosine of their TF-IDF weights, exactly.

    1. Each term's k texts with the largest share of it give every query k texts with a least similarity; the k-th of these
       is the query's floor.
    2. A query's terms are ordered by what they can add at most. Those that together stay below the floor find no text on
       their own; only the others are joined with the postings, and only postings that can reach the floor count. Postings of
       hot terms are dealt to parts, with a copy of the query's term for each.
    3. Texts whose partial sum can still reach the floor are added up over all terms.

    Defined cases: texts that share no weighted term with a query aren't returned, so a query may have fewer than k rows, and one without words
    has none; a word in all texts has no weight; a word in no text only lengthens its query; NULL texts have no words;
    queries of equal ids count as one text.
    """
    asked = terms_of(queries).join(index.terms, "term", "left").na.fill({"df": 0, "top": 0.0})
    asked = asked.select(F.col("id").alias("query_id"), "term", _weight("n", "df", F.lit(index.total)).alias("qw"), "df", "top").where("qw > 0")
    length = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(W.partitionBy("query_id")).cast("double"))
    asked = asked.withColumn("qnorm", length).where("df > 0 and top > 0")
    asked = asked.withColumn("most", F.col("qw") / F.col("qnorm") * F.col("top") * F.lit(1 + SLACK))
    path = scratch_path(queries.sparkSession, "words-asked")
    asked.write.parquet(path)
    asked = queries.sparkSession.read.schema(asked.schema).parquet(path)

    share = F.col("w") / F.col("norm")
    asked_for = index.postings.join(asked.select("term").distinct(), "term", "left_semi")
    best = first_per_group(asked_for, ["term"], k, share.desc(), "example_id").drop("rank")
    floor = asked.join(best, "term").groupBy("query_id", "example_id").agg(F.sum(F.col("qw") / F.col("qnorm") * share).alias("s"))
    floor = first_per_group(floor, ["query_id"], k, F.desc("s"), "example_id").where(F.col("rank") == k)
    floor = floor.select("query_id", (F.col("s") * F.lit(1 - SLACK)).alias("floor"))

    upward = W.partitionBy("query_id").orderBy("most", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = asked.join(floor, "query_id", "left").na.fill({"floor": 0.0})
    ranked = ranked.withColumn("up_to", F.sum("most").over(upward)).withColumn("all_most", F.sum("most").over(W.partitionBy("query_id")))
    finds = ranked.where("up_to >= floor")
    rest = ranked.groupBy("query_id").agg(F.sum(F.when(F.col("up_to") < F.col("floor"), F.col("most")).otherwise(0.0)).alias("rest"))

    parts = F.coalesce("parts", F.lit(1))
    hot = F.broadcast(index.hot)
    copies = finds.join(hot, "term", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    dealt = index.postings.join(hot, "term", "left").withColumn("part", F.pmod(F.xxhash64("example_id"), parts).cast("int")).drop("parts")
    one = F.col("qw") / F.col("qnorm") * share
    reaches = one + F.col("all_most") - F.col("most") >= F.col("floor")
    partial = copies.join(dealt, ["term", "part"]).where(reaches).groupBy("query_id", "example_id").agg(F.sum(one).alias("s"), F.max("floor").alias("floor"))
    left = partial.join(rest, "query_id").where(F.col("s") + F.col("rest") + F.lit(SLACK) >= F.col("floor")).select("query_id", "example_id")

    full = left.join(asked.select("query_id", "term", "qw", "qnorm"), "query_id").join(index.postings, ["example_id", "term"])
    dot = F.sum(F.col("qw") * F.col("w")).cast("double")
    scored = full.groupBy("query_id", "example_id").agg((dot / (F.max("qnorm") * F.max("norm"))).alias("similarity"))
    return first_per_group(scored, ["query_id"], k, F.desc("similarity"), "example_id")
