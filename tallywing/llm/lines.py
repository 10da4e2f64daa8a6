"""Line dedup: repeated multi-line chunks, cut where the content says so, and what they leave over at their borders. DataFrame and
SQL functions only.

A text's lines that aren't blank are hashed one by one, and a rolling hash over each of them and the one before ends a chunk
at about every third, wherever the same lines stand. Repeated chunks of two lines or more are settled first, whole. A passage
seldom begins and ends with a chunk, and a short one may hold none; so what is not within such a chunk is looked at through
overlapping windows of two lines, those across the borders of chunks included, and lines of 50 words or more also alone.

A piece (chunk or window) that stands in several places stays in the first one, by document id and place, and goes from the others,
with the blank lines within it. Which places hold the same piece is found by fingerprint and then settled by comparing the bytes:
pieces are grouped by their text. Where one fingerprint has several texts, each text is a class of its own. Every line that goes
stands in an earlier place too, and the first of these places stays; so no line is lost altogether. The windows within a chunk
that goes would all go by themselves: chunks save work and never change the result, which is that of the windows alone.

Defined cases: a NULL text stays NULL and an empty text empty; a single line of less than 50 words is never a piece; rows that agree
in id and text lose the same pieces (the first place is theirs alike); rows that agree in the id alone are told apart by a digest
of their text, and each loses its own pieces only; rows with a NULL id lose nothing; lines are split at
"\\n" only, of any length; an empty table gives an empty result; further columns stay as they are, also those that
have the name of a helper column; a column named like one of the three new ones is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import Scratch

#: Repeated fingerprints that are sent to every executor, at most (about 60 MB); more go through a shuffled join.
BROADCAST_KEYS = 1_000_000

#: A line that isn't blank, and one of 50 words or more. Anchored: a line is gone over once.
WRITTEN = r"[^\x20\x09-\x0D]"
LONG = r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){49}[^\x20\x09-\x0D]"

CHUNK, WINDOW = 0, 1


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def add_lines(df: DataFrame, text: Column) -> DataFrame:
    """Add `lines`, the lines of `text`, and `at`, the places of those that aren't blank; NULL for NULL."""
    return df.withColumn("lines", F.split(text, "\n")).withColumn(
        "at", F.filter(F.transform("lines", lambda line, i: i), lambda i: F.get("lines", i).rlike(WRITTEN))
    )


def add_spans(df: DataFrame) -> DataFrame:
    """Add `units`, the lines that aren't blank, and `spans`: the pieces as (kind, k, n, chunk), n units from the k-th on, and for
    windows the beginning of the chunk that they are in, or -1 for one across a border. `df` has the columns of add_lines().
    """
    return (
        df.withColumn("units", F.transform("at", lambda i: F.get("lines", i)))
        # One array for both: a column that is named only once would be put into the lambda and made anew for every line.
        .withColumn("facts", F.transform("units", lambda u: F.struct(F.pmod(F.xxhash64(u), F.lit(2147483647)).alias("h"), u.rlike(LONG).alias("long"))))
        .withColumn(
            "ends",
            F.expr(
                "filter(transform(facts, (x, j) -> j), j -> j = size(facts) - 1"
                " or j > 0 and (get(facts, j - 1).h * 1000003L + get(facts, j).h) % 2147483647L % 3 = 0)"
            ),
        )
        .withColumn("starts", F.expr("transform(ends, (e, i) -> if(i = 0, 0, get(ends, i - 1) + 1))"))
        .withColumn(
            "spans",
            F.expr(
                "flatten(transform(arrays_zip(starts, ends), c -> concat("
                f"filter(array(named_struct('kind', {CHUNK}, 'k', c.starts, 'n', c.ends - c.starts + 1, 'chunk', c.starts)), s -> s.n > 1),"
                f"filter(transform(sequence(c.starts, c.ends), j -> named_struct('kind', {WINDOW}, 'k', j, 'n', 2,"
                " 'chunk', if(j = c.ends, -1, c.starts))), s -> s.k < size(facts) - 1),"
                f"transform(filter(sequence(c.starts, c.ends), j -> get(facts, j).long), j -> named_struct('kind', {WINDOW}, 'k', j, 'n', 1,"
                " 'chunk', c.starts)))))"
            ),
        )
    )


def pieces(docs: DataFrame, mark, kind: int | None = None) -> DataFrame:
    """(doc_id, own, kind, k, n, chunk, key) of all pieces of `docs` (doc_id, own, text), or those of one kind with their text `piece`."""
    df = add_spans(add_lines(docs, F.col("text")))
    if kind is not None:
        df = df.withColumn("spans", F.filter("spans", lambda s: s.kind == kind))

    def piece(s: Column) -> Column:
        return F.array_join(F.slice("units", s.k + 1, s.n), "\n")

    def row(s: Column) -> Column:
        own = [s.kind.alias("kind"), s.k.alias("k"), s.n.alias("n"), s.chunk.alias("chunk"), mark(piece(s)).alias("key")]
        return F.struct(*own, *([] if kind is None else [piece(s).alias("piece")]))

    # The outer form: else a filter on the size of `spans` would be derived and pushed below, cutting every text again.
    rows = df.select("doc_id", "own", F.explode_outer(F.transform("spans", row)).alias("p"))
    return rows.select("doc_id", "own", "p.*").where("key is not null")


def repeated(keys: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, own, k, n): the pieces of `keys` that go. `rows` holds the same pieces with their texts, and maybe further ones
    that are known to go; it is read only for the keys that stand more than once in `keys`.
    """
    many = keys.groupBy("key").agg(F.count("*").alias("places")).where("places > 1").select("key")
    many, many_path = scratch.write(many, "many")
    if many.count() <= BROADCAST_KEYS:
        many = F.broadcast(many)
    rows, place = rows.join(many, "key"), F.struct("doc_id", "own", "k", "n")
    # The byte comparison: one class per key and text, and the place where it stands first.
    classes = (
        rows.groupBy("key", "piece")
        .agg(F.min(place).alias("first"))
        .groupBy("key")
        .agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    )
    classes, class_path = scratch.write(classes, "classes")
    columns = ["doc_id", "own", "k", "n"]
    one = keys.join(classes.where("texts = 1"), "key").where(place != F.col("first")).select(columns)
    clash = classes.where("texts > 1").select("key")
    if not clash.isEmpty():
        shared = rows.join(clash, "key")
        first = shared.groupBy("key", "piece").agg(F.min(place).alias("first"))
        one = one.union(shared.join(first, ["key", "piece"]).where(place != F.col("first")).select(columns))
    gone, _ = scratch.write(one, "gone")
    scratch.drop(many_path, class_path)
    return gone


def repeats(docs: DataFrame, scratch: Scratch, mark=fingerprint) -> DataFrame:
    """(doc_id, own, k, n): the pieces of `docs` (doc_id, own, text) that go; first the chunks, then what windows find beside them."""
    keys, key_path = scratch.write(pieces(docs, mark), "keys")
    chunks = repeated(keys.where(F.col("kind") == CHUNK), pieces(docs, mark, CHUNK), scratch)
    within = chunks.select("doc_id", "own", F.col("k").alias("chunk"))
    windows = keys.where(F.col("kind") == WINDOW).join(within, ["doc_id", "own", "chunk"], "left_anti")
    windows, window_path = scratch.write(windows, "windows")
    more = repeated(windows, pieces(docs, mark, WINDOW), scratch)
    scratch.drop(key_path, window_path)
    return chunks.union(more)


def dedup_lines(docs: DataFrame, mark=fingerprint) -> DataFrame:
    """`docs` with the repeated pieces left out of `text`, and three columns more: n_lines and removed_lines (long),
    of the text as it was, and removed_chunks (int), the runs of lines that went. Rows that lose nothing keep their text as it was.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    own = F.xxhash64("text").alias("own")
    gone = repeats(docs.select(doc_id, own, "text"), scratch, mark)
    gone = gone.groupBy("doc_id", "own").agg(F.collect_set(F.struct("k", "n")).alias("gone"))
    new = ["n_lines", "removed_lines", "removed_chunks"]
    others = [c for c in docs.columns if c not in new]
    whole = docs.select(doc_id, own, F.col("text"), F.struct(*[F.col(f"`{c}`") for c in others if c != "text"]).alias("row"))
    # Rows that lose a piece are cut once more, in place; for the others there is nothing to cut.
    loses = F.col("gone").isNotNull()
    # A shuffled join at every size: the rows that lose a piece grow with the input.
    out = add_lines(whole.join(gone.hint("merge"), ["doc_id", "own"], "left"), F.when(loses, F.col("text")))
    out = out.withColumn(
        "out", F.expr("array_sort(array_distinct(flatten(transform(gone, g -> sequence(get(at, g.k), get(at, g.k + g.n - 1))))))")
    )
    # Set difference by hash, not a search for every line.
    kept = F.expr("array_join(transform(array_except(transform(lines, (l, i) -> i), out), i -> get(lines, i)), '\n')")
    runs = F.expr("size(filter(out, (x, i) -> i = 0 or get(out, i - 1) != x - 1))")
    cut = F.struct(kept.alias("text"), F.size("out").alias("lines"), runs.alias("runs"))
    # One row in, one row out: filters on the new columns then stay above. Moved below they would hold the whole chain again, once
    # for every line.
    out = out.select("text", "row", loses.alias("loses"), F.explode_outer(F.array(F.when(loses, cut))).alias("cut"))
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    return out.select(
        *[(F.when(F.col("loses"), F.col("cut.text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"row.`{c}`")) for c in others],
        F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("cut.lines", F.lit(0)).cast("long").alias("removed_lines"),
        F.coalesce("cut.runs", F.lit(0)).cast("int").alias("removed_chunks"),
    )
