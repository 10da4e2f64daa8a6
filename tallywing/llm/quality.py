"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

1. `statistics` reads every whole text once and gives a row of numbers per document (Arrow batches in, numpy).
2. `train` joins the labels to these numbers, takes at most `sample` labelled rows by a hash of the id, and fits
   the trees on them.
3. `score` lets all rows go down the flattened trees.

Only the text decides a score. Defined cases: a NULL or empty text has zeros for all numbers and gets a score like
any other; labels that are NULL, and labels of unknown documents, are left out; a document labelled twice counts
twice; without labels, or with one class, all rows get that class's smoothed rate; an empty table gives an empty
result; further columns pass through `score_documents` untouched unless they have the name of a result column, which then
wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.llm import trees
from tallywing.llm.common import Scratch, fold, rows_by_id
from tallywing.llm.spans import Texts, distinct_per_text, shingles, steps

STATISTICS = [
    "n_bytes", "n_words", "n_lines", "word_bytes", "letter_share", "upper_share", "digit_share", "space_share",
    "mark_share", "symbol_share", "bar_share", "high_share", "stop_share", "distinct_share", "top_share", "repeat_share",
    "pair_share", "mark_words", "shout_words", "line_bytes", "line_repeat_share", "end_share",
]

#: Labelled rows that the trees are fitted on, at most (about: rows are taken by a hash of the id).
SAMPLE = 60_000

#: A document is kept from this score on.
THRESHOLD = 0.7


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_UPPER = _class(bytes(range(65, 91)))
_LETTER = _UPPER | _class(bytes(range(97, 123))) | (np.arange(256) >= 0x80)
_DIGIT = _class(b"0123456789")
_MARK = _class(b".,;:!?'\"()-")
_BAR = _class(b"|")
_SYMBOL = _class(b"#$%&*+/<=>@[\\]^_`{}~")
_END = _class(b".!?")


def statistics_of(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    t = Texts(column)
    buf, at = t.buf, t.at
    size = np.diff(at).astype(float)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at]).astype(float)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return part / np.maximum(whole, 1)

    starts, ends, first = t.words()
    hashes, _ = t.word_hashes()
    n = np.diff(first).astype(float)

    def per_words(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[first]).astype(float)

    def in_word(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[starts]

    letters, uppers = _LETTER[buf], _UPPER[buf]
    symbols = _SYMBOL[buf] | _BAR[buf]
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][n > 0]] = False
    _, counts, group = distinct_per_text(hashes, first)
    top = np.zeros(t.n)
    if len(counts):
        has = np.diff(group) > 0
        top[has] = np.maximum.reduceat(counts, group[:-1][has])
    pairs, pair_first = shingles(hashes, first, 2)
    _, _, pair_group = distinct_per_text(pairs, pair_first)
    wide = in_word(letters)
    line = buf == 10
    line_starts = np.unique(np.concatenate([at[:-1][size > 0], np.flatnonzero(line) + 1]))
    line_starts = line_starts[line_starts < len(buf)]
    line_first = np.searchsorted(line_starts, at)
    # A line's words as one number: equal lines have equal sums of their words' positions and hashes.
    word_line = np.searchsorted(line_starts, starts, "right") - 1
    line_sum = np.zeros(len(line_starts), np.uint64)
    if len(starts):
        begins = np.flatnonzero(np.diff(word_line, prepend=-1))
        within = np.arange(len(starts)) - np.repeat(begins, np.diff(np.append(begins, len(starts))))
        line_sum[word_line[begins]] = np.add.reduceat(hashes * (2 * within + 1).astype(np.uint64), begins)
    _, _, line_group = distinct_per_text(line_sum, line_first)
    lines = np.diff(line_first).astype(float)
    before = np.zeros(len(buf), bool)
    before[:-1] = line[1:]
    before[at[1:][size > 0] - 1] = True
    columns = [
        np.log1p(size), np.log1p(n), np.log1p(lines), share(in_total(ends - starts, first), n), share(per_text(letters), size),
        share(per_text(uppers), size), share(per_text(_DIGIT[buf]), size), share(size - in_total(ends - starts, first), size),
        share(per_text(_MARK[buf]), size), share(per_text(_SYMBOL[buf]), size), share(per_text(_BAR[buf]), size),
        share(per_text(buf >= 0x80), size), share(per_words(ends - starts <= 3), n), share(np.diff(group).astype(float), n),
        share(top, n), share(per_words(same), n), share(np.diff(pair_group).astype(float), np.maximum(n - 1, 1)),
        share(per_words(in_word(symbols) > 0), n), share(per_words((in_word(uppers) == wide) & (wide > 1)), n),
        np.log1p(share(size, lines)), 1 - share(np.diff(line_group).astype(float), lines), share(per_text(before & _END[buf]), lines),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def in_total(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[first]).astype(float)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the document statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                x = statistics_of(part.column("text"))
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, x.size + 1, len(STATISTICS)), pa.int32()), pa.array(x.ravel())
                )
                yield pa.record_batch([part.column("id"), flat], ["id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "id long, x array<float>"
    )


def train(numbers: DataFrame, labels: DataFrame, sample: int = SAMPLE, **params) -> trees.Forest:
    """Fit on at most about `sample` rows of `labels` (id, y), spread evenly by a hash of the id."""
    labels = labels.where("y is not null and id is not null")
    total = labels.count()
    # The ids are thinned before the join; exactly those below the limit are then kept, so the order of rows is nothing.
    if total > sample:
        labels = labels.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    rows = numbers.join(labels, "id").select("id", "x", F.col("y").cast("double")).toArrow()
    x = rows.column("x").combine_chunks()
    x = np.asarray(x.flatten(), np.float32).reshape(-1, len(STATISTICS)).astype(float)
    y = rows.column("y").to_numpy()
    order = np.lexsort((y, rows.column("id").to_numpy()))
    if not len(y):
        x, y, order = np.zeros((0, len(STATISTICS))), np.zeros(0), np.zeros(0, np.int64)
    return trees.fit(x[order], y[order], **params)


def score(numbers: DataFrame, forest: trees.Forest) -> DataFrame:
    """(id, score) of every row of `statistics`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float32).reshape(-1, len(STATISTICS)).astype(float)
            yield pa.record_batch([batch.column("id"), pa.array(forest.probability(x))], ["id", "score"])

    return numbers.mapInArrow(run, "id long, score double")


def training_labels(labels: DataFrame, column: str = "quality") -> DataFrame:
    """(id, y) of the rows whose crc32 of the id is not 2 modulo 4; the others are held out."""
    return labels.where(fold("doc_id", 4) != 2).select(F.col("doc_id").cast("long").alias("id"), F.col(column).alias("y"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    The statistics are written to the shared folder once; training and scoring read them there.
    """
    numbers, _ = Scratch(docs.sparkSession, "quality").write(statistics(docs), "statistics")
    forest = train(numbers, training_labels(labels), sample)
    return score(numbers, forest).select(
        F.col("id").alias("doc_id"),
        (fold("id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that the classifier doesn't reject, with all their columns.

    A second scoring pass over the texts is cheaper than a shuffle of them: the model from the first pass is applied
    to each row where it stands.
    """
    texts = docs.select("doc_id", "text")
    numbers = statistics(rows_by_id(texts, training_labels(labels).select("id").distinct(), "left_semi"))
    forest = train(numbers, training_labels(labels), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                good = forest.probability(statistics_of(part.column("text")).astype(float)) >= threshold
                yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
