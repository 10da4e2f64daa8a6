"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A document's features are the words of a learnt vocabulary (letters only, A-Z lowered) and the beginnings of words, of
PREFIXES bytes, each as log(1 + count). One
weight vector serves all grades: P(grade > k) = sigmoid(weights . x - threshold k), with ascending thresholds. The severity
is expected over grades: the sum of these chances.

1. Words whose share of toxic and clean training documents differs most become the vocabulary (counted in Spark over
   the whole sample of labelled documents; a fixed number of words is kept).
2. `fit` minimises the ordinal likelihood on the sample's sparse rows.
3. `score` goes over all whole texts, a lookup per word.

Labels that only say toxic or not are graded by `grades_of`: clean is 0; toxic documents are split into three equal
parts by how much of the vocabulary that speaks for toxicity they hold (the sum of their features).

Defined cases: a NULL or empty text has no features and gets the chance of such a document; labels that are NULL or of
unknown documents are left out; without labels of both kinds nothing is learnt and every severity is the same; rows
with equal ids are scored each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import Scratch, fold
from tallywing.llm.spans import LOWER, Texts, distinct_per_text, hash_spans, mix, steps

#: Labelled documents that the model is fitted on, at most (about: they are taken by a hash of the id).
SAMPLE = 20_000

#: Lengths of the beginnings that are features beside whole words; they stand for inflected and compound forms.
PREFIXES = (4, 5)

#: Words in the vocabulary, at most.
WORDS = 2048

#: Documents of the sample that must have a word, and standard errors by which its two shares must differ.
LEAST, TELLING = 3, 4.0

GRADES = 4

_LETTERS = np.full(256, 0x20, np.uint8)
for _b in (*range(65, 91), *range(97, 123), *range(0x80, 0x100)):
    _LETTERS[_b] = _b


def word_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text, their counts, and the first of each text."""
    t = Texts(column)
    t.buf = LOWER[_LETTERS[t.buf]]
    starts, ends, first = t.words()
    kinds = [hash_spans(t.buf, starts, ends)]
    kinds += [mix(hash_spans(t.buf, starts, np.minimum(ends, starts + n)) + np.uint64(n)) for n in PREFIXES]
    every = np.stack(kinds, axis=1).ravel()
    return distinct_per_text(every, first * len(kinds))


@dataclass(frozen=True)
class Ordinal:
    """`words` are ascending hashes; `thresholds` ascend, one fewer than there are grades."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k) for every row and k."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds[None, :], -50, 50)))

    def linear(self, values: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(self.words) or not len(values):
            return np.zeros(len(first) - 1)
        place = np.minimum(np.searchsorted(self.words, values), len(self.words) - 1)
        part = np.where(self.words[place] == values, self.weights[place] * np.log1p(counts), 0.0)
        return np.diff(np.concatenate([[0.0], np.cumsum(part)])[first])


def fit(
    rows: np.ndarray, columns: np.ndarray, x: np.ndarray, grade: np.ndarray, width: int, grades: int = GRADES,
    ridge: float = 2e-5, rounds: int = 1500, rate: float = 0.05,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from sparse entries (row, column, x) and a grade per row, by Adam on the whole sample.

    Thresholds are the first one plus positive steps, so they stay in order. A grade that never occurs is allowed.
    """
    n = max(len(grade), 1)
    share = np.array([(grade > k).mean() if len(grade) else 0.5 for k in range(grades - 1)])
    start = -np.log((share + 1e-3) / (1 - share + 1e-3))
    steps_ = np.log(np.expm1(np.maximum(np.diff(start), 0.05)))
    p = np.concatenate([np.zeros(width), start[:1], steps_])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, rounds + 1):
        w, raw = p[:width], p[width:]
        theta = raw[0] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, raw[1:]))])
        linear = np.bincount(rows, x * w[columns], n) if len(rows) else np.zeros(n)
        cum = 1 / (1 + np.exp(-np.clip(linear[:, None] - theta, -50, 50)))  # P(grade > k)
        full = np.concatenate([np.ones((n, 1)), cum, np.zeros((n, 1))], axis=1)
        at = np.arange(len(grade))
        chance = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
        slope = full * (1 - full)
        up, down = slope[at, grade] / chance, slope[at, grade + 1] / chance
        d_linear = -(up - down)
        d_theta = np.zeros(grades - 1)
        np.add.at(d_theta, grade[grade > 0] - 1, up[grade > 0])
        np.add.at(d_theta, grade[grade < grades - 1], -down[grade < grades - 1])
        grad = np.zeros_like(p)
        if len(rows):
            grad[:width] = np.bincount(columns, x * d_linear[rows], width) / n
        grad[:width] += ridge * w
        grad[width] = d_theta.sum() / n
        grad[width + 1 :] = np.cumsum(d_theta[::-1])[::-1][1:] / n / (1 + np.exp(-raw[1:]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    raw = p[width:]
    return p[:width], raw[0] + np.concatenate([[0.0], np.cumsum(np.logaddexp(0, raw[1:]))])


def grades_of(toxic: np.ndarray, amount: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for clean; toxic ones from 1 up in equal parts by their amount of telling words, ties to the lower grade."""
    out = np.zeros(len(toxic), np.int64)
    own = amount[toxic > 0]
    if len(own):
        cuts = np.quantile(own, np.linspace(0, 1, grades)[1:-1])
        out[toxic > 0] = 1 + np.searchsorted(cuts, own, "left")
    return out


def _sample_words(docs: DataFrame, labels: pa.Table) -> DataFrame:
    """(id, y, words, counts) of the labelled documents, a row for each label. `labels` (id, y) is the bounded sample; it
    goes with the code to where the documents are, so no list of features is shuffled.
    """
    order = np.lexsort((labels.column("y").to_numpy(), labels.column("id").to_numpy()))
    known, y = labels.column("id").to_numpy()[order], labels.column("y").to_numpy()[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            has = np.searchsorted(known, ids, "right") > np.searchsorted(known, ids, "left")
            for part in steps(batch.filter(pa.array(has)), "text"):
                values, counts, first = word_counts(part.column("text"))
                at = pa.array(first, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(a)) for a in (values.view(np.int64), counts.astype(np.int64))]
                ids = part.column("doc_id").to_numpy()
                low, high = np.searchsorted(known, ids, "left"), np.searchsorted(known, ids, "right")
                which = np.repeat(np.arange(len(ids)), high - low)
                label = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]
                take = pa.array(which)
                columns = [part.column("doc_id").take(take), pa.array(y[label], pa.int32()), *(a.take(take) for a in lists)]
                yield pa.record_batch(columns, ["id", "y", "words", "counts"])

    return docs.where("doc_id is not null").mapInArrow(run, "id long, y int, words array<long>, counts array<long>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, grades: int = GRADES) -> Ordinal:
    """Fit on at most about `sample` of the labels (id, y), y being 1 for toxic. `docs` has doc_id and text."""
    labels = labels.where("y is not null and id is not null").select("id", F.col("y").cast("int").alias("y"))
    total = labels.count()
    if total > sample:
        labels = labels.where(F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    labels = labels.toArrow()  # about `sample` rows
    toxic = int(labels.column("y").to_numpy().sum()) if len(labels) else 0
    clean = len(labels) - toxic
    if not toxic or not clean:
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.arange(grades - 1) + (-5.0 if toxic else 5.0))
    # Written once: the vocabulary and the fit read the same rows.
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows, path = scratch.write(_sample_words(docs, labels), "sample")
    per = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("t"), F.count("*").alias("d"))
    rate = (F.col("t") / toxic, (F.col("d") - F.col("t")) / clean)
    spread = F.sqrt(F.col("d") / (toxic + clean) * (1 / toxic + 1 / clean))
    telling = per.where(F.col("d") >= LEAST).select("word", ((rate[0] - rate[1]) / spread).alias("z"))
    kept = telling.where(F.abs("z") >= TELLING).orderBy(F.abs("z").desc(), "word").limit(words).toArrow()  # the vocabulary: a fixed number of words
    order = np.argsort(kept.column("word").to_numpy().view(np.uint64))
    vocabulary, z = kept.column("word").to_numpy().view(np.uint64)[order], kept.column("z").to_numpy()[order]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            flat, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            counts = batch.column("counts").flatten().to_numpy()
            place = np.minimum(np.searchsorted(vocabulary, flat), max(len(vocabulary) - 1, 0))
            has = vocabulary[place] == flat if len(vocabulary) else np.zeros(len(flat), bool)
            at = pa.array(np.concatenate([[0], np.cumsum(has)])[offsets], pa.int32())
            parts = [pa.ListArray.from_arrays(at, pa.array(a[has].astype(np.int64))) for a in (place, counts)]
            yield pa.record_batch([batch.column("id"), batch.column("y"), *parts], ["id", "y", "places", "counts"])

    found = rows.mapInArrow(keep, "id long, y int, places array<long>, counts array<long>").toArrow().combine_chunks()
    scratch.drop(path)
    by = np.lexsort((found.column("y").to_numpy(), found.column("id").to_numpy()))
    found = found.take(pa.array(by)).combine_chunks()
    lists = found.column("places").combine_chunks()
    rows_ = np.repeat(np.arange(len(found)), np.diff(lists.offsets.to_numpy()))
    columns = lists.flatten().to_numpy()
    counts = found.column("counts").combine_chunks().flatten().to_numpy()
    y, x = found.column("y").to_numpy(), np.log1p(counts)
    amount = np.bincount(rows_, x * (z > 0)[columns], len(found)) if len(rows_) else np.zeros(len(found))
    weights, thresholds = fit(rows_, columns, x, grades_of(y, amount, grades), len(vocabulary), grades)
    return Ordinal(vocabulary, weights, thresholds)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, expected_severity, severity, p_toxic, predicted): the expected and the likeliest grade, the chance of any grade
    above 0, and whether that is at least a half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                values, counts, first = word_counts(part.column("text"))
                above = model.above(model.linear(values, counts, first))
                edges = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
                columns = [
                    part.column("doc_id"), pa.array(above.sum(axis=1)), pa.array((edges[:, :-1] - edges[:, 1:]).argmax(axis=1).astype(np.int32)),
                    pa.array(above[:, 0]), pa.array((above[:, 0] >= 0.5).astype(np.int32)),
                ]
                yield pa.record_batch(columns, ["doc_id", "expected_severity", "severity", "p_toxic", "predicted"])

    return docs.mapInArrow(run, "doc_id long, expected_severity double, severity int, p_toxic double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`score` of every row, learnt from labels whose crc32 of the id is not 2 modulo 4; and `held_out` for those where it is."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = labels.where(fold("doc_id", 4) != 2).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("y"))
    out = score(texts, train(texts, own, sample))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "expected_severity", "severity", "p_toxic", "predicted")
