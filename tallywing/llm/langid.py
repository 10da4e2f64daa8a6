"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lowered and every run of other characters than letters becomes one space, so that a word reads " word ". Its
n-grams of 1 to 3 characters are hashed into SLOTS features; a feature's value is (1 + log(count)) times the inverse
document frequency, and a text's features have length one.

1. `frequencies` counts over all training documents in how many of them each feature occurs, in Spark.
2. `train` takes at most about PER_LANGUAGE training documents of each language, spread evenly by a hash of id and text,
   and fits on four fifths of them with follow-the-regularised-leader: a learning rate per coordinate, an L1 penalty
   that leaves most weights zero, and an L2 penalty.
3. The sample holds languages alike, the corpus doesn't: a language's score gets the logarithm of how many documents one of
   its sampled ones stands for. On the remaining fifth one temperature is fitted, by which scores are divided before they
   become chances; each row counts for as many documents as it stands for.
4. `predict` goes over all whole texts; only the weights that are not zero are sent to the tasks.

Defined cases: a NULL text, an empty one and one without any letter are `und` with score 0; documents whose lang is NULL
teach nothing; with one language in the training documents every text with a letter gets it; with none, every text is
`und`; rows with equal ids are predicted each; an empty table gives an empty result; languages that tie go to the first by
name; only doc_id, text and lang are read, and of these only the text is an input of a prediction. A NULL id counts as the
empty text where folds are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.llm.common import fold
from tallywing.llm.spans import distinct_per_text, steps

#: Training documents of each language that the weights and the temperature are fitted on, at most (about).
PER_LANGUAGE = 1500

#: Features; two bytes number them.
SLOTS = 1 << 16

LENGTHS = (1, 2, 3)

#: Rate, its slow-down, and both penalties of the regularised leader; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.05, 0.5, 3

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each as " word word ", and where each text begins; a text without letters is empty."""
    lowered = [(t or "").lower() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])]).astype(np.int64)
    every = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[every]
    # A space stays where a letter follows or has gone before; `every` has a space behind each text.
    after = np.zeros(len(every), bool)
    after[1:] = is_letter[:-1]
    keep = is_letter | after
    kept_at = np.concatenate([[0], np.cumsum(keep)])[at]
    points = np.where(is_letter, every, 32)[keep]
    # One space more at the front of each text that has letters.
    filled = np.diff(kept_at) > 0
    points = np.insert(points, kept_at[:-1][filled], 32)
    return points.astype(np.uint64), kept_at + np.concatenate([[0], np.cumsum(filled)])


def ngram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each text, ascending, their counts, and the first of each text."""
    points, at = _points(texts)
    first = np.zeros(len(at), np.int64)
    blocks, own = [], []
    for n in LENGTHS:
        many = len(points) - n + 1
        if many <= 0:
            continue
        h = np.full(many, n, np.uint64)
        for j in range(n):
            h = (h ^ points[j : many + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        slot = (h >> np.uint64(13)).astype(np.uint16)
        # An n-gram must end within its text; a lone space is no feature.
        text = np.searchsorted(at, np.arange(many), "right") - 1
        inside = np.arange(many) + n <= at[text + 1]
        if n == 1:
            inside &= points != 32
        blocks.append(slot[inside])
        own.append(text[inside])
    if not blocks:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64), first
    # The lists of each length are dealt out so that a text's features stand together.
    sizes = np.stack([np.bincount(t, minlength=len(texts)) for t in own])
    total = sizes.sum(axis=0)
    first[1:] = np.cumsum(total)
    values = np.empty(int(first[-1]), np.uint16)
    begin = first[:-1].copy()
    for block, t, size in zip(blocks, own, sizes):
        starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        values[np.arange(len(block)) - starts[t] + begin[t]] = block
        begin += size
    return distinct_per_text(values, first)


def weigh(values: np.ndarray, counts: np.ndarray, first: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of each feature, every text having length one."""
    x = (1 + np.log(counts)) * idf[values]
    total = np.concatenate([[0.0], np.cumsum(x * x)])[first]
    length = np.sqrt(np.maximum(np.diff(total), 1e-300))
    return x / np.repeat(length, np.diff(first))


def fit(
    values: np.ndarray, x: np.ndarray, first: np.ndarray, y: np.ndarray, classes: int, slots: int = SLOTS,
    alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, passes: int = PASSES,
) -> np.ndarray:
    """Weights (slots, classes) by follow-the-regularised-leader, row after row in an order of its own.

    z collects gradients less what past weights would undo, n their squares; a weight follows from both and is zero
    while |z| is at most l1.
    """
    z, n = np.zeros((slots, classes)), np.zeros((slots, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        rate = (beta + np.sqrt(n)) / alpha + l2
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / rate, 0.0)

    rng = np.random.default_rng(13)
    for _ in range(passes):
        for i in rng.permutation(len(y)).tolist():
            own, value = values[first[i] : first[i + 1]], x[first[i] : first[i + 1]]
            zi, ni = z[own], n[own]
            w = weights(zi, ni)
            score = value @ w
            chance = np.exp(score - score.max())
            chance /= chance.sum()
            chance[y[i]] -= 1
            g = value[:, None] * chance[None, :]
            grown = ni + g * g
            z[own] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[own] = grown
    return weights(z, n)


def scores(values: np.ndarray, x: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Linear scores (texts, classes)."""
    out = np.zeros((len(first) - 1, weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.diff(np.concatenate([[0.0], np.cumsum(x * weights[values, k])])[first])
    return out


def chances(linear: np.ndarray, temperature: float) -> np.ndarray:
    p = np.exp((linear - linear.max(axis=1, keepdims=True)) / temperature) if linear.size else linear.copy()
    return p / p.sum(axis=1, keepdims=True) if linear.size else p


def fit_temperature(linear: np.ndarray, y: np.ndarray, weight: np.ndarray, least: float = 0.02, most: float = 20.0) -> float:
    """The temperature with the least weighted log loss, by golden sections of its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = chances(linear, np.exp(t))[np.arange(len(y)), y]
        return float(-(weight * np.log(np.maximum(p, 1e-300))).sum() / weight.sum())

    low, high, cut = np.log(least), np.log(most), (np.sqrt(5) - 1) / 2
    a, b = high - cut * (high - low), low + cut * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(60):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - cut * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + cut * (high - low)
            fb = loss(b)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Languages:
    """`used` are the ascending features with a weight that is not zero, `weights` theirs (used, languages); `offset` is added."""

    names: list[str]
    idf: np.ndarray
    used: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Name and chance of the likeliest language of each text."""
        values, counts, first = ngram_counts(texts)
        x = weigh(values, counts, first, self.idf.astype(np.float64))
        place = np.full(SLOTS, len(self.used), np.int64)
        place[self.used] = np.arange(len(self.used))
        full = np.concatenate([self.weights, np.zeros((1, len(self.names)))])
        known = (np.diff(first) > 0) & bool(self.names)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = chances(scores(place[values], x, first, full) + self.offset, self.temperature)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
        names = [self.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        return names, np.where(known, p[np.arange(len(p)), best], 0.0)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        for part in steps(batch, "text"):
            yield part, part.column("text").to_pylist()


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and of those with each feature. At most a row per feature comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)  # the last counts texts
        for _, texts in _batches(batches):
            values, _, first = ngram_counts(texts)
            total[:SLOTS] += np.bincount(values, minlength=SLOTS)
            total[SLOTS] += (np.diff(first) > 0).sum()
        has = np.flatnonzero(total)
        yield pa.record_batch([pa.array(has.astype(np.int32)), pa.array(total[has])], ["slot", "n"])

    rows = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(SLOTS + 1, np.int64)
    total[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return int(total[SLOTS]), total[:SLOTS]


def _spread(salt: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), "doc_id", "text"), F.lit(1 << 30))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, **params) -> Languages:
    """Learn from the documents (doc_id, text, lang) whose lang is not NULL."""
    docs = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    names = sorted(sizes)
    total, has = frequencies(docs)
    idf = (np.log((1 + total) / (1 + has)) + 1).astype(np.float32)
    if not names:
        return Languages([], idf, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 1.0)
    bound = {k: int(min(1.0, per_language / n) * (1 << 30)) for k, n in sizes.items()}
    limit = F.create_map(*[F.lit(v) for k, b in bound.items() for v in (k, b)])[F.col("lang")]
    number = {k: i for i, k in enumerate(names)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches):
            values, counts, first = ngram_counts(texts)
            at = pa.array(first, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(a.astype(np.int32))) for a in (values, counts)]
            y = pa.array([number[k] for k in part.column("lang").to_pylist()], pa.int32())
            yield pa.record_batch([part.column("order"), y, *lists], ["order", "y", "slots", "counts"])

    sample = docs.where(_spread("fit") < limit).select(_spread("order").alias("order"), "text", "lang")
    rows = sample.mapInArrow(features, "order long, y int, slots array<int>, counts array<int>").toArrow().combine_chunks()
    order = rows.column("order").to_numpy()
    y = rows.column("y").to_numpy()
    lists = [rows.column(c).combine_chunks() if len(rows) else None for c in ("slots", "counts")]
    if len(rows):
        # Ties are rows with equal ids and texts, whose features agree.
        by = np.lexsort((y, order))
        lists = [a.take(pa.array(by)) for a in lists]
        order, y = order[by], y[by]
        first = lists[0].offsets.to_numpy().astype(np.int64)
        values, counts = (a.flatten().to_numpy() for a in lists)
    else:
        first, values, counts = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    full = np.diff(first) > 0
    x = weigh(values, counts, first, idf.astype(np.float64))
    tuning = (np.arange(len(y)) % 5 == 4) & full
    learning = ~tuning & full

    def part(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        each = np.repeat(mask, np.diff(first))
        return values[each], x[each], np.concatenate([[0], np.cumsum(np.diff(first)[mask])]), y[mask]

    weights = fit(*part(learning), len(names), **params)
    taken = np.bincount(y, minlength=len(names))
    stands_for = np.array([sizes[k] for k in names]) / np.maximum(taken, 1)
    v, vx, vfirst, vy = part(tuning)
    offset = np.log(stands_for)
    temperature = fit_temperature(scores(v, vx, vfirst, weights) + offset, vy, stands_for[vy])
    used = np.flatnonzero(weights.any(axis=1))
    return Languages(names, idf, used, weights[used], offset, temperature)


def predict(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _batches(batches):
            names, chance = model.predict(texts)
            yield pa.record_batch([part.column("doc_id"), pa.array(names, pa.string()), pa.array(chance)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of `docs`, learnt from those whose crc32 of the id is not 1 modulo 3."""
    rows = docs.select(*[F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"))])
    out = F.coalesce(fold(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 3) == 1, F.lit(False))
    model = train(rows.where(~out), per_language)
    return predict(rows, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
