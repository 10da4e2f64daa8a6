"""Exact searches by vectors and by words against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tallywing.operators import retrieval as V

K = 4


def brute_vectors(queries, corpus, k=K):
    """{(query id, vector): [(example, similarity)]} by all pairs."""
    usable = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
    scaled = lambda v: np.array(v) / (np.abs(v).max() or 1.0)
    unit = lambda v: scaled(v) / (np.linalg.norm(scaled(v)) or 1.0)
    out = {}
    for i, v in queries:
        if usable(v):
            sims = [(-round(float(unit(v) @ unit(c)), 12) + 0.0, e) for e, c in corpus if usable(c)]
            out[i, tuple(v)] = sorted(sims)[:k]
    return out


def check_vectors(spark, queries, corpus, **sizes):
    schema = "id long, vector array<double>"
    found = V.nearest_examples(spark.createDataFrame(queries, schema), spark.createDataFrame(corpus, schema), K, **sizes)
    got = Counter((r.query_id, r.example_id, round(r.similarity, 9), r.rank) for r in found.collect())
    want = Counter()
    for (i, _), best in brute_vectors(queries, corpus).items():
        want.update((i, e, round(-s, 9), n) for n, (s, e) in enumerate(best, 1))
    assert got == want


@pytest.mark.parametrize("block,chunk", [(4096, 2048), (60, 30)])
def test_vectors_equal_brute_force(spark, block, chunk):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 5))
    draw = lambda n: [(centres[i % 6] + rng.normal(size=5) / 5).tolist() for i in range(n)]
    corpus = [(100 + i, v) for i, v in enumerate(draw(300))]
    corpus += [(900 + i, corpus[5][1]) for i in range(30)]  # equal vectors: the smaller id counts
    corpus += [(50, [0.0] * 5), (51, None), (52, [math.nan] * 5), (53, []), (54, [1.0, None, 0.0, 0.0, 0.0]), (55, [1e300] * 5)]
    queries = list(enumerate(draw(36))) + [(7, corpus[5][1]), (41, [0.0] * 5), (42, None), (43, [-x for x in centres[0].tolist()])]
    check_vectors(spark, queries, corpus, block=block, chunk=chunk)


def test_twenty_thousand_queries_of_one_id(spark):
    """No task holds them all, and each of them is answered."""
    rng = np.random.default_rng(8)
    corpus = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))]
    queries = [(1, v.tolist()) for v in rng.normal(size=(20_000, 4)) / 10 + [1, 0, 0, 0]]
    check_vectors(spark, queries, corpus)


def test_few_examples_and_none(spark):
    schema = "id long, vector array<double>"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, [1.0, 0.0])], schema)
    assert V.nearest_examples(one, none, K).count() == 0
    assert V.nearest_examples(none, one, K).count() == 0
    assert [tuple(r) for r in V.nearest_examples(one, one, K).collect()] == [(1, 1, 1.0, 1)]
    zero = spark.createDataFrame([(2, [0.0, 0.0]), (3, [0.0, 0.0])], schema)
    assert [tuple(r) for r in V.nearest_examples(one, zero, 1).collect()] == [(1, 2, 0.0, 1)]
    assert sorted(tuple(r) for r in V.nearest_examples(zero, one, K).collect()) == [(2, 1, 0.0, 1), (3, 1, 0.0, 1)]


def brute_words(queries, corpus, k):
    words = lambda t: Counter(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))

    def merged(rows):
        out = {}
        for i, t in rows:
            out.setdefault(i, Counter()).update(words(t))
        return out

    docs, asked = merged(corpus), merged(queries)
    df = Counter(t for c in docs.values() for t in c)
    rounded = lambda x: math.floor(x + 0.5)
    weigh = lambda c: {t: w for t, n in c.items() if (w := rounded((math.log(n) + 1) * math.log((len(docs) + 1) / (df[t] + 1)) * 1000)) > 0}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    weights = {i: weigh(c) for i, c in docs.items()}
    out = {}
    for q, c in asked.items():
        qw = weigh(c)
        found = []
        for e, w in weights.items():
            dot = sum(x * w[t] for t, x in qw.items() if t in w)
            if dot:
                found.append((-dot / (norm(qw) * norm(w)), e))
        out[q] = [(e, -s) for s, e in sorted(found)[:k]]
    return {q: best for q, best in out.items() if best}


@pytest.mark.parametrize("hot,k", [(1000, 3), (12, 50)])
def test_words_equal_brute_force(spark, monkeypatch, hot, k):
    """Also with many hot terms, whose postings are dealt to parts."""
    monkeypatch.setattr(V, "HOT", hot)
    rng = np.random.default_rng(hot)
    vocabulary = [f"w{i}" for i in range(80)]
    chance = 1 / np.arange(1, 81)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=chance / chance.sum()))
    corpus = [(i, text(int(rng.integers(1, 25)))) for i in range(250)]
    corpus += [(300, None), (301, ""), (302, " \n"), (303, "W1 w1\tW1"), (304, corpus[3][1]), (305, corpus[3][1]), (7, "extra words w5"), (306, "w0 " * 500)]
    queries = [(i, text(int(rng.integers(1, 12)))) for i in range(60)]
    queries += [(100, None), (101, "unknown words only"), (102, "w1"), (103, "w0"), (104, corpus[3][1]), (105, corpus[3][1].upper()), (5, "w9 w70")]
    schema = "id long, text string"
    index = V.word_index(spark.createDataFrame(corpus, schema))
    found = V.similar_texts(spark.createDataFrame(queries, schema), index, k).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.example_id, r.similarity))
    want = brute_words(queries, corpus, k)
    assert {q: [e for e, _ in best] for q, best in got.items()} == {q: [e for e, _ in best] for q, best in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (_, a), (_, b) in zip(got[q], want[q]))


def test_the_floor_leaves_common_terms_out(spark):
    """A rare word decides; postings of the common one aren't joined unless they can reach the floor."""
    corpus = [(i, f"common filler{i % 7} " + ("rare " if i % 100 == 0 else "") + f"own{i}") for i in range(1000)]
    index = V.word_index(spark.createDataFrame(corpus, "id long, text string"))
    found = V.similar_texts(spark.createDataFrame([(1, "common rare")], "id long, text string"), index, 3)
    assert [r.example_id for r in found.orderBy("rank").collect()] == [e for e, _ in brute_words([(1, "common rare")], corpus, 3)[1]]


def test_words_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    assert V.similar_texts(some, V.word_index(none), 2).count() == 0
    assert V.similar_texts(none, V.word_index(some), 2).count() == 0
