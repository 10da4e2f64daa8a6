"""Every operator on rows that are NULL, empty, very long, repeated or tied, with extra columns, and on empty tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywing.llm import decontaminate, embeddings, jaccard, lines, lm, packing, pii, quality, sharding, toxicity

CLASH = "id long, row string, n long, key string, chunks string, start int, lines string, other_id long, length int, x int"
DOCS = "doc_id long, text string, lang string, " + CLASH
LONG = " ".join(f"w{i % 997} q{i}" for i in range(60_000)) + "\n" + "\n".join("same line" for _ in range(500))
SAME = "one two three four five six seven\nsecond line of it\nthird line of it\nfourth line of it"
TEXTS = [(1, SAME), (1, SAME), (2, None), (3, ""), (4, LONG), (None, SAME), (5, " \n\t"), (6, "é ü 🙂"), (7, "A\x00b"), (None, None), (8, SAME)]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (7, "r", 1, "k", "c", 2, "l", 3, 4, None)
    return spark.createDataFrame([(i, t, None, *extra) for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (4, 0, 1), (99, 1, 1), (None, 1, 0), (3, None, None), (8, 1, 1), (8, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "two three four five SIX seven second"), (2, None), (3, ""), (4, "é ü"), (5, "é ü")], "item_id long, text string")


def test_quality(docs, none, labels):
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == len(TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.score_documents(none, labels).count() == 0
    assert quality.score_documents(docs, labels.limit(0)).count() == len(TEXTS)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(TEXTS)
    assert quality.keep_good(none, labels).count() == 0


def test_lines(docs, none):
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "removed_lines", "removed_chunks"][: len(docs.columns)] + ["n_lines", "removed_lines", "removed_chunks"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert len(got) == len(TEXTS)
    assert [t for i, t in got if i in (2, 3, 5, 6, 7)] == [t for i, t in sorted(TEXTS, key=repr) if i in (2, 3, 5, 6, 7)]
    # The row without an id stands first and keeps its text; the two rows with id 1 lose the same chunks.
    assert [t for i, t in got if i is None and t] == [SAME]
    ones = [t for i, t in got if i == 1]
    assert ones[0] == ones[1] != SAME
    assert lines.dedup_lines(none).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    """Row (2, A) repeats row (1, A) and goes; row (2, B) stands nowhere else and stays whole."""
    one, two = ("\n".join(f"{c} line {i} of it" for i in range(12)) for c in "AB")
    df = spark.createDataFrame([(1, one), (2, one), (2, two), (2, two)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(df).collect())
    assert got[0] == (1, one) and [t for i, t in got if i == 2].count(two) == 2 and len(got) == 4
    clash = sorted((r.doc_id, r.text) for r in lines.dedup_lines(df, lambda text: F.lit(1).cast("long")).collect())
    assert clash == got


def test_jaccard(spark, docs, none):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_documents(docs).collect()), key=repr)
    by = {i: (n, c) for i, n, c in got if i is not None}
    assert len(got) == len(TEXTS)
    assert by[1] == by[8] == (15, 1)
    assert by[2] == (0, 2) and by[3] == (0, 3) and by[5] == (0, 5)
    assert by[6] == (1, 6) and by[7] == (1, 7)
    assert [(n, c) for i, n, c in got if i is None] == [(0, None), (15, None)]
    assert jaccard.link_documents(none).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 3, 4, 5, 6, 7, None, None]
    two = spark.createDataFrame([(1, SAME, "b"), (1, SAME, "a"), (1, "other", "c"), (2, SAME, "d"), (None, SAME, "e")], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in jaccard.one_of_each(two).where("doc_id is not null").collect()) == [(1, SAME, "a"), (1, "other", "c")]


def test_decontaminate(docs, none, items):
    got = sorted((r.doc_id, r.item_id, r.start, r.shared, r.total) for r in decontaminate.matches(docs, items).where("doc_id is not null").collect())
    assert got == [(1, 1, 1, 3, 3), (6, 4, 0, 1, 1), (6, 5, 0, 1, 1), (8, 1, 1, 3, 3)]
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.matches(docs, items.limit(0)).count() == 0
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [2, 3, 4, 5, 7, None, None]


def test_packing(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    assert sum(r.start == 0 for r in rows) == len(TEXTS)
    assert {r.doc_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert packing.pack(none, path).count() == 0


def test_sharding(docs, none):
    out, m = sharding.shard(docs, 3)
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sum(r.size for r in rows) == sum(len((t or "").encode()) + 1 for _, t in TEXTS)
    out, m = sharding.shard(none, 3)
    assert out.count() == 0 and m.shard_of == {}


def test_lm(docs, none):
    rows = lm.score_documents(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.score < 0 and r.base_score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 5)} == {1}
    assert lm.score_documents(none).count() == 0


def test_pii(docs, none):
    out = pii.pseudonymise(docs, b"key")
    assert set(out.columns) >= set(docs.columns)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(TEXTS, key=repr)
    assert pii.pseudonymise(none, b"key").count() == 0


def test_toxicity(docs, none, labels):
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.expected_severity <= 3 for r in rows)
    assert toxicity.score_documents(none, labels).count() == 0
    rows = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len({r.expected_severity for r in rows}) == 1


def test_embeddings(spark):
    schema = T.StructType([
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("unit", T.StringType()),
        T.StructField("keys", T.LongType()),
    ])
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]), (2, [2.0, 0.0]), (11, [1e-30, 0.0]), (12, [3e38, 0.0]),
        (10, [0.0, 1.0]), (0, [0.0, 3.0]), (None, None),
    ]
    df = spark.createDataFrame([(i, v, "u", 1) for i, v in rows], schema)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()), key=str)
    # Every vector has a row: the two of id 2 are equal and link, those of id 10 are far apart, and one has another partner.
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (11, 4, 1, False), (12, 4, 1, False)]
    want += [(10, 0, 10, True), (10, 1, 0, False), (0, 1, 0, True), *[(None, 0, None, True)] * 2]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)]
    assert got == sorted(want, key=str) and len(got) == len(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """The pipeline's own rules on NULLs, empty texts, repeated and NULL ids and a very long text, and on an empty table."""
    import corpus_pipeline

    rows = [(i, t, None, "s", None if t is None else len(t)) for i, t in TEXTS]
    edges = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    cut = corpus_pipeline.without_repeats(spark, edges, str(tmp_path))
    assert cut.columns == corpus_pipeline.COLUMNS
    cut = cut.collect()
    # Of the copies of SAME, the row without an id stands first; the others have no words left and go.
    assert sorted((r.doc_id for r in cut), key=repr) == [2, 3, 4, 5, 6, 7, None, None]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut)
    assert corpus_pipeline.without_repeats(spark, edges.limit(0), str(tmp_path)).count() == 0
    near = corpus_pipeline.one_of_each(spark, edges, str(tmp_path))
    assert near.columns == corpus_pipeline.COLUMNS
    assert sorted((r.doc_id for r in near.collect()), key=repr) == [1, 2, 3, 4, 5, 6, 7, None, None]
