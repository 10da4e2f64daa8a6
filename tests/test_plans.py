"""The shape of the plans that must hold at scale."""

import pytest
from pyspark.sql import functions as F

from tallywing.plans import load_registry

QUERIES = {name: q.build for name, q in load_registry().items()}


def initial(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q01_bank_volume", "q07_p2p_top_device", "t30_summary", "d02_fraud_by_bank"])
def test_one_scan_and_no_join(spark, small, name):
    text = initial(QUERIES[name](spark, small))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_only_needed_columns_are_read(spark, small):
    text = initial(QUERIES["t09_by_type"](spark, small))
    assert "ReadSchema: struct<event_id:bigint>" in text


@pytest.mark.parametrize("name", ["q03_top_age_food", "q14_top_fraud_txns", "q47_recent", "x01_hash_sample", "o05_row_cap"])
def test_top_k_does_not_sort_everything(spark, small, name):
    assert "TakeOrderedAndProject" in initial(QUERIES[name](spark, small))


@pytest.mark.parametrize("name", ["o06_last_per_group", "c06_history_window", "v01_nearest_examples", "v02_question_features", "r02_report_sections"])
def test_last_n_is_limited_before_the_shuffle(spark, small, name):
    text = initial(QUERIES[name](spark, small))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["fm08_auc_roc", "fm09_eval_report", "q23_median_amount", "q24_type_share", "q39_peak_hours"])
def test_fact_rows_are_read_once(spark, small, name):
    body = final(QUERIES[name](spark, small)).split("== Initial Plan ==")[0]
    assert body.count("FileScan") <= 1 and "ReusedExchange" in final(QUERIES[name](spark, small))


def test_split_needs_no_shuffle(spark, small):
    text = initial(QUERIES["fm03_stratified_split"](spark, small))
    assert "Exchange" not in text and "Window" not in text


def test_no_query_joins_all_pairs(spark, small):
    heavy = ("fm05", "fm1", "st0", "s0", "s1", "ts05", "ts07", "e02")
    ranked = {"v01_nearest_examples"}  # its cross joins have a side of k rows
    for name, build in QUERIES.items():
        if name not in ranked and not name.startswith(heavy):
            text = initial(build(spark, small))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_rows_stay_in_the_jvm(spark, small):
    python = {"v01_nearest_examples"}
    heavy = ("fm05", "fm1", "st0", "s0", "s1", "ts05", "ts07", "e02")
    for name, build in QUERIES.items():
        if name not in python and not name.startswith(heavy):
            text = initial(build(spark, small))
            assert "Python" not in text and "MapInPandas" not in text and "MapInArrow" not in text, name


def test_hot_user_is_split_in_the_lookup(spark):
    """A third of all rows belong to one user; the sorted join still splits them over tasks."""
    from tallywing.operators.joins import lookup

    user = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)
    fact = spark.range(300_000).select(user.alias("user_id"), "id")
    home = spark.range(1000).select(F.col("id").alias("user_id"), (F.col("id") % 15).alias("nation"))
    sizes = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        joined = lookup(fact, home, "user_id").select("id", "nation")
        assert "skewed" in final(joined)
        assert joined.count() == 300_000
    finally:
        for k in sizes:
            spark.conf.unset(k)
