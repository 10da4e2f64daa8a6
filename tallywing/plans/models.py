"""Fraud-model operators over the whole transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.functions import features as X
from tallywing.operators import attribution as A
from tallywing.operators import fraud_model as M
from tallywing.operators import metrics as ME
from tallywing.operators.joins import dictionary_lookup
from tallywing.operators.ranking import hash_sample
from tallywing.operators.sampling import class_weight, fit_label_encoder, quick_split, stratified_split
from tallywing.plans.corpus import rows
from tallywing.plans.registry import on_transactions, register
from tallywing.session import fingerprint_of_files, scratch_path
from tallywing.sources.fixture import transactions

_FEATURES_SQL = ", ".join(S.FEATURE_COLUMNS)


@on_transactions(
    "fm01_select_features",
    f"SELECT transaction_id, {_FEATURES_SQL}, fraud_flag FROM transactions",
    state=True,
)
def fm01_select_features(t: DataFrame) -> DataFrame:
    return M.select_features(t, "transaction_id")


DICTIONARY_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {c} AS "value", dense_rank() OVER (ORDER BY {c}) - 1 AS code
        FROM transactions GROUP BY {c}"""
    for c in S.CATEGORICAL_COLUMNS
)


@on_transactions("fm02_label_encoder", DICTIONARY_SQL, state=True)
def fm02_label_encoder(t: DataFrame) -> DataFrame:
    return fit_label_encoder(t, S.CATEGORICAL_COLUMNS)


@on_transactions(
    "j04_dictionary_lookup",
    """WITH d AS (SELECT sender_bank AS v, dense_rank() OVER (ORDER BY sender_bank) - 1 AS code
                 FROM transactions WHERE fraud_flag = 1 AND network_type = '3G' GROUP BY 1)
       SELECT receiver_bank, coalesce(code, 0) AS receiver_bank_code, count(*) AS count
       FROM transactions LEFT JOIN d ON v = receiver_bank GROUP BY 1, 2""",
)
def j04_dictionary_lookup(t: DataFrame) -> DataFrame:
    """Codes learnt from few rows and used on all: values unseen there get code 0."""
    few = t.filter("fraud_flag = 1 AND network_type = '3G'").select(F.col("sender_bank").alias("receiver_bank"))
    coded = dictionary_lookup(t, fit_label_encoder(few, ["receiver_bank"]), ["receiver_bank"])
    return coded.groupBy("receiver_bank", "receiver_bank_code").agg(rows())


# Quotas by largest remainder, then the exact rank of every row's hash within its class.
SPLIT_SQL = """s_n AS (SELECT count(*) AS n, count(*) - CAST(ceil(count(*) * 0.2e0) AS BIGINT) AS train FROM transactions),
 s_c AS (SELECT fraud_flag, count(*) AS size FROM transactions GROUP BY 1),
 s_f AS (SELECT fraud_flag, (size * train) // n AS whole, (size * train) % n AS rest, train FROM s_c, s_n),
 s_q AS (SELECT fraud_flag,
                whole + CAST(row_number() OVER (ORDER BY rest DESC, fraud_flag)
                             <= any_value(train) OVER () - sum(whole) OVER () AS INTEGER) AS quota FROM s_f),
 split AS (SELECT t.*, row_number() OVER (PARTITION BY t.fraud_flag ORDER BY md5(transaction_id || '#42'), transaction_id)
                       > quota AS is_test
           FROM transactions t JOIN s_q USING (fraud_flag))"""


@on_transactions("fm03_stratified_split", f"WITH {SPLIT_SQL} SELECT transaction_id, fraud_flag, is_test FROM split")
def fm03_stratified_split(t: DataFrame) -> DataFrame:
    return stratified_split(t.select("transaction_id", "fraud_flag"), "fraud_flag", "transaction_id")


@on_transactions(
    "fm03_quick_split",
    """SELECT fraud_flag, CAST('0x' || left(md5(transaction_id || '#42'), 8) AS UBIGINT) / 4294967296e0 < 0.2e0 AS is_test,
              count(*) AS count FROM transactions GROUP BY 1, 2""",
)
def fm03_quick_split(t: DataFrame) -> DataFrame:
    """Sizes of the approximate split."""
    return quick_split(t, "transaction_id").groupBy("fraud_flag", "is_test").agg(rows())


@on_transactions(
    "fm04_class_weight",
    """SELECT count(*) FILTER (WHERE fraud_flag = 0) AS negatives, count(*) FILTER (WHERE fraud_flag = 1) AS positives,
              count(*) FILTER (WHERE fraud_flag = 0) * 1e0 / count(*) FILTER (WHERE fraud_flag = 1) AS weight
       FROM transactions""",
)
def fm04_class_weight(t: DataFrame) -> DataFrame:
    return class_weight(t, "fraud_flag")


def rule_scored(t: DataFrame) -> DataFrame:
    """The rule's score in 0..1 as if it were a model's; at 0.2 and above it says fraud."""
    p = X.row_risk_permille() / F.lit(300.0)
    return t.select("transaction_id", F.col("fraud_flag").alias("label"), p.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.2).cast("int")
    )


CONFUSION_SQL = """SELECT count(*) FILTER (WHERE label = 0 AND NOT said) AS true_negatives,
    count(*) FILTER (WHERE label = 0 AND said) AS false_positives,
    count(*) FILTER (WHERE label = 1 AND NOT said) AS false_negatives,
    count(*) FILTER (WHERE label = 1 AND said) AS true_positives
  FROM (SELECT fraud_flag AS label, risk / 300e0 >= 0.2 AS said FROM {source})"""
AUC_SQL = """SELECT round(sum(CASE WHEN label = 1 THEN below + same / 2e0 END)
    / (count(*) FILTER (WHERE label = 1) * 1e0 * count(*) FILTER (WHERE label = 0)), 4) AS auc_roc
  FROM (SELECT fraud_flag AS label,
               count(*) FILTER (WHERE fraud_flag = 0) OVER (ORDER BY risk RANGE UNBOUNDED PRECEDING)
                 - count(*) FILTER (WHERE fraud_flag = 0) OVER (PARTITION BY risk) AS below,
               count(*) FILTER (WHERE fraud_flag = 0) OVER (PARTITION BY risk) AS same
        FROM {source})"""
_RATIOS = """coalesce(round(true_positives * 1e0 / nullif(true_positives + false_positives, 0), 4), 0) AS precision,
  coalesce(round(true_positives * 1e0 / nullif(true_positives + false_negatives, 0), 4), 0) AS recall,
  coalesce(round(2e0 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 4), 0) AS f1"""


@on_transactions("fm06_confusion_matrix", CONFUSION_SQL.format(source="transactions"))
def fm06_confusion_matrix(t: DataFrame) -> DataFrame:
    return ME.confusion_matrix(rule_scored(t))


@on_transactions(
    "fm07_precision_recall_f1",
    f"SELECT *, {_RATIOS} FROM ({CONFUSION_SQL.format(source='transactions')})",
)
def fm07_precision_recall_f1(t: DataFrame) -> DataFrame:
    return ME.precision_recall_f1(ME.confusion_matrix(rule_scored(t)))


@on_transactions(
    "fm07_class_report",
    f"""SELECT 'Fraud' AS class, precision, recall, f1, true_positives + false_negatives AS support
        FROM (SELECT *, {_RATIOS} FROM ({CONFUSION_SQL.format(source='transactions')}))
        UNION ALL SELECT 'Legitimate',
          round(true_negatives * 1e0 / (true_negatives + false_negatives), 4),
          round(true_negatives * 1e0 / (true_negatives + false_positives), 4),
          round(2e0 * true_negatives / (2 * true_negatives + false_positives + false_negatives), 4),
          true_negatives + false_positives FROM ({CONFUSION_SQL.format(source='transactions')})""",
)
def fm07_class_report(t: DataFrame) -> DataFrame:
    return ME.class_report(ME.confusion_matrix(rule_scored(t)))


@on_transactions("fm08_auc_roc", AUC_SQL.format(source="transactions"))
def fm08_auc_roc(t: DataFrame) -> DataFrame:
    return ME.auc_roc(rule_scored(t))


REPORT_SQL = """SELECT c.*, {ratios}, n.test_size, n.fraud_rate_test, a.auc_roc
  FROM ({confusion}) c, ({auc}) a,
       (SELECT count(*) AS test_size, round(avg(fraud_flag) * 100e0, 2) AS fraud_rate_test FROM {source}) n"""


def _report_sql(source: str) -> str:
    return REPORT_SQL.format(
        ratios=_RATIOS, confusion=CONFUSION_SQL.format(source=source), auc=AUC_SQL.format(source=source), source=source
    )


@on_transactions("fm09_eval_report", _report_sql("transactions"))
def fm09_eval_report(t: DataFrame) -> DataFrame:
    return ME.eval_report(rule_scored(t))


@on_transactions(
    "fm14_fraud_rate",
    """SELECT count(*) AS total, round(avg(fraud_flag) * 100e0, 2) AS fraud_rate,
              count(*) FILTER (WHERE fraud_flag = 0) AS negatives, CAST(sum(fraud_flag) AS BIGINT) AS positives
       FROM transactions""",
)
def fm14_fraud_rate(t: DataFrame) -> DataFrame:
    return t.agg(
        F.count("*").alias("total"),
        F.round(F.avg("fraud_flag") * 100.0, 2).alias("fraud_rate"),
        F.count_if(F.col("fraud_flag") == 0).alias("negatives"),
        F.sum("fraud_flag").alias("positives"),
    )


@on_transactions(
    "fm15_train_rule_eval",
    f"WITH {SPLIT_SQL}, held AS (SELECT * FROM split WHERE is_test) {_report_sql('held')}",
)
def fm15_train_rule_eval(t: DataFrame) -> DataFrame:
    """The evaluation of the rule on the held-out rows."""
    split = stratified_split(t, "fraud_flag", "transaction_id")
    return ME.eval_report(rule_scored(split.filter("is_test")))


# The model of each state of a data folder, trained once per session on its training rows.
_MODELS: dict[tuple[str, str], str] = {}
TREES = 200


def trained_model(spark: SparkSession, sf_dir: str) -> M.FraudModel:
    """The model of the folder's transactions, saved to the shared folder and loaded from there."""
    fact = transactions(spark, sf_dir)
    at = (spark.sparkContext.applicationId, fingerprint_of_files(spark, fact.inputFiles()))
    if at not in _MODELS:
        t = M.select_features(fact, "transaction_id")
        train = stratified_split(t, S.TARGET_COLUMN, "transaction_id").filter("NOT is_test")
        path = scratch_path(spark, "model")
        M.train_fraud(train, trees=TREES).save(path)
        _MODELS[at] = path
    return M.FraudModel.load(spark, _MODELS[at])


@register("fm05_train_fraud")
def fm05_train_fraud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation of the trained model on the held-out rows."""
    model = trained_model(spark, sf_dir)
    t = M.select_features(transactions(spark, sf_dir), "transaction_id")
    held = stratified_split(t, S.TARGET_COLUMN, "transaction_id").filter("is_test")
    return ME.eval_report(M.score(model, held), label=S.TARGET_COLUMN)


@register("fm10_score")
def fm10_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = M.score(trained_model(spark, sf_dir), transactions(spark, sf_dir))
    return scored.select("transaction_id", "fraud_probability", "prediction", "risk_level")


def scored_with_features(spark: SparkSession, sf_dir: str) -> tuple[M.FraudModel, DataFrame]:
    model = trained_model(spark, sf_dir)
    t = transactions(spark, sf_dir).select("transaction_id", *S.FEATURE_COLUMNS)
    scored = M.score(model, t, keep_features=True)
    return model, scored.select("transaction_id", "score", "fraud_probability", "features")


@register("fm11_attributions")
def fm11_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, scored = scored_with_features(spark, sf_dir)
    return A.attributions(A.with_attributions(model, scored), "transaction_id")


@register("fm12_global_importance")
def fm12_global_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a sample of the held-out rows; only the sample is scored."""
    model = trained_model(spark, sf_dir)
    t = transactions(spark, sf_dir).select("transaction_id", S.TARGET_COLUMN, *S.FEATURE_COLUMNS)
    held = stratified_split(t, S.TARGET_COLUMN, "transaction_id").filter("is_test").drop("is_test", S.TARGET_COLUMN)
    scored = M.score(model, hash_sample(held, 1000, "transaction_id"), keep_features=True)
    return A.global_importance(model, scored.select("transaction_id", "score", "fraud_probability", "features"), "transaction_id")


@register("fm13_importance_bars")
def fm13_importance_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, scored = scored_with_features(spark, sf_dir)
    return A.importance_bars(A.with_attributions(model, scored), "transaction_id")
