"""Exact evaluation of scored rows: confusion counts, precision, recall, F1 and AUC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywing.operators.aggregates import running_totals

# Score bins of the AUC: 2^-12 wide, then 2^-24 wide.
SCORE_BINS = [1 / 4096, 1 / 16777216]


def _confusion(label: Column, predicted: Column) -> list[Column]:
    positive, said = label == 1, predicted == 1
    return [
        F.count_if(~positive & ~said).alias("true_negatives"),
        F.count_if(~positive & said).alias("false_positives"),
        F.count_if(positive & ~said).alias("false_negatives"),
        F.count_if(positive & said).alias("true_positives"),
    ]


def confusion_matrix(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return scored.agg(*_confusion(F.col(label), F.col(predicted)))


def _ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is 0 where its denominator is."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def precision_recall_f1(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the positive class from the confusion counts, four decimals."""
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return matrix.withColumns({
        "precision": F.round(_ratio(tp, tp + fp), 4),
        "recall": F.round(_ratio(tp, tp + fn), 4),
        "f1": F.round(_ratio(2 * tp, 2 * tp + fp + fn), 4),
    })


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of both classes, one row each."""
    tn, fp, fn, tp = (
        F.col(c) for c in ("true_negatives", "false_positives", "false_negatives", "true_positives")
    )
    rows = [("Legitimate", tn, fn, fp), ("Fraud", tp, fp, fn)]
    structs = [
        F.struct(
            F.lit(name).alias("class"),
            F.round(_ratio(hit, hit + wrong), 4).alias("precision"),
            F.round(_ratio(hit, hit + missed), 4).alias("recall"),
            F.round(_ratio(2 * hit, 2 * hit + wrong + missed), 4).alias("f1"),
            (hit + missed).alias("support"),
        )
        for name, hit, wrong, missed in rows
    ]
    return matrix.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def score_counts(scored: DataFrame, label: str, score: str, *more: str) -> DataFrame:
    """Rows per distinct score and label.

    Every figure is computed from this frame. All of them need all of its columns,
    so the plan reads the scored rows once and reuses the shuffle.
    """
    return scored.groupBy(F.col(score).alias("score"), F.col(label).alias("label"), *more).agg(F.count("*").alias("n"))


def _auc(counts: DataFrame) -> DataFrame:
    def of(label: int) -> Column:
        return F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))

    hist = counts.groupBy("score").agg(of(0).alias("neg"), of(1).alias("pos"))
    ranked = running_totals(hist, "score", "neg", SCORE_BINS)
    pairs = F.col("pos") * (F.col("before") + F.col("neg") / F.lit(2.0))
    return ranked.agg(
        F.round(F.try_divide(F.sum(pairs), F.sum("neg").cast("double") * F.sum("pos")), 4).alias("auc_roc")
    )


def auc_roc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the ROC curve for scores in 0..1; equal scores count half.

    One row per distinct score is ranked, in bins, so no task sorts them all.
    """
    return _auc(score_counts(scored, label, score))


def eval_report(
    scored: DataFrame, label: str = "label", predicted: str = "predicted", score: str = "score"
) -> DataFrame:
    """One row: AUC, precision, recall, F1, the confusion counts, test size and fraud rate."""
    counts = score_counts(scored, label, score, predicted)
    said, positive, n = F.col(predicted) == 1, F.col("label") == 1, F.col("n")
    total = {
        "true_negatives": F.when(~positive & ~said, n),
        "false_positives": F.when(~positive & said, n),
        "false_negatives": F.when(positive & ~said, n),
        "true_positives": F.when(positive & said, n),
        "test_size": n,
        "positives": F.when(positive, n),
    }
    sums = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in total.items()])
    rate = F.round(F.try_divide(F.col("positives").cast("double"), F.col("test_size")) * F.lit(100.0), 2)
    return (
        precision_recall_f1(sums)
        .withColumn("fraud_rate_test", rate)
        .withColumn("auc_roc", _auc(counts).scalar())
        .drop("positives")
    )
