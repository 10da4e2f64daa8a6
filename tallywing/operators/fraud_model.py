"""Class-weighted boosted trees: encoding, training, scoring, saving."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.functions import features as X
from tallywing.operators.boosting import fit_boosted
from tallywing.operators.joins import dictionary_lookup
from tallywing.operators.sampling import class_weight, fit_label_encoder
from tallywing.session import ensure_checkpoint_dir, remove, scratch_path

INPUTS = [f"{c}_code" if c in S.CATEGORICAL_COLUMNS else c for c in S.FEATURE_COLUMNS]


def select_features(t: DataFrame, *keep: str) -> DataFrame:
    """The model's inputs and target, after any further columns to keep."""
    return t.select(*keep, *S.FEATURE_COLUMNS, S.TARGET_COLUMN)


@dataclass
class FraudModel:
    """Fitted trees with the label dictionary they were trained on."""

    pipeline: PipelineModel
    dictionary: DataFrame

    @property
    def trees(self) -> GBTClassificationModel:
        return self.pipeline.stages[-1]

    def encode(self, df: DataFrame) -> DataFrame:
        """Codes for every categorical input; a value not seen in training gets code 0."""
        return dictionary_lookup(df, self.dictionary, S.CATEGORICAL_COLUMNS)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FraudModel:
        return FraudModel(
            PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/dictionary")
        )


def train_fraud(
    rows: DataFrame,
    trees: int = 200,
    depth: int = 6,
    rate: float = 0.1,
    seed: int = 42,
    bins: int = 64,
) -> FraudModel:
    """Fit on rows with the feature and target columns; positives weigh negatives over positives.

    The rows, the dictionary and the encoded rows are written once to the shared folder:
    the dictionary so that its known size lets every encoding broadcast it, the others
    because they are read several times and must not depend on lost executors.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, "training")
    select_features(X.fill_unknown(rows, S.CATEGORICAL_COLUMNS)).write.parquet(f"{path}/plain")
    filled = spark.read.parquet(f"{path}/plain")
    fit_label_encoder(filled, S.CATEGORICAL_COLUMNS).write.parquet(f"{path}/dictionary")
    dictionary = spark.read.parquet(f"{path}/dictionary")
    dictionary_lookup(filled, dictionary, S.CATEGORICAL_COLUMNS).select(
        *INPUTS, F.col(S.TARGET_COLUMN).cast("double").alias("label")
    ).write.parquet(f"{path}/rows")
    encoded = spark.read.parquet(f"{path}/rows")
    remove(spark, f"{path}/plain")
    weight = class_weight(encoded, "label").first()["weight"]
    assembler = VectorAssembler(inputCols=INPUTS, outputCol="features")
    learner = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", lossType="logistic",
        maxIter=trees, maxDepth=depth, stepSize=rate, maxBins=bins, seed=seed,
    )
    fitted = fit_boosted(assembler.transform(encoded), learner, float(weight or 1.0))
    return FraudModel(PipelineModel([assembler, fitted]), dictionary)


def score(model: FraudModel, df: DataFrame, keep_features: bool = False) -> DataFrame:
    """Every row with its probability, prediction and risk level; also works on a stream."""
    scored = model.pipeline.transform(model.encode(df))
    p = vector_to_array("probability")[1]
    out = scored.withColumn("__p", p).withColumns({
        "fraud_probability": F.round("__p", 4),
        "prediction": X.verdict(F.col("__p")),
        "risk_level": X.risk_level(F.col("__p")),
        "score": F.col("__p"),
        "predicted": (F.col("__p") >= 0.5).cast("int"),
    })
    extra = [vector_to_array("features").alias("features")] if keep_features else []
    added = ["fraud_probability", "prediction", "risk_level", "score", "predicted"]
    return out.select(*df.columns, *added, *extra)


def feature_importances(model: FraudModel) -> list[tuple[str, float]]:
    """Split-gain importances of the fitted trees, largest first."""
    pairs = zip(S.FEATURE_COLUMNS, model.trees.featureImportances.toArray().tolist())
    return sorted(pairs, key=lambda p: -p[1])
