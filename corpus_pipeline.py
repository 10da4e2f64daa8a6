"""A corpus pipeline of five operators; each stage's result is written as Parquet and read again as the next one's input.

quality    rows that the classifier rejects go
lines      repeated passages of lines go from the texts; a row of whose words nothing is left goes
near       one document of each group of near-duplicates stays
benchmark  rows with a benchmark passage go
pack       the rest as pieces of sequences of 1024 ids

All stages but the last return the columns of `documents`, n_chars being counted anew where a text has changed.

Defined cases, each by the operator of the stage: a NULL or empty text is a document without words, which the classifier scores and
no other stage removes; rows with a NULL id keep their lines, link with nothing and are packed; of rows that agree in id and text
one stays; columns other than those of `documents` are left out; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywing.llm import decontaminate, jaccard, lines, packing, quality
from tallywing.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score of 0.7 or more; learnt from the labels that are not held out."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated passages left out; but a row that had words and has none any more goes."""
    out = lines.dedup_lines(docs)
    emptied = (F.col("removed_chunks") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\s]")
    changed = F.when(F.col("removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~emptied).withColumn("n_chars", changed).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of near-duplicates."""
    return jaccard.one_of_each(docs).select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no benchmark item contaminates."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, each with its sequence and place."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", good),
    ("lines", without_repeats),
    ("near", one_of_each),
    ("benchmark", without_benchmark),
    ("pack", packed),
]

#: Trees, components and tokenizers have no SQL. tests/llm holds each stage against its operator on the stage's own input; the
#: operators have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that STAGES make of `documents`."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
