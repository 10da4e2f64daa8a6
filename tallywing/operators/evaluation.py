"""Comparing result sets and scoring a benchmark of queries."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywing.session import remove, scratch_path

PASS, FAIL, SQL_ERROR, ERROR = "PASS", "FAIL", "SQL_ERROR", "ERROR"


def _comparable(gold: DataFrame, other: DataFrame) -> tuple[list[Column], list[Column]]:
    """Both column lists in types that can be stacked without changing what is equal."""
    left, right = [], []
    for i, (f, g) in enumerate(zip(gold.schema.fields, other.schema.fields)):
        a, b = F.col(f"c{i}"), F.col(f"c{i}")
        numbers = [isinstance(x.dataType, (T.NumericType, T.BooleanType)) for x in (f, g)]
        if numbers[0] != numbers[1]:
            # A number never equals a text; only NULL can match here.
            a, b = [
                F.when(c.isNotNull(), F.concat(F.lit("number " if n else "text "), c.cast("string")))
                for c, n in zip((a, b), numbers)
            ]
        elif f.dataType != g.dataType:
            target = "string" if not numbers[0] else None
            if T.BooleanType() in (f.dataType, g.dataType):
                a, b = [c.cast("int") if x.dataType == T.BooleanType() else c for c, x in ((a, f), (b, g))]
            elif target:
                a, b = a.cast(target), b.cast(target)
        left.append(a.alias(f"c{i}"))
        right.append(b.alias(f"c{i}"))
    return left, right


def match_summary(gold: DataFrame, other: DataFrame) -> DataFrame:
    """One row: sizes of both results and whether they hold the same rows.

    Columns are matched by position, rows in any order, duplicates count, NULL
    equals NULL. Both sides are stacked and the copies of each distinct row counted
    per side, in one shuffle.
    """
    copies_of = [F.count_if(F.col("__side") == s).alias(n) for s, n in ((1, "a"), (2, "b"))]
    same_width = len(gold.columns) == len(other.columns)
    names = [f"c{i}" for i in range(len(gold.columns))] if same_width else []
    if same_width:
        left, right = _comparable(gold, other)
        gold, other = gold.toDF(*names).select(*left), other.toDF(*names).select(*right)
    else:
        gold, other = gold.select(), other.select()
    both = gold.withColumn("__side", F.lit(1)).unionAll(other.withColumn("__side", F.lit(2)))
    equal = F.count_if(F.col("a") != F.col("b")) == 0
    if not same_width:
        equal = F.coalesce(F.sum(F.col("a") + F.col("b")), F.lit(0)) == 0
    return both.groupBy(*names).agg(*copies_of).agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("gold_rows"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("gen_rows"),
        equal.alias("matched"),
    )


def results_match(gold: DataFrame | None, other: DataFrame | None) -> bool:
    """Whether two results are equal; an absent result equals nothing."""
    if gold is None or other is None:
        return False
    return match_summary(gold, other).first()["matched"]


def classify_outcome(generated: Column, ran: Column, matched: Column) -> Column:
    """No query at all beats a query that fails, which beats a wrong result."""
    return F.when(~generated, ERROR).when(~ran, SQL_ERROR).when(matched, PASS).otherwise(FAIL)


@dataclass(frozen=True)
class Case:
    """A benchmark case; `candidate` is None when no query could be produced."""

    id: str
    category: str
    gold: Callable[[], DataFrame]
    candidate: Callable[[], DataFrame] | None


def _texts(gold: DataFrame, other: DataFrame | None) -> list[DataFrame]:
    """Both results as one column `row`, an array of texts that are equal just where the values are."""
    sides = [gold] if other is None else [gold, other]
    alone = len(sides) == 1 or len(gold.columns) != len(other.columns)
    if alone:
        columns = [[F.col(f"c{i}").cast("string") for i in range(len(df.columns))] for df in sides]
    else:
        columns = [list(c) for c in _comparable(gold, other)]
        for i, types in enumerate(zip(*[[f.dataType for f in df.schema.fields] for df in sides])):
            if all(isinstance(t, (T.NumericType, T.BooleanType)) for t in types):
                # Whole numbers and equal decimals keep all digits; else numbers meet as doubles, 0 without a sign.
                whole = all(isinstance(t, (T.IntegralType, T.BooleanType)) for t in types)
                exact = whole or types[0] == types[1] and isinstance(types[0], T.DecimalType)
                for c in columns:
                    c[i] = c[i].cast("long") if whole else c[i] if exact else c[i].cast("double") + F.lit(0.0)
        columns = [[c.cast("string") for c in cs] for cs in columns]
    return [
        df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(F.array(*cs).cast("array<string>").alias("row"))
        for df, cs in zip(sides, columns)
    ]


def _attempt(case: Case) -> tuple[str | None, DataFrame | None]:
    """What becomes of a candidate before it is run."""
    if case.candidate is None:
        return ERROR, None
    try:
        df = case.candidate()
        df.schema  # the analyzer sees it here at the latest
        return None, df
    except PySparkException:
        return SQL_ERROR, None


def _run_queries(case: Case, folder: str) -> str | None:
    """Run both queries of a case once, each into a table of its own below `folder`; a status if there is no result to compare.

    A gold query that fails is an error of the benchmark and is raised.
    """
    status, other = _attempt(case)
    texts = _texts(case.gold(), other)
    texts[0].write.parquet(f"{folder}/side=gold")
    if other is not None:
        try:
            texts[1].write.parquet(f"{folder}/side=candidate")
        except (PySparkException, Py4JError):  # it failed while running
            status = SQL_ERROR
    return status


def digests(results: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, a, b): the number of rows of each result and two sums of their hashes, whatever their order.

    `results` has a column `row`. Equal results have equal digests; sums are combined per task before the shuffle.
    """
    sums = [F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(38,0)")).alias(k) for seed, k in ((1, "a"), (2, "b"))]
    return results.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def _differing(results: DataFrame) -> DataFrame:
    """(case): those whose two results don't hold each row equally often."""
    copies = [F.count_if(F.col("side") == s).alias(s) for s in ("gold", "candidate")]
    return results.groupBy("case", "row").agg(*copies).where("gold != candidate").select("case").distinct()


def run_benchmark(spark: SparkSession, cases: list[Case], path: str, at_once: int = 8) -> DataFrame:
    """Outcome of every case: (id, category, status, gold_rows, gen_rows), written to `path`.

    The queries of each case run apart from the others, a few cases at a time; a candidate that fails, when it is analysed
    or while it runs, gets its status and the others go on. All results are then compared together: by digests, which
    settle a mismatch without a shuffle of rows, and, where these are equal, by counting every row of both sides.
    """
    folder = scratch_path(spark, "benchmark-results")
    with ThreadPoolExecutor(at_once) as pool:
        early = list(pool.map(lambda i: _run_queries(cases[i], f"{folder}/case={i}"), range(len(cases))))
    results = spark.read.schema("row array<string>, case int, side string").parquet(folder) if cases else None
    found = {(r["case"], r["side"]): (r["n"], r["a"], r["b"]) for r in digests(results, ["case", "side"]).collect()} if cases else {}
    none = (0, None, None)
    sides = [(found.get((i, "gold"), none), found.get((i, "candidate"), none)) for i in range(len(cases))]
    equal = [i for i, (gold, other) in enumerate(sides) if early[i] is None and gold == other]
    wrong = {r["case"] for r in _differing(results.where(F.col("case").isin(equal))).collect()} if equal else set()
    outcomes = [
        (case.id, case.category, early[i] or (PASS if i in set(equal) - wrong else FAIL), sides[i][0][0], 0 if early[i] else sides[i][1][0])
        for i, case in enumerate(cases)
    ]
    done = spark.createDataFrame(outcomes, "id string, category string, status string, gold_rows long, gen_rows long")
    done.coalesce(1).write.mode("overwrite").parquet(path)
    remove(spark, folder)
    return spark.read.schema(done.schema).parquet(path)


def run_case(spark: SparkSession, case: Case) -> str:
    """Outcome of one case."""
    path = scratch_path(spark, "benchmark-outcome")
    status = run_benchmark(spark, [case], path).first()["status"]
    remove(spark, path)
    return status


def scoreboard(results: DataFrame) -> DataFrame:
    """Passes, failures, errors and accuracy per category, and overall (category NULL)."""
    status = F.col("status")
    return (
        results.groupingSets([[], [F.col("category")]], F.col("category"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(status == PASS).alias("passed"),
            F.count_if(status.isin(FAIL, SQL_ERROR)).alias("failed"),
            F.count_if(status == ERROR).alias("errors"),
            F.round(F.try_divide(F.count_if(status == PASS) * F.lit(100.0), F.count("*")), 2).alias("accuracy_pct"),
        )
    )
