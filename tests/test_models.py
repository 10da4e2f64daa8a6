"""Metrics, trees, attributions, forecasts and retrieval."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywing import schema as S
from tallywing.operators import attribution as A
from tallywing.operators import forecast as P
from tallywing.operators import fraud_model as M
from tallywing.operators import metrics as ME
from tallywing.operators import retrieval as V
from tallywing.plans.forecasts import order_series
from tallywing.plans.models import scored_with_features, trained_model
from tallywing.sources.fixture import transactions


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def test_auc_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(int(rng.random() < 0.2), round(rng.random(), rng.choice([1, 2, 9]))) for _ in range(500)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert ME.auc_roc(scored(spark, rows)).first()[0] == round(wins / len(pos) / len(neg), 4)


def test_auc_of_equal_scores_is_half(spark):
    assert ME.auc_roc(scored(spark, [(0, 0.3), (1, 0.3), (0, 0.3)])).first()[0] == 0.5


def test_metrics_without_positives_are_zero(spark):
    report = ME.eval_report(scored(spark, [(0, 0.1), (0, 0.9)])).first()
    assert (report.precision, report.recall, report.f1, report.auc_roc) == (0.0, 0.0, 0.0, None)
    assert (report.true_negatives, report.false_positives, report.test_size) == (1, 1, 2)


def test_confusion_cells_add_up(spark, small):
    held = M.score(trained_model(spark, small), transactions(spark, small))
    cells = ME.confusion_matrix(held, "fraud_flag").first()
    assert sum(cells) == held.count()


def brute_shapley(nodes, x, features):
    """Shapley values of one tree by enumeration of all coalitions."""
    rows = {n.id: n for n in nodes.itertuples()}

    def value(known, node=0):
        n = rows[node]
        if n.left < 0:
            return n.prediction
        if n.feature in known:
            return value(known, n.left if x[n.feature] <= n.threshold else n.right)
        return sum(rows[c].weight / n.weight * value(known, c) for c in (n.left, n.right))

    out = np.zeros(features)
    for i in range(features):
        rest = [j for j in range(features) if j != i]
        for size in range(features):
            w = math.factorial(size) * math.factorial(features - size - 1) / math.factorial(features)
            for known in itertools.combinations(rest, size):
                out[i] += w * (value({*known, i}) - value(set(known)))
    return out


def test_contributions_against_brute_force():
    # Feature 0 occurs twice on a path; feature 2 nowhere.
    nodes = pd.DataFrame(
        [(0, 0, 0.0, 10.0, 1, 4, 0, 5.0), (0, 1, 0.0, 6.0, 2, 3, 1, 2.0), (0, 2, 1.0, 2.0, -1, -1, -1, None),
         (0, 3, 2.0, 4.0, -1, -1, -1, None), (0, 4, 0.0, 4.0, 5, 6, 0, 8.0), (0, 5, -3.0, 1.0, -1, -1, -1, None),
         (0, 6, 4.0, 3.0, -1, -1, -1, None)],
        columns=["tree", "id", "prediction", "weight", "left", "right", "feature", "threshold"],
    )
    tables, base = A.leaf_tables(nodes, [0.5], 3)
    for x in ([1, 1, 0], [5, 3, 9], [6, 0, 0], [9, 9, 9]):
        got = A.contributions(np.array([x], dtype=float), tables)[0]
        assert np.allclose(got, brute_shapley(nodes, x, 3))  # 2 x 0.5 = 1
    assert base == pytest.approx((2 * 1 + 4 * 2 - 1 * 3 + 3 * 4) / 10)


@pytest.mark.parametrize("rows", [1, 24, 512])
def test_shared_tables_against_brute_force(monkeypatch, rows):
    """Random trees whose splits use the same features again, with tables of one leaf, of a few, and across trees."""
    monkeypatch.setattr(A, "TABLE_ROWS", rows)
    monkeypatch.setattr(A, "BLOCK_ROWS", 7)
    rng = random.Random(rows)
    nodes = []

    def grow(tree, depth, weight):
        at = len([n for n in nodes if n[0] == tree])
        here = [tree, at, rng.uniform(-1, 1), weight, -1, -1, -1, None]
        nodes.append(here)
        if depth and weight > 2:
            part = rng.uniform(0.2, 0.8) * weight
            here[6], here[7] = rng.randrange(4), float(rng.randrange(6))
            here[4] = grow(tree, depth - 1, part)
            here[5] = grow(tree, depth - 1, weight - part)
        return at

    for tree in range(5):
        grow(tree, tree, 100.0)  # the first tree is a leaf
    frame = pd.DataFrame(nodes, columns=["tree", "id", "prediction", "weight", "left", "right", "feature", "threshold"])
    weights = [rng.uniform(0.1, 1) for _ in range(5)]
    tables, base = A.leaf_tables(frame, weights, 5)
    leaves = int((frame.left < 0).sum()) - 1
    assert len(tables.tables) == leaves if rows == 1 else len(tables.tables) < leaves
    x = np.array([[rng.randrange(-1, 8) for _ in range(5)] for _ in range(30)], dtype=float)
    want = [sum(2 * w * brute_shapley(frame[frame.tree == i], r, 5) for i, w in enumerate(weights)) for r in x]
    assert np.allclose(A.contributions(x, tables), want)
    assert A.contributions(x[:0], tables).shape == (0, 5)


@pytest.mark.parametrize("codes", [1, 8, 2048])
def test_ranks_of_several_features_share_a_code(monkeypatch, codes):
    """A row needs a look-up per code, not one per feature; a table too long for short numbers has the same sums."""
    monkeypatch.setattr(A, "CODES", codes)
    nodes, depth = [], 12
    for i in range(depth):  # a chain that asks every feature once
        nodes += [(0, 2 * i, 0.0, 4096.0 / 2**i, 2 * i + 1, 2 * i + 2, i, 0.5), (0, 2 * i + 1, float(i), 2048.0 / 2**i, -1, -1, -1, None)]
    nodes.append((0, 2 * depth, -7.0, 1.0, -1, -1, -1, None))
    frame = pd.DataFrame(nodes, columns=["tree", "id", "prediction", "weight", "left", "right", "feature", "threshold"])
    x = np.array([[0] * 12, [1] * 12, [1, 0] * 6, [np.nan] * 12], dtype=float)
    found = []
    for rows in (512, 1 << 16):
        monkeypatch.setattr(A, "TABLE_ROWS", rows)
        tables, base = A.leaf_tables(frame, [0.5], 12)
        widest = max(len(t.codes) for t in tables.tables)
        assert widest == {1: 12, 8: 4, 2048: 2}[codes] and all(len(w) <= max(codes, 2) for t in tables.tables for _, w in t.codes)
        found.append(A.contributions(x, tables))
        assert np.allclose(base + found[-1].sum(axis=1), [0, -7, 1, -7])
    assert np.allclose(*found)


def test_contributions_are_ranked_by_magnitude_then_name(spark, small):
    model, rows = scored_with_features(spark, small)
    for r in A.with_attributions(model, rows).limit(200).collect():
        named = zip(S.FEATURE_COLUMNS, r.exact_contributions)
        rounded = {c.feature: c.value for c in r.contributions}
        assert all(abs(rounded[f] - v) <= 0.5001e-4 for f, v in named) and len(rounded) == len(S.FEATURE_COLUMNS)
        assert [c.feature for c in r.contributions] == sorted(rounded, key=lambda f: (-abs(rounded[f]), f))


def test_training_computes_its_rows_once(spark, small):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = M.select_features(transactions(spark, small)).limit(300).coalesce(1)
    rows = spark.createDataFrame(rows.collect(), rows.schema).mapInArrow(look, rows.schema)
    assert M.train_fraud(rows, trees=1, depth=2).trees.getNumTrees == 1
    assert seen.value == 300


def test_contributions_add_up_to_log_odds(spark, small):
    model, rows = scored_with_features(spark, small)
    out = A.with_attributions(model, rows)
    total = F.aggregate("exact_contributions", F.col("base_value"), lambda a, v: a + v)
    odds = F.log(F.col("score") / (1 - F.col("score")))
    assert out.select(F.max(F.abs(total - odds))).first()[0] < 1e-6
    long = A.attributions(out, "transaction_id")
    assert long.count() == rows.count() * len(S.FEATURE_COLUMNS)
    sizes = [abs(r.value) for r in long.filter("transaction_id = 'TXN0000000001'").orderBy("rank").collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_bars(spark, small):
    model, rows = scored_with_features(spark, small)
    bars = A.importance_bars(A.with_attributions(model, rows), "transaction_id")
    worst = bars.groupBy("transaction_id").agg(F.count("*").alias("n"), F.max("width").alias("w"))
    assert worst.filter("n <> 8 OR abs(w - 100) > 1e-9").isEmpty()


def test_model_round_trip(spark, small, tmp_path):
    model = trained_model(spark, small)
    model.save(str(tmp_path / "m"))
    t = transactions(spark, small)
    a, b = (M.score(m, t).select("transaction_id", "score") for m in (model, M.FraudModel.load(spark, str(tmp_path / "m"))))
    assert a.exceptAll(b).isEmpty()


def test_scoring_an_unseen_category(spark, small):
    t = transactions(spark, small).limit(5).withColumn("amount_tier", F.lit("Medium (₹500-5000)"))
    encoded = trained_model(spark, small).encode(t)
    assert {r[0] for r in encoded.select("amount_tier_code").collect()} == {0}


def test_what_if_of_one_changes_nothing(spark, small):
    forecast = P.baseline_forecast(order_series(spark, small), "txn_count")
    assert P.what_if(forecast, 1.0).exceptAll(forecast).isEmpty()


@pytest.mark.parametrize("asked,given", [(3, 7), (7, 7), (30, 30), (90, 90), (365, 90)])
def test_horizon_is_clamped(spark, small, asked, given):
    assert P.clamp_horizon(asked) == given
    assert P.future_frame(order_series(spark, small), asked).count() == given


def test_missing_day_counts_zero(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', DATE '2024-01-01', 5), ('a', DATE '2024-01-03', 7), ('b', DATE '2024-02-01', 1) t(k, ds, y)")
    got = {(r.k, str(r.ds)): r.y for r in P.fill_calendar(df, ["y"], ["k"]).collect()}
    assert got == {("a", "2024-01-01"): 5, ("a", "2024-01-02"): 0, ("a", "2024-01-03"): 7, ("b", "2024-02-01"): 1}


def seasonal(spark, days=900):
    d = F.col("id").cast("double")
    y = (100 + d * 0.1) * (1 + 0.3 * F.sin(2 * math.pi * d / 7)) * (1 + 0.2 * F.cos(2 * math.pi * d / 365.25))
    return spark.range(days).select(F.expr("date_add(DATE '2020-01-01', CAST(id AS INT))").alias("ds"), y.alias("y"))


def test_forecast_beats_baseline_on_held_out_days(spark):
    series = seasonal(spark)
    train, held = series.filter("ds < DATE '2022-05-20'"), series.filter("ds >= DATE '2022-05-20'")
    errors = []
    for forecast in (
        P.fit_forecast(train, "y").predict(P.future_frame(train, 30)),
        P.forecast_each(train.withColumn("k", F.lit("x")), ["k"], "y", 30).drop("k"),
        P.baseline_forecast(train, "y", 30),
    ):
        joined = held.join(forecast, "ds")
        assert joined.count() == 30
        errors.append(joined.agg(F.avg(F.abs(F.col("yhat") - F.col("y")) / F.col("y"))).first()[0])
    assert errors[0] < 0.05 and errors[1] < 0.05 and errors[0] < errors[2]


def test_coordinate_descent_against_a_dense_solver():
    """Proximal gradient steps with all coefficients at once come to the same point."""
    rng = np.random.default_rng(11)
    x, ridge, lasso = rng.normal(size=(80, 9)), rng.uniform(0, 2, 9), rng.uniform(0, 25, 9)
    y = x @ np.array([3, 0, 0, -2, 0, 1, 0, 0, 0.2]) + rng.normal(size=80)
    gram, target = x.T @ x, x.T @ y
    found = P.coordinate_descent(gram, target, np.zeros(9), ridge, lasso, 500)
    a, step = np.zeros(9), 1 / (np.linalg.eigvalsh(gram).max() + ridge.max())
    for _ in range(20_000):
        b = a - step * (gram @ a - target + ridge * a)
        a = np.sign(b) * np.maximum(np.abs(b) - step * lasso, 0)
    assert np.abs(found - a).max() < 1e-8 and (found == 0).any()


def noisy(rng, days, growth=0.0):
    """A bent trend times seasons, with noise on each day; `growth` lets the level wander."""
    d = np.arange(days, dtype=float)
    level = 100 + 0.1 * d + np.maximum(0, d - days * 0.4) * 0.15
    level = level * np.exp(np.cumsum(rng.normal(size=days) * growth))
    season = (1 + 0.25 * np.sin(2 * np.pi * d / 7) + 0.15 * np.cos(2 * np.pi * d / 365.25))
    return d + 18_000, level * season * (1 + 0.08 * rng.normal(size=days))


def test_solver_is_closer_than_a_regression_of_logarithms():
    """On held-out days, beside the ridge regression of log(1 + y) on the same columns."""
    rng, better = np.random.default_rng(12), []
    for _ in range(6):
        day, y = noisy(rng, 1100)
        day, y, later, want = day[:1040], y[:1040], day[1040:], y[1040:]
        trend, season = P.solve(day, y / y.max(), day[0], day[-1] - day[0], True)
        ours = y.max() * (P._trend_design(later, day[0], day[-1] - day[0]) @ trend) * (1 + P._season_design(later) @ season)
        design = lambda d: np.hstack([P._trend_design(d, day[0], day[-1] - day[0]) * np.r_[1, 5, np.full(25, 0.05)], P._season_design(d) * 10])
        x = design(day)
        beta = np.linalg.solve(x.T @ x + 0.01 * np.eye(x.shape[1]), x.T @ np.log1p(y))
        better.append((np.abs(ours - want).mean(), np.abs(np.expm1(design(later) @ beta) - want).mean()))
    ours, logs = np.mean(better, axis=0)
    assert ours < logs


def test_band_covers_four_in_five_and_widens():
    """At every horizon, over many series whose level wanders."""
    rng, inside, widths = np.random.default_rng(13), [], []
    for _ in range(40):
        day, y = noisy(rng, 1260, 0.006)
        model = P.fit_series(day[:1200], y[:1200], True)
        later, want = day[1200:], y[1200:]
        fit = model["scale"] * (P._trend_design(later, model["first_day"], model["length"]) @ np.array(model["trend"]))
        fit = fit * (1 + P._season_design(later) @ np.array(model["season"]))
        h, (a, b, c, d) = np.arange(1, 61), model["band"]
        inside.append((want >= fit - np.abs(fit) * np.sqrt(a + b * h)) & (want <= fit + np.abs(fit) * np.sqrt(c + d * h)))
        widths.append(np.sqrt(a + b * h) + np.sqrt(c + d * h))
    covered = np.mean(inside, axis=0).reshape(3, 20).mean(axis=1)
    assert (np.abs(covered - 0.8) <= 0.05).all()
    assert np.mean(widths, axis=0)[-1] > 1.2 * np.mean(widths, axis=0)[0]


def test_one_series_and_many_agree(spark):
    """Also with a NULL key, a constant series and a short one."""
    series = seasonal(spark, 400)
    rows = series.withColumn("k", F.lit("x")).union(series.limit(10).withColumn("k", F.lit(None).cast("string")))
    rows = rows.union(series.limit(90).select("ds", F.lit(3.0), F.lit("c")))
    each = {(r.k, str(r.ds)): r.yhat for r in P.forecast_each(rows, ["k"], "y", 10).collect()}
    assert len(each) == 30
    for k, part in (("x", rows.filter("k = 'x'")), (None, rows.filter("k is null")), ("c", rows.filter("k = 'c'"))):
        alone = P.fit_forecast(part, "y").predict(P.future_frame(part, 10)).collect()
        assert all(abs(each[k, str(r.ds)] - r.yhat) < 1e-9 and r.yhat_lower <= r.yhat <= r.yhat_upper for r in alone)
    assert all(abs(v - 3) < 0.05 for (k, _), v in each.items() if k == "c")


def test_forecast_band_holds_the_forecast(spark, small):
    forecast = P.forecast_response(order_series(spark, small), "amount", 14, 0.9)
    assert forecast.count() == 14
    assert forecast.filter("yhat_lower > yhat OR yhat > yhat_upper").isEmpty()


def test_unknown_metric_is_refused(spark, small):
    with pytest.raises(ValueError):
        P.forecast_response(order_series(spark, small), "volume")


def test_named_queries_train_as_many_trees_as_the_reference(spark, small):
    assert trained_model(spark, small).trees.getNumTrees == 200


def test_nearest_in_blocks_against_brute_force(spark):
    rng = np.random.default_rng(6)
    corpus, queries = rng.normal(size=(300, 8)), rng.normal(size=(23, 8))
    corpus[10] = corpus[11]
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(m)], "id long, v array<float>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(queries.astype("float32").astype(float)) @ unit(corpus.astype("float32").astype(float)).T
    want = {(q, int(c)) for q in range(23) for c in sorted(range(300), key=lambda c: (-sims[q, c], c))[:4]}
    for block in (100,):
        found = V.nearest_examples(frame(queries), frame(corpus).repartition(5), 4, block)
        assert {(r.query_id, r.example_id) for r in found.collect()} == want


def test_text_vectors_find_the_same_text(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["total amount by bank", "fraud rate by hour", "failed payments on wifi"])], "id int, text string")
    best = V.similar_texts(docs.withColumn("id", F.col("id") + 10), V.word_index(docs), 1)
    assert {(r.query_id, r.example_id) for r in best.collect()} == {(10, 0), (11, 1), (12, 2)}
