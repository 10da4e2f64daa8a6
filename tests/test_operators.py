"""Aggregates, rankings, joins, quality, evaluation and conversations on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tallywing.operators import aggregates as A
from tallywing.operators import conversations as C
from tallywing.operators import evaluation as E
from tallywing.operators import quality as Q
from tallywing.operators import shaping as R
from tallywing.operators.joins import carry_forward, cascade_delete, dictionary_lookup
from tallywing.operators.ranking import first_per_group
from tallywing.operators.sampling import class_weight, fit_label_encoder, stratified_split


def ints(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v int")


@pytest.mark.parametrize("values,expected", [([1, 2, 3, 4], 3), ([1, 2, 3], 2), ([7], 7), ([5, 5, 1, 1], 5)])
def test_upper_median(spark, values, expected):
    assert A.upper_median(ints(spark, values), "v").first()[0] == expected


def test_upper_median_over_many_bins(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.randrange(2_000_000_000), 77]) for _ in range(3001)]
    assert A.upper_median(ints(spark, values), "v").first()[0] == sorted(values)[len(values) // 2]


def test_running_totals(spark):
    rng = random.Random(2)
    hist = [(rng.random(), rng.randrange(5)) for _ in range(400)]
    df = spark.createDataFrame(hist, "s double, n int")
    got = {r.s: r.before for r in A.running_totals(df, "s", "n", [1 / 16, 1 / 256]).collect()}
    assert got == {s: sum(n for x, n in hist if x < s) for s, _ in hist}


def test_rates_of_nothing_are_null(spark, small):
    from tallywing.plans import benchmark, dashboard
    from tallywing.sources.fixture import transactions

    empty = transactions(spark, small).filter("false")
    assert benchmark.t13_fraud_rate(empty).first()[0] is None
    assert benchmark.t15_p2p_pct(empty).first()[0] is None
    assert benchmark.t29_p2p_p2m_ratio(empty).first()[0] is None
    assert tuple(dashboard.d01_overall_fraud(empty).first()) == (0, None, None)
    assert A.upper_median(empty, "amount_inr").count() == 0


def test_overall_rounds_half_even_groups_half_up(spark):
    # 1 in 800 is 0.125 %.
    t = spark.range(800).select((F.col("id") == 0).cast("int").alias("fraud_flag"), F.lit("SBI").alias("sender_bank"),
                                F.lit("Night").alias("day_part"), F.lit("4G").alias("network_type"))
    from tallywing.plans import dashboard as D

    assert D.d01_overall_fraud(t).first()["fraud_rate"] == 0.12
    assert D.d02_fraud_by_bank(t).first()["fraud_rate"] == 0.13
    board = {r["dimension"]: r["fraud_rate"] for r in D.d05_fraud_dashboard(t).collect()}
    assert board == {"overall": 0.12, "sender_bank": 0.13, "day_part": 0.13, "network_type": 0.13}


def test_overall_and_by_keeps_null_key(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), (None, "y")], "p string, q string")
    got = {(r.dimension, r.key): r.n for r in A.overall_and_by(df, ["p", "q"], {"n": F.count("*")}).collect()}
    assert got == {("overall", None): 3, ("p", "a"): 1, ("p", None): 2, ("q", "x"): 2, ("q", "y"): 1}


def test_carry_forward_across_stretches(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, None, None, f"{k}-{i}"])) for k in (1, 2) for i in range(300) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k int, i long, v string")
    got = {(r.k, r.i): r.prev for r in carry_forward(df, ["k"], "i", F.col("v"), "prev", span=4).collect()}
    want, last = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[:2]):
        want[k, i] = last.get(k)
        last[k] = v or last.get(k)
    assert got == want


def test_first_per_group_with_a_hot_group(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 100).alias("g"), "id")
    got = first_per_group(df, ["g"], 3, F.desc("id"))
    assert got.count() == 300
    assert {r.id for r in got.filter("g = 0").collect()} == {29_900, 29_800, 29_700}


def test_cascade_delete(spark):
    parents, children = spark.range(3).toDF("id"), spark.range(9).select((F.col("id") % 3).alias("pid"), "id")
    kept, rest = cascade_delete(parents, children, spark.range(1).toDF("id"), "id", "pid")
    assert sorted(r[0] for r in kept.collect()) == [1, 2]
    assert rest.count() == 6 and rest.filter("pid = 0").count() == 0


def test_unknown_category_gets_code_zero(spark):
    seen = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    codes = fit_label_encoder(seen, ["c"])
    assert {(r.value, r.code) for r in codes.collect()} == {("Unknown", 0), ("a", 1), ("b", 2)}
    new = spark.createDataFrame([("b",), ("Medium (₹500-5000)",), (None,)], "c string")
    assert [r.c_code for r in dictionary_lookup(new, codes, ["c"]).collect()] == [2, 0, 0]
    wide = dictionary_lookup(new, codes, ["c"], bound=1)
    assert sorted(r.c_code for r in wide.collect()) == [0, 0, 2]


@pytest.mark.parametrize("n,positives", [(1000, 43), (1001, 7), (10, 1), (17, 16)])
def test_split_keeps_class_ratio(spark, n, positives):
    df = spark.range(n).select("id", (F.col("id") < positives).cast("int").alias("y"))
    split = stratified_split(df, "y", "id")
    sizes = {(r.y, r.is_test): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    test = sum(v for (_, t), v in sizes.items() if t)
    assert sum(sizes.values()) == n and test == -(-n * 2 // 10)
    assert abs(sizes.get((1, True), 0) - positives * 0.2) < 1
    again = stratified_split(df.repartition(5), "y", "id")
    assert split.exceptAll(again).isEmpty()


def test_class_weight_without_positives(spark):
    df = spark.range(4).select(F.lit(0).alias("y"))
    assert tuple(class_weight(df, "y").first()) == (4, 0, None)


def test_quality_rules_find_violations(spark, small):
    from tallywing.sources.fixture import transactions

    t = transactions(spark, small)
    broken = t.limit(200).withColumns({
        "merchant_category": F.lit("Food"), "receiver_age_group": F.lit("18-25"),
        "hour_of_day": F.lit(24), "amount_inr": F.lit(-1), "device_type": F.lit("Fax"),
    })
    p2p = broken.filter("transaction_type = 'P2P'").count()
    found = {r.rule: r.violations for r in Q.count_violations(
        broken, {**Q.category_rules(), **Q.receiver_rules(), **Q.range_rules(), **Q.domain_rules()}).collect()}
    assert found["P2P has no category"] == p2p
    assert found["others have no receiver_age_group"] == 200 - p2p
    assert found["hour_of_day in 0..23"] == found["amount_inr not negative"] == found["device_type in domain"] == 200
    assert [tuple(r) for r in Q.domain_violations(broken).collect()] == [("device_type", "Fax", 200)]
    twice = Q.key_checks(t.unionAll(t).withColumn("transaction_id", F.substring("transaction_id", 1, 12)))
    assert {r.rule: r.violations > 0 for r in twice.collect()} == {
        "transaction_id unique": True, "transaction_id well formed": True}
    stored = Q.count_violations(t, Q.derivation_rules())
    assert stored.agg(F.sum("violations")).first()[0] == 0


def frame(spark, rows, schema="a string, n int"):
    return spark.createDataFrame(rows, schema)


def test_results_match(spark):
    base = frame(spark, [("x", 1), ("x", 1), ("y", None)])
    renamed = frame(spark, [("y", None), ("x", 1), ("x", 1)], "b string, m long")
    assert E.results_match(base, base) and E.results_match(base, renamed)
    assert not E.results_match(base, frame(spark, [("x", 1), ("y", None)]))
    assert not E.results_match(base, frame(spark, [("x", 1), ("y", None), ("y", None)]))
    assert E.results_match(base.filter("false"), renamed.filter("false"))
    assert E.results_match(base.filter("false"), renamed.select("b").filter("false"))
    assert not E.results_match(base, renamed.select("b"))
    assert not E.results_match(frame(spark, [(1, 2)], "a int, b int"), frame(spark, [(2, 1)], "a int, b int"))
    assert not E.results_match(frame(spark, [("1", 1)]), frame(spark, [(1, 1)], "a int, n int"))
    assert not E.results_match(None, base) and not E.results_match(base, None)
    assert E.results_match(frame(spark, [(1,)], "a int"), frame(spark, [(1.0,)], "a double"))


def test_run_case_catches_failures_while_running(spark):
    gold = lambda: frame(spark, [("x", 1)])
    bad = lambda: gold().select(F.col("a").cast("int"), "n")
    assert E.run_case(spark, E.Case("1", "c", gold, bad)) == "SQL_ERROR"
    assert E.run_case(spark, E.Case("2", "c", gold, None)) == "ERROR"
    assert E.run_case(spark, E.Case("3", "c", gold, gold)) == "PASS"
    assert E.run_case(spark, E.Case("4", "c", gold, lambda: gold().limit(0))) == "FAIL"


def test_digest_does_not_depend_on_the_order_of_rows(spark):
    rows = [(["x", "1"],), (["y", None],), (["x", "1"],), ([None, "-3"],)]
    digest = lambda rows, parts=1: [tuple(r) for r in E.digests(frame(spark, rows, "row array<string>").repartition(parts), []).collect()]
    assert digest(rows) == digest(rows[::-1], 3) and digest(rows)[0][0] == 4
    assert digest(rows) != digest(rows[:3]) and digest(rows) != digest([*rows[:2], rows[1], rows[3]])


def test_equal_digests_are_confirmed_by_counting(spark, monkeypatch):
    one, two = (lambda n=n: frame(spark, [(n,), (3,)], "a long") for n in (2**60, 2**60 + 1))
    assert E.run_case(spark, E.Case("1", "c", one, two)) == "FAIL"
    none = lambda results, by: results.groupBy(*by).agg(F.count("*").alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    monkeypatch.setattr(E, "digests", none)  # all results of one size clash
    assert E.run_case(spark, E.Case("1", "c", one, two)) == "FAIL"
    assert E.run_case(spark, E.Case("2", "c", one, one)) == "PASS"


@pytest.mark.parametrize("a,b,same", [
    ([(1,)], [(1.0,)], True), ([(True,)], [(1,)], True), ([(0.0,)], [(-0.0,)], True), ([(float("nan"),)], [(float("nan"),)], True),
    ([("1",)], [(1,)], False), ([(2.5,)], [(2,)], False), ([("a", 1)], [("a",)], False),
])
def test_values_of_a_case(spark, a, b, same):
    gold, other = lambda: spark.createDataFrame(a), lambda: spark.createDataFrame(b)
    assert E.run_case(spark, E.Case("1", "c", gold, other)) == ("PASS" if same else "FAIL")
    assert E.results_match(gold(), other()) == same


def test_benchmark_goes_on_after_failures(spark):
    from tallywing.session import scratch_path

    gold = lambda: frame(spark, [("x", 1), ("x", 1), (None, 2)])
    cases = [
        E.Case("fails while running", "c", gold, lambda: gold().select(F.col("a").cast("int"), "n")),
        E.Case("is rejected", "c", gold, lambda: gold().select("no_such_column")),
        E.Case("is missing", "d", gold, None),
        E.Case("loses a copy", "d", gold, lambda: gold().distinct()),
        E.Case("is right", "d", gold, lambda: gold().orderBy("n").toDF("n", "a").select(F.col("n").alias("p"), F.col("a").cast("double"))),
        E.Case("names a column twice", "d", gold, lambda: gold().select("a", F.col("n").alias("a"))),
        E.Case("has an untyped column", "d", lambda: gold().limit(1).select(F.lit(None)), lambda: gold().limit(1).select(F.lit(None))),
        E.Case("has no rows", "d", lambda: gold().limit(0), lambda: gold().limit(0).select("n", "a")),
        E.Case("has no rows and fewer columns", "d", lambda: gold().limit(0), lambda: gold().limit(0).select("n")),
    ]
    path = scratch_path(spark, "outcomes")
    got = {r.id: (r.status, r.gold_rows, r.gen_rows) for r in E.run_benchmark(spark, cases, path).collect()}
    assert got == {
        "fails while running": ("SQL_ERROR", 3, 0), "is rejected": ("SQL_ERROR", 3, 0), "is missing": ("ERROR", 3, 0),
        "loses a copy": ("FAIL", 3, 2), "is right": ("PASS", 3, 3), "names a column twice": ("PASS", 3, 3),
        "has an untyped column": ("PASS", 1, 1), "has no rows": ("PASS", 0, 0), "has no rows and fewer columns": ("PASS", 0, 0),
    }
    assert spark.read.parquet(path).count() == len(cases)  # written once, for the scoreboard
    with pytest.raises(Exception):
        E.run_benchmark(spark, [E.Case("gold fails", "c", cases[0].candidate, gold)], path)


def test_the_scoreboard_reads_stored_outcomes(spark, small):
    from tallywing.plans import benchmark, logs

    done = logs.e02_run_benchmark(spark, small)
    assert sorted(r.id for r in done.collect()) == sorted(n for names in benchmark.CATEGORIES.values() for n in names)
    plan = logs.e03_scoreboard(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "events" not in plan and plan.count("Relation") == 1


def test_pairs_of_a_session_that_starts_with_an_answer(spark):
    log = frame(spark, [(1, 0, "assistant", "hi"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "ai", "b")],
                "conv_id int, turn int, role string, text string")
    pairs = [(r.turn, r.question) for r in C.question_answer_pairs(log).orderBy("turn").collect()]
    assert pairs == [(0, "Insight"), (2, "q"), (3, "q")]


def test_sessions_without_a_question_keep_the_default_title(spark):
    log = frame(spark, [(1, 0, "assistant", "hi"), (2, 0, "user", " " * 3 + "b" * 61)],
                "conv_id int, turn int, role string, text string")
    assert {r.conv_id: r.title for r in C.sessions_rollup(log).collect()} == {1: "New chat", 2: "b" * 60 + "..."}


def test_blank_messages_are_dropped(spark):
    log = frame(spark, [("user", "x"), ("user", " \n\t "), ("ai", "y"), ("system", "z")], "role string, text string")
    assert [r.role for r in C.non_empty_history(log).collect()] == ["user", "assistant", "assistant"]


def test_session_messages_parse_payload(spark):
    from pyspark.sql import types as T

    log = frame(spark, [(1, 1, '{"k": 2}'), (1, 0, "{"), (2, 0, "{}")], "conv_id int, turn int, data_json string")
    rows = C.session_messages(log, 1, T.StructType([T.StructField("k", T.IntegerType())])).collect()
    assert [(r.turn, r.data.k) for r in rows] == [(0, None), (1, 2)]


def test_repeat_hits_against_brute_force(spark):
    rng = random.Random(4)
    times = sorted(rng.sample(range(0, 40_000), 400))
    rows = [(rng.choice("aab"), t) for t in times]
    df = frame(spark, rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {(r.k, r.s): r.hit for r in C.repeat_hits(df, ["k"], ttl_seconds=120).collect()}
    want, last = {}, {}
    for k, t in rows:
        want[k, t] = k in last and t - last[k] <= 120
        last[k] = t
    assert got == want


def test_report_sections(spark):
    rows = [("a", "table", i) for i in range(12)] + [("b", "bar", i) for i in range(12)] + [("c", "text", 1), ("d", "kpi", 1)]
    got = R.report_sections(frame(spark, rows, "item string, kind string, position int"))
    assert {(r.section, r.item): r["count"] for r in got.groupBy("section", "item").count().collect()} == {
        ("full_width", "a"): 8, ("full_width", "b"): 12, ("kpi", "d"): 1}


def test_cells(spark):
    got = R.as_cells(frame(spark, [("x", 1234567), (None, None)], "label string, amount int")).collect()
    assert [tuple(r) for r in got] == [("x", "₹12,34,567"), ("—", "—")]


def test_null_keys_are_one_key(spark):
    from tallywing.operators.conversations import question_answer_pairs, repeat_hits

    rows = [(None, 1, "user", "why"), (None, 2000, "assistant", "so"), (1, 1, "user", "what"), (1, 2000, "assistant", "that")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = question_answer_pairs(df)
    assert sorted(pairs.select("question", "answer").collect()) == [("what", "that"), ("why", "so")]
    ask = spark.createDataFrame([(None, 899), (None, 901), (None, 5000)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    assert [r.hit for r in repeat_hits(ask, ["k"]).orderBy("ts").collect()] == [False, True, False]


def test_null_labels_are_split_like_others(spark):
    df = spark.range(400).select("id", F.when(F.col("id") % 10 < 8, F.col("id") % 2).alias("y"))
    split = stratified_split(df, "y", "id")
    assert {r.y: r.n for r in split.where("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {0: 32, 1: 32, None: 16}
    many = stratified_split(spark.range(3000).select("id", (F.col("id") % 1500).alias("y")), "y", "id", 0.5)
    assert many.where("is_test").groupBy("y").count().where("count = 1").count() == 1500


def test_sketches_of_days_give_any_range(spark):
    from tallywing.operators import quality as Q

    at = F.timestamp_seconds(F.col("id") % 40 * 86_400).cast("timestamp_ntz")
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 400 != 7, at).alias("timestamp"), (F.col("id") % 9000).alias("many"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("v"), F.col("id") % 5)).alias("few"), F.lit(None).cast("string").alias("none"),
    )
    columns = ["many", "few", "none"]
    old, new = (Q.day_sketches(rows.where(c), columns) for c in ("day(timestamp) <= 20", "timestamp IS NULL OR day(timestamp) > 20"))
    sketches = old.unionByName(new)
    for first, last in ((None, None), ("1970-01-05", "1970-01-25"), ("1970-01-30", None), (None, "1970-01-01")):
        day = F.to_date("timestamp")
        held = rows.where((day >= first if first else F.lit(True)) & (day <= last if last else F.lit(True)))
        want = {r.column: r for r in Q.profile(held, columns, exact=True).collect()}
        got = {r.column: r for r in Q.profile_days(sketches, first, last).collect()}
        assert got.keys() == want.keys()
        for c, w in want.items():
            assert (got[c].rows, got[c].nulls) == (w.rows, w.nulls)
            assert abs(got[c].distinct_values - w.distinct_values) <= Q.SKETCH_ERROR * w.distinct_values
    assert Q.profile_days(sketches, "2001-01-01").isEmpty()
