from pyspark.sql import functions as F

from tallywing.functions import dates as D
from tallywing.functions import features as X
from tallywing.functions import text as TX


def apply(spark, values, kind, *fns):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [tuple(r) for r in df.select(*[fn(F.col("v")) for fn in fns]).collect()]


def test_day_part_boundaries(spark):
    hours = [4, 5, 6, 11, 12, 16, 17, 18, 20, 21, 22, 23, 0, None]
    got = apply(spark, hours, "int", X.day_part, lambda c: X.day_part(c, "dictionary"))
    stored = ["Night", "Morning", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening",
              "Evening", "Night", "Night", "Night", "Night", None]
    dictionary = ["Night", "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Afternoon", "Evening",
                  "Evening", "Evening", "Night", "Night", "Night", None]
    assert got == list(zip(stored, dictionary))


def test_amount_tier_boundaries(spark):
    got = apply(spark, [0, 499, 500, 5000, 5001, 50000, 50001, None], "int", X.amount_tier,
                lambda c: X.amount_tier(c, "long"))
    assert [g[0] for g in got] == ["Small", "Small", "Medium", "Medium", "Large", "Large", "Very Large", None]
    assert [g[1] for g in got][-3:] == ["Large (5000-50000)", "Large (5000-50000)", None]


def test_age_label_of_unknown_is_null(spark):
    got = apply(spark, ["18-25", "26-35", "36-45", "46-55", "56+", "60+", None], "string", X.age_label)
    assert [g[0] for g in got] == ["Young", "Adult", "Adult", "Adult", "Old", None, None]


def test_risk_never_above_cap(spark, medium):
    from tallywing.sources.fixture import transactions

    top = X.rule_risk_score(transactions(spark, medium, with_state=False)).agg(F.max("risk_score")).first()[0]
    assert 0 < top <= 0.30


def test_risk_of_the_riskiest_row(spark):
    df = spark.createDataFrame(
        [(20001, 23, "3G", "Web", 1, "P2P"), (100, 12, "4G", "iOS", 0, "P2M")],
        "amount_inr int, hour_of_day int, network_type string, device_type string, is_weekend int, transaction_type string",
    )
    assert [r[0] for r in df.select(X.row_risk_permille()).collect()] == [240, 20]


def test_risk_level_and_verdict_boundaries(spark):
    got = apply(spark, [0.0, 0.2999, 0.3, 0.4999, 0.5, 0.6999, 0.7, None], "double", X.risk_level, X.verdict)
    assert got == [("Low", "LEGITIMATE"), ("Low", "LEGITIMATE"), ("Medium", "LEGITIMATE"), ("Medium", "LEGITIMATE"),
                   ("Medium", "FRAUD"), ("Medium", "FRAUD"), ("High", "FRAUD"), (None, None)]


def test_date_parts_of_text_and_time(spark):
    df = spark.sql("SELECT '2024-03-09 01:02:03' AS s, TIMESTAMP_NTZ '2024-03-09 01:02:03.456' AS t")
    for c in ("s", "t"):
        c = F.col(c)
        row = df.select(D.month_of(c), D.year_of(c), D.year_month(c), D.day_of(c), D.iso_text(c)).first()
        assert tuple(row) == ("03", "2024", "2024-03", "2024-03-09", "2024-03-09 01:02:03")


def test_in_month_wraps_the_year(spark):
    df = spark.sql("SELECT explode(array(TIMESTAMP_NTZ '2023-12-31 23:59:59', TIMESTAMP_NTZ '2024-01-01 00:00:00')) AS t")
    assert df.filter(D.in_month(F.col("t"), 2023, 12)).count() == 1


def test_coalesce_number(spark):
    got = apply(spark, ["12", " 1.5 ", "1e3", "abc", "", None, "1d", "nan", "-.5"], "string", TX.coalesce_number)
    assert [g[0] for g in got] == [12.0, 1.5, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0, -0.5]


def test_format_inr(spark):
    got = apply(spark, [0.0, 999.0, 1000.0, 99999.0, 100000.0, 1234567.0, 12345678.5, -1234.5, None], "double",
                TX.format_inr, lambda c: TX.format_inr(c, "total_amount"))
    assert [g[0] for g in got] == ["0", "999", "1,000", "99,999", "1,00,000", "12,34,567", "1,23,45,678.5", "-1,234.5", "—"]
    assert got[5][1] == "₹12,34,567" and got[-1][1] == "—"


def test_truncate_title(spark):
    got = apply(spark, ["a" * 60, "b" * 61, "  \n x \t", ""], "string", TX.truncate_title)
    assert [g[0] for g in got] == ["a" * 60, "b" * 60 + "...", "x", ""]


def test_age_bucket(spark):
    seconds = [0, 59, 60, 3599, 3600, 86399, 86400, 7 * 86400 - 1, 7 * 86400, 30 * 86400]
    df = spark.createDataFrame([(s,) for s in seconds], "s int")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    got = df.select(TX.age_bucket(now - F.make_dt_interval(secs=F.col("s")), now)).collect()
    assert [r[0] for r in got] == ["Just now", "Just now", "1m", "59m", "1h", "23h", "1d", "6d", "1w", "4w"]


def test_fingerprint_keeps_parts_apart(spark):
    df = spark.sql("SELECT 'ab' AS a, 'c' AS b, 'a' AS x, 'bc' AS y")
    row = df.select(TX.fingerprint(F.col("a"), F.col("b")), TX.fingerprint(F.col("x"), F.col("y"))).first()
    assert row[0] != row[1]


def test_parse_payload_of_bad_text(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("k", T.IntegerType())])
    got = apply(spark, ['{"k": 3}', '{"k": ', "", None, "{}"], "string", lambda c: TX.parse_payload(c, schema))
    assert [g[0]["k"] for g in got] == [3, None, None, None, None]


def test_peak_label_uses_whole_average(spark):
    got = apply(spark, [416, 417], "long", lambda c: X.peak_label(c, F.lit(10001)))
    assert [g[0] for g in got] == ["Off-Peak", "Peak"]


def test_null_if_not_applicable(spark):
    df = spark.createDataFrame([("P2P", "Food", "18-25"), ("P2M", "Food", "18-25")],
                               "transaction_type string, merchant_category string, receiver_age_group string")
    assert [tuple(r) for r in X.null_if_not_applicable(df).collect()] == [("P2P", None, "18-25"), ("P2M", "Food", None)]
