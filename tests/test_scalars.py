"""Edge cases of the scalar expressions."""

from pyspark.sql import functions as F

from claimflow.functions import scalars as fn


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_risk_band(spark):
    scores = ["3", "3.9", "7.9", "0", "-5", "99", "N/A", None, "", " 6 ", "4", "inf", "nan", "1e3", "7d", "1e30"]
    assert column(spark, scores, fn.risk_band) == [
        "Low", "Low", "High", "Low", "Low", "High", None, None, None, "Medium", "Medium", None, None, "High", None, "High",
    ]
    assert column(spark, scores[:6], fn.risk_percent) == [30, 30, 70, 0, -50, 990]
    assert column(spark, [2.5, 6.99], fn.risk_points, "double") == [2, 6]


def test_relevance_band_is_strict(spark):
    scores = [0.65, 0.6500001, 0.55, 0.5500001, None]
    assert column(spark, scores, fn.relevance_band, "double") == ["Medium", "High", "Low", "Medium", "Low"]


def test_strip_takes_every_kind_of_white_space(spark):
    texts = ["\t a b\n", "\u00a0x\u2003", "\x1cy\x1f", "", None, " \r\n "]
    assert column(spark, texts, fn.strip_ws) == ["a b", "x", "y", "", None, ""]
    assert column(spark, texts, fn.is_blank) == [False, False, False, True, True, True]


def test_decision_to_status(spark):
    decisions = ["APPROVE", "DENY", "REFER", "approve", "ERROR", None]
    assert column(spark, decisions, fn.decision_to_status) == [
        "Approved", "Denied", "Under Review", "Under Review", "Under Review", "Under Review",
    ]


def test_geo_to_country(spark):
    assert column(spark, ["country/HKG", "country/USA", "HKG", None], fn.geo_to_country) == ["Hong Kong", None, None, None]


def test_ratio_of_zero_is_null(spark):
    df = spark.sql("SELECT * FROM VALUES (6.0D, 3.0D), (1.0D, 0.0D), (NULL, 2.0D) AS t(a, b)")
    assert [r[0] for r in df.select(fn.safe_ratio(F.col("a"), F.col("b"))).collect()] == [2.0, None, None]


def test_report_formats_round_half_even(spark):
    assert column(spark, [2.5, 3.5, 1234567.4], fn.dollars, "double") == ["$2", "$4", "$1,234,567"]
    assert column(spark, [0.25, 12.345], fn.percent_text, "double") == ["0.2%", "12.3%"]
    na = column(spark, [0.0, None, 5.0], lambda c: fn.or_not_available(c, fn.dollars(c)), "double")
    assert na == ["N/A", "N/A", "$5"]


def test_bucket_is_stable_and_in_range(spark):
    keys = [f"CLM-{i}" for i in range(200)]
    first = column(spark, keys, lambda c: fn.hash_bucket(c, 5))
    assert first == column(spark, keys, lambda c: fn.hash_bucket(c, 5))
    assert set(first) == set(range(5))
