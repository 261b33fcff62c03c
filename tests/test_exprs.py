import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopmill.functions import exprs as X


def test_unparseable_values_become_null(one):
    assert one(X.to_number(F.lit("abc")), X.to_time(F.lit("2017-13-01")), X.to_whole(F.lit("x"))) == (None, None, None)
    assert one(X.to_number(F.lit("NaN")), X.to_number(F.lit("Infinity"))) == (None, None)
    assert one(X.to_whole(F.lit("3.0")), X.to_whole(F.lit("9007199254740993"))) == (3, 9007199254740993)


def test_parsed_time_has_no_zone(one):
    assert one(X.to_time(F.lit("2017-10-15 00:30:00"))) == (dt.datetime(2017, 10, 15, 0, 30),)


def test_ratio_needs_a_positive_denominator(one):
    price = [F.lit(v).cast("double") for v in (0.0, -1.0, None, 20.0)]
    assert one(*[X.ratio(F.lit(5.0), p, 4) for p in price]) == (None, None, None, 0.25)


@pytest.mark.parametrize("value, even, away", [
    (0.125, 0.12, 0.13), (1.005, 1.0, 1.0), (2.675, 2.68, 2.68), (-0.125, -0.12, -0.13), (0.0, 0.0, 0.0)])
def test_rounding_families(one, value, even, away):
    assert one(X.round_half_even(F.lit(value), 2), X.round_half_away(F.lit(value), 2)) == (even, away)


@pytest.mark.parametrize("text, stripped", [
    ("\t a b \n", "a b"), (" x ", "x"), ("plain", "plain"), ("", ""), ("   ", ""), (None, None),
    ("é", "é"), (" é", "é"), ("\x1cq\x85", "q"), ("a　", "a")])
def test_strip(one, text, stripped):
    value = F.lit(text).cast("string")
    assert one(X.strip(value), X.strip_to_null(value)) == (stripped, stripped or None)


@pytest.mark.parametrize("marker", ["", "NA", "N/A", "null", "NaN", "None", "#N/A", "<NA>"])
def test_missing_markers(one, marker):
    assert one(X.missing_to_null(F.lit(marker)), X.missing_to_null(F.lit("na"))) == (None, "na")


def test_safe_percentage(one):
    whole = [F.lit(v).cast("bigint") for v in (0, 3, 7)]
    assert one(*[X.safe_percentage(F.lit(1), w) for w in whole]) == (0.0, 33.33, 14.29)


def test_exact_sum_and_mean(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,), (0.3,)], "x double")
    assert tuple(df.agg(X.exact_sum("x"), X.exact_mean("x")).first()) == (0.6, 0.6 / 3)
    assert tuple(df.where("x > 9").agg(X.exact_sum("x"), X.exact_mean("x")).first()) == (None, None)


def test_weighted_mean_ignores_nulls_with_their_weight(spark):
    df = spark.createDataFrame([(6.0, 3), (2.0, 1), (None, 50)], "x double, n bigint")
    assert df.agg(X.exact_weighted_mean("x", "n")).first()[0] == 5.0


def test_days_and_months_ignore_the_session_zone(one):
    # The session zone skips midnight of 2017-10-15.
    a, b = (F.lit(t).cast("timestamp_ntz") for t in ("2017-10-14 12:00:00", "2017-10-15 12:00:00"))
    assert one(X.days_between(a, b), X.days_between(b, a)) == (1.0, -1.0)
    assert one(X.month_start(b)) == (dt.datetime(2017, 10, 1),)
    half = F.lit("2017-10-14 12:00:00.5").cast("timestamp_ntz")
    assert one(X.days_between(a, half)) == (0.5 / 86400,)


def test_report_texts(one):
    assert one(X.grouped_number(F.lit(1234567)), X.grouped_number(F.lit(13591643.7), 2)) == (
        "1,234,567", "13,591,643.70")
    assert one(X.plain_money(F.lit(13591643.7)), X.plain_money(F.lit(100.0)), X.plain_money(F.lit(0.25))) == (
        "13591643.7", "100.0", "0.25")
    assert one(X.text(F.lit(1), F.lit(None).cast("int"), F.lit(3))) == ("13",)


def test_sums_and_means_leave_out_the_same_amounts(spark):
    rows = [("a", 10.0, 1), ("a", 1e300, 3), ("a", float("nan"), 1), ("a", None, 2), ("b", 1e16, 1), ("c", None, 1),
            ("d", 0.1, 2), ("d", 0.2, 1), ("d", -0.7, 4), ("e", 9.99e14, 1), ("e", 0.01, 1), ("e", -123456789.12, 1)]
    df = spark.createDataFrame(rows, "k string, v double, w long").groupBy("k").agg(
        X.exact_sum("v").alias("s"), X.exact_mean("v").alias("m"), X.exact_weighted_mean("v", "w").alias("p"))
    got = {r["k"]: (r["s"], r["m"], r["p"]) for r in df.collect()}
    assert got["a"] == (10.0, 10.0, 10.0)
    assert got["b"] == got["c"] == (None, None, None)
    assert got["d"] == (-0.4, -0.4 / 3, -2.4 / 7)
    assert got["e"][0] == (99900000000000000 + 1 - 12345678912) / 100


def test_large_totals(spark):
    df = spark.range(20_000).select(F.lit(9e14).alias("v"))
    assert df.limit(10_000).agg(X.exact_sum("v")).first()[0] == 9e18
    assert df.agg(X.exact_sum("v"), X.exact_mean("v")).first()[:] == (None, None)
    many = spark.range(100_000).select((F.col("id") % 1000 / 100.0 - 3).alias("v"))
    assert many.agg(X.exact_sum("v")).first()[0] == sum(k % 1000 - 300 for k in range(100_000)) / 100


def test_eight_digits(spark):
    df = spark.createDataFrame([(0.12345678,), (1234567.00000001,), (5e14,)], "v double")
    assert df.agg(X.exact_sum("v", 8)).first()[0] == pytest.approx(5e14 + 1234567.12345679, abs=0.1)
    assert df.where("v < 1e14").agg(X.exact_sum("v", 8)).first()[0] == 123456712345679 / 1e8
