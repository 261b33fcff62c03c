"""Sums that neither overflow nor lose small amounts, and CSV reads that never alter rows."""

import pytest
from pyspark.sql import functions as F

from shopmill.functions import exprs as X
from shopmill.operators.model import agg_order_payments
from shopmill.plans.quality import numeric_quality
from shopmill.sources.readers import read_raw_table, read_raw_tables
from shopmill.sources.schemas import RAW_COLUMNS


def test_small_payments_add_up(spark):
    rows = [("o", k, 1, "voucher", 0.004) for k in range(1000)]
    payments = spark.createDataFrame(
        rows, "order_id string, payment_sequential long, payment_installments long, payment_type string, payment_value double")
    assert agg_order_payments(payments).first()["total_payment_value"] == 4.0


def test_sums_beyond_a_long_and_extreme_values(spark):
    big = spark.createDataFrame([(9e14,)] * 12, "v double")
    assert big.agg(X.exact_sum("v", 4)).first()[0] == 12 * 9e14
    assert big.agg(X.exact_mean("v", 4)).first()[0] == 9e14
    wild = spark.createDataFrame([(1e300,), (2.5,)], "v double")
    assert wild.agg(X.exact_sum("v")).first()[0] == 2.5


def test_extreme_price_fails_the_audit(spark):
    items = spark.createDataFrame([("1e300", "1.0"), ("2.0", "-1.0")], "price string, freight_value string")
    payments = spark.createDataFrame([("1", "3.0")], "payment_installments string, payment_value string")
    found = {r["check"]: r["status"] for r in numeric_quality({"order_items": items, "payments": payments}).collect()}
    assert found["order_items.price valid (>= 0)"] == "FAIL"
    assert found["order_items.freight_value valid (>= 0)"] == "FAIL"
    assert found["payments.payment_value valid (>= 0)"] == "PASS"


def line(*fields):
    return ",".join(fields) + "\n"


@pytest.mark.parametrize("table", sorted(RAW_COLUMNS))
def test_quoted_line_breaks_survive(spark, tmp_path, table):
    names = RAW_COLUMNS[table]
    path = tmp_path / f"{table}.csv"
    path.write_text(line(*names) + line(*['"a\nb, ""c"""'] * len(names)) + line(*["x"] * (len(names) - 1)))
    rows = read_raw_tables(spark, {table: str(path)})[table].collect()
    assert [tuple(r) for r in rows] == [('a\nb, "c"',) * len(names), ("x",) * (len(names) - 1) + (None,)]


def test_surplus_fields_stop_the_read(spark, tmp_path):
    names = RAW_COLUMNS["customers"]
    path = tmp_path / "customers.csv"
    path.write_text(line(*names) + line(*["x"] * len(names)) + line(*["y"] * (len(names) + 1)))
    df = read_raw_table(spark, "customers", str(path))
    for action in (df.collect, df.count, df.select(F.col(names[2])).collect):
        with pytest.raises(Exception, match="too many fields in .*customers.csv"):
            action()
