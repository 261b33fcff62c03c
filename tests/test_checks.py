import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopmill.operators import guards
from shopmill.plans import investigate as I, quality as A, validate as V
from shopmill.plans.checks import key_measures
from shopmill.plans.warehouse import Warehouse
from shopmill.sources import samples
from shopmill.sources.writers import save_table


@pytest.fixture(scope="module")
def raw(spark, sample):
    return dict(samples.raw_tables(spark, sample))


@pytest.fixture(scope="module")
def model(raw):
    return {name: df.cache() for name, df in Warehouse(raw).model.items()}


def statuses(report):
    return {r["check"]: r["status"] for r in report.collect()}


def test_keys(spark):
    orders = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "order_id string")
    other = {"customers": "customer_id", "products": "product_id", "sellers": "seller_id"}
    tables = {t: spark.createDataFrame([("x",)], f"{k} string") for t, k in other.items()}
    row = A.pk_quality({"orders": orders, **tables}).where("check LIKE 'orders%'").first()
    assert tuple(row) == ("orders.order_id uniqueness", "FAIL", "Rows=4, nulls=2, duplicates=2", 4, 100.0)


def test_orphans_leave_out_null_keys(raw, spark):
    broken = {**raw, "payments": raw["payments"].limit(2).withColumn("order_id", F.lit("nobody")).unionAll(
        raw["payments"].limit(1).withColumn("order_id", F.lit(None).cast("string")))}
    row = A.fk_quality(broken).where("check LIKE 'payments%'").first()
    assert (row.status, row["count"], row.percentage, row.details) == (
        "FAIL", 2, 100.0, "Non-null child keys=2, orphan keys=2")


def test_value_checks_report_what_they_found(spark, raw):
    payments = spark.createDataFrame(
        [("o", 1, "cash", 0, 1.0), ("o", 2, "voucher", -2, -1.0), ("o", 3, None, 0, 1.0), ("o", 4, "boleto", 3, 1.0)],
        "order_id string, payment_sequential bigint, payment_type string, payment_installments bigint, payment_value double")
    tables = {**raw, "payments": payments}
    numeric = {r["check"]: r for r in A.numeric_quality(tables).collect()}
    plans = numeric["payments.payment_installments valid (> 0)"]
    assert (plans.status, plans["count"], plans.details) == ("REVIEW", 3, "Invalid rows=3; invalid values={-2: 1, 0: 2}")
    assert numeric["payments.payment_value valid (>= 0)"].status == "FAIL"
    types = A.domain_quality(tables).where("check LIKE 'payments%'").first()
    assert (types.status, types.details) == (
        "REVIEW", "Observed types=['boleto', 'cash', 'voucher']; unexpected types=['cash']")


def test_texts_name_a_bounded_number_of_values(spark, raw):
    many = 100_000
    payments = spark.range(many).selectExpr(
        "'o' AS order_id", "id AS payment_sequential", "concat('t', lpad(id, 6, '0')) AS payment_type",
        "-id AS payment_installments", "1.0D AS payment_value")
    payments = payments.unionAll(payments.where("payment_sequential = 77777"))
    products = spark.range(many).selectExpr("cast(id AS string) AS product_id", "concat('c', lpad(id, 6, '0')) AS product_category_name")
    tables = {**raw, "payments": payments}
    plans = A.numeric_quality(tables).where("check LIKE '%installments%'").first()
    assert plans["count"] == many + 1 and plans.details.endswith(", -77777: 2 and 99900 more}")
    types = A.domain_quality(tables).where("check LIKE 'payments%'").first()
    assert types["count"] == many + 1 and types.details.count("'t077777'] and 99900 more") == 2
    gaps = A.category_translation_coverage(products, raw["translation"]).first()
    assert gaps["count"] == many and gaps.details.count("'c") == A.LISTED and gaps.details.endswith(" and 99900 more")
    found = A.unexpected_payment_types(payments)
    assert found.count() == many and tuple(found.first()) == ("t077777", 2)


def test_times_that_do_not_parse(spark):
    columns = A.LIFECYCLE_TIMES
    orders = spark.createDataFrame([("2017-01-01 00:00:00", "junk", None, None, None)],
                                   ", ".join(f"{c} string" for c in columns))
    rows = {r["check"]: (r.status, r["count"]) for r in A.timestamp_parse_quality(orders).collect()}
    assert rows["order_approved_at parse validity"] == ("FAIL", 1)
    assert rows["order_delivered_carrier_date missing after parsing"] == ("INFO", 1)
    assert rows["order_delivered_carrier_date parse validity"] == ("PASS", 0)


def test_exact_duplicates_and_cardinality(spark, raw):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a"), ("b", "x"), ("b", "x"), ("b", "x")],
                               "p string, q string")
    assert A.exact_duplicate_rows(df).first()[0] == 3
    geo = spark.createDataFrame(
        [("01", 1.0, 1.0, "c", "S"), ("01", 1.0, 1.0, "c", "S"), ("01", 1.0, None, "c", "S"), (None, 5.0, 5.0, "c", "S")],
        "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, geolocation_city string, "
        "geolocation_state string")
    assert [r.value for r in A.geolocation_quality(geo).collect()] == [4.0, 1.0, 25.0, 1.0, 1.0, 1.0, 2.0]


def test_extracts(spark):
    items = spark.createDataFrame(
        [("a", 1), ("a", 1), (None, 2), (None, 2), ("b", 1)], "order_id string, order_item_id bigint")
    assert I.order_item_key_duplicates(items).count() == 4
    assert [tuple(r) for r in I.order_item_duplicate_key_groups(items).collect()] == [("a", 1, 2)]
    orders = spark.createDataFrame([("a",), ("c",), (None,)], "order_id string")
    left = {r.order_id for r in I.orders_without(orders, items).collect()}
    assert left == {"c", None}
    assert [tuple(r) for r in I.multiple_reviews_per_order(items).collect()] == [("a", 2)]


def test_an_order_is_listed_once_per_broken_rule(spark):
    t = [dt.datetime(2017, 1, d) for d in (5, 6, 1, 2, 9)]
    orders = spark.createDataFrame([("o", "delivered", *t)], "order_id string, order_status string, " + ", ".join(
        f"{c} timestamp_ntz" for c in A.LIFECYCLE_TIMES))
    assert {r.anomaly_type for r in I.invalid_date_sequences(orders).collect()} == {
        "carrier_before_purchase", "carrier_before_approval", "customer_delivery_before_purchase"}


def test_unkeyed_items_fail_the_business_key_checks(spark, sample):
    clean = Warehouse(samples.raw_tables(spark, sample, keyed=False)).clean
    assert statuses(V.processed_business_keys(clean)) == {
        "order_items order_id + order_item_id uniqueness": "FAIL", "order_items transactional uniqueness": "PASS"}


def test_wrong_derived_fields_fail(raw):
    clean = dict(Warehouse(raw).clean)
    clean["order_items"] = clean["order_items"].withColumn("item_total_value", F.col("item_total_value") + 1)
    clean["orders"] = clean["orders"].withColumn("flag_carrier_before_purchase", F.lit(None).cast("boolean"))
    assert statuses(V.derived_field_recompute(clean))["order_items.item_total_value calculation"] == "FAIL"
    assert statuses(V.delivery_metric_consistency(clean))["orders data-quality flags generated"] == "FAIL"


def test_missing_tables_are_named(spark):
    report = V.processed_tables_exist(spark.range(1), [t for t in A.LIFECYCLE_TIMES]).first()
    assert report.status == "FAIL" and "'orders'" in report.details and report["count"] == 9


def test_model_gate(model, raw):
    expected = {"fact_order_items": raw["order_items"], "fact_orders": raw["orders"]}
    assert guards.fail_on_failures(V.model_validation(model, expected)).count() == 12
    broken = {**model, "agg_order_items": model["agg_order_items"].withColumn(
        "product_revenue", F.col("product_revenue") * 2)}
    with pytest.raises(guards.ValidationError, match="product revenue reconciliation"):
        guards.fail_on_failures(V.model_validation(broken, expected), "model")


def test_category_revenue_is_really_compared(model):
    """Dropping a category must be noticed."""
    wrong = {**model, "fact_orders": model["fact_orders"].where("customer_state <> 'ST1'")}
    report = {r["check"]: r for r in V.sales_reconciliation(wrong, 1500, 1196).collect()}
    assert report["State revenue reconciliation"].status == "FAIL"
    assert report["Category revenue reconciliation"].status == "PASS"
    assert report["Unique customer count"].detail == "Expected=1196; Actual=1196"


def test_catalog_tables(spark, model):
    save_table(model["agg_order_reviews"], "agg_order_reviews", bucket_by="order_id", buckets=4)
    listed = [t.name for t in spark.catalog.listTables()]
    assert "agg_order_reviews" in listed and spark.table("agg_order_reviews").count() == 1350
    spark.sql("DROP TABLE agg_order_reviews")


def test_folder_inventory(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,y\n1,\n1,NA\n2,z\n")
    (tmp_path / "a.csv").write_text("k\nv\n")
    (tmp_path / "notes.txt").write_text("no table")
    assert [tuple(r) for r in A.folder_inventory(spark, str(tmp_path)).collect()] == [
        ("a", "a.csv", 1, 1, 0, 0, 0), ("b", "b.csv", 3, 2, 1, 2, 1)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        A.folder_inventory(spark, str(tmp_path / "empty"))


def test_catalog_report_names_missing_and_extra_tables(spark, model):
    from shopmill.plans.warehouse import build_marts
    tables = {**model, **build_marts(model)}
    rows = {t: 1 for t in V.CATALOG_TABLES}
    listed = [t for t in V.CATALOG_TABLES if t != "dim_date"] + ["scratch"]
    report = {r["check"]: r for r in V.catalog_validation(tables, rows, listed).collect()}
    assert len(report) == 32
    assert report["Expected tables exist"].details == "Missing tables=['dim_date']"
    assert report["No unexpected analytical tables"].status == "FAIL"
    assert report["operations_summary row count"].status == "PASS"
    assert report["fact_orders row count"].details == "Expected=1; Actual=1,500"


def test_keys_meet_before_they_are_counted(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), (None, 2), ("b", 1)], "k string, v int")
    measures = key_measures(df, "k", "v")
    assert tuple(measures.first()) == (5, 2, 2)
    plan = measures._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan.split("HashAggregate(keys=[k")[-1]
