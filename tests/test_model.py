import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopmill.operators import guards, model as M
from shopmill.plans.warehouse import Warehouse
from shopmill.sources import samples


def items(spark, *rows):
    return M.item_measures(spark.createDataFrame(
        rows, "order_id string, order_item_id bigint, product_id string, seller_id string, price double, "
              "freight_value double"))


def test_category_falls_back_to_the_original_name(spark):
    products = spark.createDataFrame(
        [("p1", "a"), ("p2", "b"), ("p3", None)], "product_id string, product_category_name string")
    for column in ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"):
        products = products.withColumn(column, F.lit(1.0))
    translation = spark.createDataFrame(
        [("a", "A")], "product_category_name string, product_category_name_english string")
    keys = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("p4",)], "product_id string")
    rows = M.add_products(keys, products, translation).orderBy("product_id").collect()
    assert [r.product_category for r in rows] == ["A", "b", None, None]


def test_item_total_is_rounded_from_rounded_parts(spark):
    row = items(spark, ("o", 1, "p", "s", 1.125, 0.375)).first()
    assert (row.item_revenue, row.item_freight, row.item_total_value) == (1.12, 0.38, 1.5)


def test_order_item_aggregate(spark):
    rows = M.agg_order_items(items(
        spark, ("o", 1, "p", "s", 0.1, 0.0), ("o", 2, "p", "t", 0.2, 1.0), ("o", None, "q", None, None, 1.0),
        (None, 1, "p", "s", 9.0, 9.0), ("e", 1, None, None, None, None))).orderBy("order_id").collect()
    assert [tuple(r) for r in rows] == [
        ("e", 1, 0, 0, 0.0, 0.0, 0.0), ("o", 2, 2, 2, 0.3, 2.0, 1.3)]


def test_payment_types_are_sorted_distinct_text(spark):
    df = spark.createDataFrame(
        [("o", 1, t, i, 1.0) for i, t in enumerate(["voucher", "credit_card", None, "voucher"])]
        + [("n", 1, None, None, None)],
        "order_id string, payment_sequential bigint, payment_type string, payment_installments bigint, "
        "payment_value double")
    rows = {r.order_id: r for r in M.agg_order_payments(df).collect()}
    assert (rows["o"].payment_types, rows["o"].payment_count, rows["o"].max_payment_installments,
            rows["o"].total_payment_value) == ("credit_card | voucher", 4, 3, 4.0)
    assert (rows["n"].payment_types, rows["n"].total_payment_value, rows["n"].max_payment_installments) == (
        "", 0.0, None)


def test_review_aggregate(spark):
    df = spark.createDataFrame(
        [("r1", "o", 1, True), ("r2", "o", 2, False), ("r3", "o", 2, True), ("r4", "n", None, False)],
        "review_id string, order_id string, review_score bigint, has_review_comment boolean")
    rows = {r.order_id: tuple(r)[1:] for r in M.agg_order_reviews(df).collect()}
    assert rows == {"o": (3, 1.67, 1, 2, 2), "n": (1, None, None, None, 0)}


def orders(spark, *rows):
    return spark.createDataFrame(
        rows, "order_id string, customer_unique_id string, order_purchase_timestamp timestamp_ntz, "
              "product_revenue double, freight_value double, order_item_total_value double")


def test_customer_without_items_has_zero_total_and_no_average(spark):
    at = dt.datetime(2017, 1, 1)
    rows = M.customer_orders(orders(
        spark, ("o1", "x", at, None, None, None), ("o2", "y", at, 1.0, 0.5, 1.5), ("o3", "y", at, 2.0, 0.5, 2.5),
        ("o4", "y", at, None, None, None), ("o5", None, at, 1.0, 1.0, 2.0))).orderBy("customer_unique_id").collect()
    assert [(r.customer_unique_id, r.order_count, r.total_product_revenue, r.average_order_value) for r in rows] == [
        ("x", 1, 0.0, None), ("y", 3, 3.0, 2.0)]


def test_profile_is_of_the_greatest_customer_id(spark):
    df = spark.createDataFrame(
        [("c9", "x", "1", "old", "A"), ("c10", "x", "2", "new", "B")],
        "customer_id string, customer_unique_id string, customer_zip_code_prefix string, customer_city string, "
        "customer_state string")
    assert M.customer_profile(df).first().customer_city == "old"


def test_freight_ratio_and_difference(spark):
    df = spark.createDataFrame(
        [(0.0, 1.0, 5.0, 1.0), (3.0, 1.0, None, 4.0), (3.0, 1.0, 5.25, 4.0)],
        "product_revenue double, freight_value double, total_payment_value double, order_item_total_value double")
    rows = M.revenue_payment_difference(M.order_freight_ratio(df)).collect()
    assert [(r.freight_ratio, r.revenue_payment_difference) for r in rows] == [
        (None, 4.0), (0.3333, None), (0.3333, 1.25)]


def test_require_unique_names_the_key(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    with pytest.raises(guards.CardinalityError, match="dims: k='b' occurs 2 times"):
        guards.require_unique(df, "k", name="dims")
    assert guards.require_unique(df.distinct(), "k").count() == 2


def test_null_equals_null_in_duplicate_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 1)], "k string, v int")
    assert [tuple(r) for r in guards.duplicate_keys(df, "k", "v").collect()] == [(None, 1, 2)]


def test_repeated_hash_keeps_every_repetition(spark):
    df = spark.createDataFrame([(0.0, "a"), (-0.0, "a"), (1.0, None), (1.0, None), (2.0, "b")], "x double, s string")
    assert guards.rows_with_repeated_hash(df, "x", "s").count() == 4


def test_broken_keys_stop_the_model(spark, sample):
    raw = dict(samples.raw_tables(spark, sample))
    raw["products"] = raw["products"].unionAll(raw["products"].limit(1))
    with pytest.raises(guards.CardinalityError, match="products"):
        Warehouse(raw).require_unique_keys()


@pytest.mark.parametrize("table", ["products", "sellers", "translation", "customers"])
def test_guarded_joins_raise_in_their_plan_and_name_the_key(spark, sample, table):
    raw = dict(samples.raw_tables(spark, sample))
    clean = dict(Warehouse(raw).clean)
    one = clean[table].limit(1)
    key = one.columns[0]
    clean[table] = clean[table].unionAll(one)
    house = Warehouse(raw, clean, guarded=True)
    fact = house.orders(customers=True) if table == "customers" else house.items(products=True, sellers=True)
    with pytest.raises(Exception, match=f"{table}: {key}=.* occurs 2 times"):
        fact.write.format("noop").mode("overwrite").save()


def test_guarded_joins_change_no_row_and_scan_nothing_twice(spark, sample):
    raw = samples.raw_tables(spark, sample)
    plain, guarded = Warehouse(raw), Warehouse(raw, guarded=True)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    for build in (
        lambda house: house.items(products=True, sellers=True),
        lambda house: house.with_sellers(house.with_products(house.items())),
        lambda house: house.orders(customers=True),
    ):
        expected, found = build(plain), build(guarded)
        assert found.columns == expected.columns and found.count() == expected.count()
        assert found.exceptAll(expected).count() == 0 and scans(found) == scans(expected)


def test_unique_side_of_odd_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", None), (None, "x", 3)], "k string, l string, v int")
    assert guards.unique_side(df, "k", "l").exceptAll(df).count() == 0
    assert guards.unique_side(df, "k", "l").columns == df.columns
    assert guards.unique_side(df.limit(0), "k").count() == 0
    with pytest.raises(Exception, match="side: k=NULL, l=x occurs 2 times"):
        guards.unique_side(df.unionAll(df.where("k IS NULL")), "k", "l", name="side").collect()


def test_sample_item_numbers_are_unique(spark):
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        df = samples.order_items(spark, f"/root/testdata/{sf}")
        assert df.select("order_id", "order_item_id").distinct().count() == df.count()


def test_item_aggregate_copies_no_row_and_shuffles_once(spark):
    df = M.agg_order_items(items(spark, ("o", 1, "p", "s", 0.1, 0.0)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 1


def test_no_exchange_of_the_order_fact_carries_derived_columns(spark, sample):
    house = Warehouse(samples.raw_tables(spark, sample))
    wide = house.clean["orders"]
    df = house.orders(customers=True, items=True, payments=True, reviews=True)
    plan = df._jdf.queryExecution().optimizedPlan()
    assert "order_purchase_weekday" not in plan.toString().split("Join", 1)[1]
    joined = wide.join(house.clean["customers"].select("customer_id", "customer_state"), "customer_id", "left")
    assert df.columns[:len(wide.columns)] == wide.columns
    assert df.select(joined.columns).exceptAll(joined).count() == 0 and df.count() == wide.count()
    bare = spark.createDataFrame([("o", "c", True)], "order_id string, customer_id string, is_late boolean")
    assert M.fact_orders(bare, house.clean["customers"]).first().is_late


def test_rows_meet_only_where_hashes_repeat(spark, tmp_path):
    spark.range(1000).selectExpr("id", "concat('t', id) t").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 4000)
    try:
        found = guards.rows_with_repeated_hash(df, "id", "t")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
