import datetime as dt
import re

from pyspark.sql import functions as F

from shopmill.plans import calendar, operations, products, rfm, sales

ITEMS = ("order_id string, product_id string, seller_id string, seller_city string, seller_state string, "
         "product_category string, item_revenue double, item_freight double")
ORDERS = ("order_id string, is_delivered boolean, is_late boolean, delivery_days double, "
          "delivery_delay_days double, average_review_score double")


def test_unknown_category(spark):
    items = spark.createDataFrame([(None, 0.1), ("a", 1.0), (None, 0.2)], "product_category string, item_revenue double")
    assert [tuple(r) for r in sales.revenue_by_category(items).collect()] == [("a", 1.0), ("Unknown", 0.3)]


def test_missing_category_is_a_group(spark):
    items = spark.createDataFrame(
        [("o1", "p1", None, 1.0), ("o1", "p2", None, 2.0), ("o2", "p1", "a", 5.0)],
        "order_id string, product_id string, product_category string, price double").selectExpr(
        "*", "price item_revenue", "0.5D item_freight", "price + 0.5D item_total_value", "0.25D freight_ratio")
    rows = products.category_performance(items).collect()
    assert [(r.product_category, r.orders, r.order_items, r.unique_products, r.revenue, r.average_item_price)
            for r in rows] == [("a", 1, 1, 1, 5.0, 5.0), (None, 1, 2, 2, 3.0, 1.5)]


def test_seller_means_are_at_item_grain(spark):
    items = spark.createDataFrame(
        [("o1", "p", "s", "c", "S", "k", 1.0, 0.0)] * 3 + [("o2", "p", "s", "c", "S", "k", 1.0, 0.0)]
        + [("gone", "p", "s", "c", "S", "k", 9.0, 0.0)], ITEMS)
    orders = spark.createDataFrame(
        [("o1", True, True, 6.0, 1.0, 5.0), ("o2", True, False, 2.0, -1.0, None)], ORDERS)
    row = operations.seller_delivery_performance(items, orders).first()
    assert (row.average_delivery_days, row.orders, row.late_orders, row.late_delivery_rate, row.revenue,
            row.average_review_score) == (5.0, 2, 1, 50.0, 4.0, 5.0)
    state = operations.seller_state_operations(items, orders).first()
    assert (state.sellers, state.orders, state.late_orders, state.average_delivery_days) == (1, 2, 1, 5.0)


def test_one_order_holding_a_third_of_all_items(spark):
    """A hot order and a hot seller change nothing in the result."""
    items = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('o', id)) order_id", "concat('p', id % 7) product_id",
        "concat('s', id % 5) seller_id", "'c' seller_city", "'S' seller_state", "'k' product_category",
        "1.0D item_revenue", "0.5D item_freight")
    orders = items.select("order_id").distinct().selectExpr(
        "order_id", "true is_delivered", "order_id = 'hot' is_late", "if(order_id = 'hot', 3.0D, 1.0D) delivery_days",
        "0.0D delivery_delay_days", "4.0D average_review_score")
    want = (items.join(orders, "order_id").groupBy("seller_id")
            .agg(F.count_distinct("order_id").alias("orders"), F.round(F.avg("delivery_days"), 2).alias("days")))
    got = operations.seller_delivery_performance(items, orders)
    pairs = got.join(want, "seller_id").select(got.orders, want.orders, "average_delivery_days", "days").collect()
    assert len(pairs) == 5 and all(r[0] == r[1] and r[2] == r[3] for r in pairs)


def test_scores_round_half_to_even(spark):
    df = spark.createDataFrame([(1.5,), (2.5,), (3.5,), (4.5,), (None,)], "average_review_score double")
    assert [tuple(r) for r in operations.review_score_distribution(df).collect()] == [(2, 2), (4, 2)]


def test_summary_median_and_rate(spark):
    df = spark.createDataFrame([
        (True, False, False, 1.0, 5.0, -1.0, False), (True, False, False, 2.0, 5.0, 1.0, True),
        (True, False, False, 4.01, 5.0, 1.0, True), (True, False, False, 10.0, 5.0, 1.0, True),
        (True, False, False, None, 5.0, None, None), (False, True, False, 99.0, 5.0, 9.0, True),
    ], "is_delivered boolean, is_canceled boolean, is_unavailable boolean, delivery_days double, "
       "estimated_delivery_days double, delivery_delay_days double, is_late boolean")
    row = operations.operations_summary(df).first()
    assert (row.total_orders, row.delivered_orders, row.canceled_orders, row.average_delivery_days,
            row.median_delivery_days, row.late_delivered_orders, row.on_time_delivered_orders,
            row.late_delivery_rate) == (6, 5, 1, 4.25, 3.01, 3, 1, 75.0)
    empty = operations.operations_summary(df.limit(0)).first()
    assert (empty.total_orders, empty.average_delivery_days, empty.late_delivery_rate) == (0, None, None)


def test_delivery_status_order(spark):
    df = spark.createDataFrame(
        [(None, None, None, False, True, 0.5), (False, 4.0, 2.0, True, True, 0.25), (True, 1.0, 9.0, True, False, 1.0)],
        "is_late boolean, average_review_score double, delivery_days double, is_delivered boolean, has_items boolean, "
        "freight_ratio double")
    rows = operations.delivery_review_performance(df).collect()
    assert [(r.delivery_status, r.reviewed_orders, r.average_freight_ratio) for r in rows] == [
        ("Late", 1, None), ("On Time", 1, 0.25), ("Unknown", 0, 0.5)]


def test_dates(spark):
    orders = spark.createDataFrame(
        [(dt.date(2016, 12, 31),), (dt.date(2017, 1, 2),), (None,)], "order_purchase_date date")
    rows = calendar.dim_date(orders).collect()
    assert [(r.date, r.day_of_week, r.is_weekend, r.week_number, r.quarter, r.year_month) for r in rows] == [
        (dt.date(2016, 12, 31), 6, True, 52, 4, "2016-12"), (dt.date(2017, 1, 1), 0, True, 52, 1, "2017-01"),
        (dt.date(2017, 1, 2), 1, False, 1, 1, "2017-01")]
    # A day that the session zone starts at 01:00 is still one day.
    gap = spark.createDataFrame([(dt.date(2017, 10, 14),), (dt.date(2017, 10, 16),)], "order_purchase_date date")
    assert [r.day_name for r in calendar.dim_date(gap).collect()] == ["Saturday", "Sunday", "Monday"]


def test_segments(spark):
    cases = {(5, 4, 4): "Champions", (4, 5, 3): "Loyal Customers", (5, 2, 5): "Loyal Customers",
             (4, 1, 5): "Recent Customers", (2, 5, 4): "At Risk High Value", (1, 2, 3): "At Risk Repeat",
             (2, 1, 3): "Hibernating", (3, 1, 4): "High Value", (3, 5, 3): "Other"}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()],
                               "recency_score bigint, frequency_score bigint, monetary_score bigint, want string")
    rows = rfm.rfm_segment(df).collect()
    assert [r.customer_segment for r in rows] == [r.want for r in rows]
    assert rows[0].rfm_score == "544"


def test_rfm_with_a_fixed_reference_date(spark):
    at = dt.datetime(2018, 10, 7, 23, 0)
    df = spark.createDataFrame([("x", 7, at, at, 1.0)], "customer_unique_id string, order_count bigint, "
                               "first_order_date timestamp_ntz, last_order_date timestamp_ntz, total_product_revenue double")
    row = rfm.customer_rfm(df, dt.date(2018, 10, 17)).first()
    assert (row.recency, row.frequency_score, row.recency_score, row.rfm_score) == (10, 5, 1, "151")


def test_distinct_counts_copy_no_row_and_keep_null_groups(spark):
    items = spark.createDataFrame(
        [("o1", "p", "s", 1.0), ("o1", "p", "t", 2.0), (None, "p", None, 3.0), ("o2", None, "s", 4.0), (None, None, None, 5.0)],
        "order_id string, product_id string, seller_id string, price double").selectExpr(
        "*", "'k' product_category", "'K' product_category_name_english", "'c' seller_city", "'S' seller_state",
        "price item_revenue", "0.5D item_freight", "price + 0.5D item_total_value", "0.25D freight_ratio")
    df = products.product_performance(items)
    assert {r.product_id: (r.orders, r.sellers, r.order_items, r.revenue) for r in df.collect()} == {
        "p": (1, 2, 3, 6.0), None: (1, 1, 2, 9.0)}
    assert {r.seller_id: (r.orders, r.unique_products) for r in products.seller_performance(items).collect()} == {
        "s": (2, 1), "t": (1, 1), None: (0, 1)}
    for mart in (products.category_performance, products.product_performance, products.seller_performance,
                 products.seller_state_performance):
        assert "Expand" not in mart(items)._jdf.queryExecution().executedPlan().toString()


def test_a_seller_is_counted_in_few_places(spark):
    """A seller's orders meet in a fixed number of pieces, not in every task, each of which would send a row for it."""
    items = spark.range(4000).selectExpr(
        "concat('o', id % 900) order_id", "concat('p', id % 70) product_id", "if(id % 3 = 0, 'hot', concat('s', id % 5)) seller_id",
        "if(id % 3 = 0, 'c', 'd') seller_city", "if(id % 3 = 0, 'S', 'T') seller_state", "if(id % 2 > 0, 'k', null) product_category",
        "if(id % 2 > 0, 'K', null) product_category_name_english", "1.5D price", "1.5D item_revenue", "0.5D item_freight", "2.0D item_total_value", "0.25D freight_ratio")
    for mart, keys, distinct in (
        (products.seller_performance, ["seller_id"], {"orders": "order_id", "unique_products": "product_id"}),
        (products.product_performance, ["product_id", "product_category"], {"orders": "order_id", "sellers": "seller_id"}),
        (products.seller_category_performance, ["seller_id", "product_category"], {"orders": "order_id"}),
    ):
        df = mart(items)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count(", piece#") and "order_id#" not in "".join(re.findall(r"hashpartitioning\((.*?)\)", plan))
        want = items.groupBy(*keys).agg(*[F.count_distinct(c).alias(n) for n, c in distinct.items()], F.sum("item_revenue").alias("revenue"))
        columns = [*keys, *distinct, "revenue"]
        assert df.select(columns).exceptAll(want.select(columns)).count() == 0 and df.count() == want.count()


def test_category_operations_sends_narrow_pairs(spark):
    items = spark.createDataFrame(
        [("o1", None, 1.0), ("o1", None, 2.0), ("o2", "a", 4.0), (None, "a", 8.0), (None, "b", 0.0)],
        "order_id string, product_category string, price double").selectExpr(
        "*", "price item_revenue", "price / 2 item_freight", "price * 1.5 item_total_value", "0.5D freight_ratio")
    df = operations.category_operations(items)
    assert [(r.product_category, r.orders, r.order_items, r.revenue, r.freight, r.freight_to_revenue_ratio) for r in df.collect()] == [
        ("a", 1, 2, 12.0, 6.0, 0.5), (None, 1, 2, 3.0, 1.5, 0.5), ("b", 0, 1, 0.0, 0.0, None)]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    pairs = next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    assert "order_id" in pairs and "item_revenue" not in pairs


def test_states_of_sellers_from_one_exchange_of_the_items(spark):
    """Orders, lateness and sellers of a state, with gaps, an order of two sellers and states, and an order that comes twice."""
    items = spark.createDataFrame(
        [("o1", "s1", "A", 1.0), ("o1", "s1", "A", 2.0), ("o1", "s2", "A", 4.0), ("o1", "s3", "B", 8.0), ("o2", "s2", "A", 16.0),
         ("o2", None, None, 32.0), ("o3", None, "B", 64.0), ("gone", "s9", "A", 128.0), (None, "s8", "A", 256.0)],
        "order_id string, seller_id string, seller_state string, item_revenue double").selectExpr("*", "0.25D item_freight")
    orders = spark.createDataFrame(
        [("o1", True, True, 6.0, 1.0, 5.0), ("o2", True, False, 2.0, -1.0, None), ("o3", False, None, 9.0, None, 3.0),
         ("o3", True, True, 4.0, 1.0, 3.0), (None, True, True, 1.0, 1.0, 1.0)], ORDERS)
    df = operations.seller_state_operations(items, orders)
    assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 1
    assert [tuple(r) for r in df.collect()] == [
        ("B", 1, 3, 136.0, 0.75, 5.0, 2, 100.0), (None, 0, 1, 32.0, 0.25, 2.0, 0, 0.0), ("A", 2, 2, 23.0, 1.0, 5.0, 1, 50.0)]
    assert len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_seller_sums_stay_exact_in_two_steps(spark):
    items = spark.createDataFrame(
        [("o1", "s", "c", "S", 9e14 + 0.25), ("o1", "s", "c", "S", 0.01), ("o2", "s", "d", "S", 9e14 + 0.5), ("o2", "s", "d", "S", 1e15)],
        "order_id string, seller_id string, seller_city string, seller_state string, item_revenue double").selectExpr("*", "0.0D item_freight")
    orders = spark.createDataFrame([("o1", True, True, 0.1, 1.0, 4.33), ("o2", True, False, 0.2, -1.5, None)], ORDERS)
    row = operations.seller_delivery_performance(items, orders).first()
    assert (row.seller_city, row.revenue, row.average_delivery_days, row.average_delivery_delay_days, row.average_review_score) == (
        "d", 1.8e15 + 0.75, 0.15, -0.25, 4.33)
