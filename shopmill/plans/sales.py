"""Sales queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shopmill.functions import exprs as X


def total_product_revenue(items: DataFrame) -> DataFrame:
    return items.agg(X.exact_sum("item_revenue").alias("total_product_revenue"))


def total_orders(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count(F.lit(1)).alias("total_orders"))


def unique_customers(customers: DataFrame) -> DataFrame:
    return customers.agg(F.count(F.lit(1)).alias("unique_customers"))


def average_order_value(items_agg: DataFrame) -> DataFrame:
    """Revenue per order that has items."""
    orders = F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double")
    return items_agg.agg(
        X.round_half_away(X.exact_sum("product_revenue") / orders, 2).alias("average_order_value"))


def monthly_revenue(orders: DataFrame, items_agg: DataFrame) -> DataFrame:
    return (
        orders.join(items_agg.select("order_id", F.col("product_revenue").alias("revenue")), "order_id")
        .groupBy(X.month_start("order_purchase_timestamp").alias("month"))
        .agg(X.exact_sum("revenue").alias("monthly_revenue"))
        .orderBy(F.asc_nulls_last("month"))
    )


def monthly_order_volume(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy(X.month_start("order_purchase_timestamp").alias("month"))
        .agg(F.count(F.lit(1)).alias("monthly_orders"))
        .orderBy(F.asc_nulls_last("month"))
    )


def revenue_by_category(items: DataFrame) -> DataFrame:
    return (
        items.groupBy(F.coalesce("product_category", F.lit("Unknown")).alias("category"))
        .agg(X.exact_sum("item_revenue").alias("category_revenue"))
        .orderBy(F.desc("category_revenue"), "category")
    )


def revenue_by_state(orders: DataFrame) -> DataFrame:
    return (
        orders.where("has_items")
        .groupBy(F.col("customer_state").alias("state"))
        .agg(X.exact_sum("product_revenue").alias("state_revenue"))
        .orderBy(F.desc("state_revenue"), "state")
    )
