"""Cleaned tables -> star schema: two facts, three per-order aggregates, customers.

Join sides are never hinted: Catalyst and AQE broadcast a side whose measured size
is below the session's threshold and sort-merge it otherwise, and AQE splits skewed
sort-merge partitions.  Facts can be built without the parts a mart does not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shopmill.functions import exprs as X
from shopmill.operators.cleaning import DERIVED_ORDER_COLUMNS, LIFECYCLE_TIMES, derive_orders


# --- item grain -------------------------------------------------------------------

def product_category_fallback(df: DataFrame) -> DataFrame:
    """Translated name where there is one, else the original; nothing is invented."""
    return df.withColumn(
        "product_category", F.coalesce("product_category_name_english", "product_category_name"))


def add_products(df: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Add product columns and the translated category, by product_id.

    The two small tables are joined one after the other rather than with each other
    first: Spark guesses the size of a join as the product of its sides, and would
    then shuffle the items instead of broadcasting the products.
    """
    attributes = products.select(
        "product_id", "product_category_name", "product_weight_g",
        "product_length_cm", "product_height_cm", "product_width_cm")
    return (
        df.join(attributes, "product_id", "left")
        .join(translation, "product_category_name", "left")
        .transform(product_category_fallback)
    )


def add_sellers(df: DataFrame, sellers: DataFrame) -> DataFrame:
    """Add seller columns, by seller_id."""
    return df.join(
        sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"), "seller_id", "left")


def item_measures(items: DataFrame) -> DataFrame:
    revenue = X.round_half_even("price", 2)
    freight = X.round_half_even("freight_value", 2)
    return items.withColumns({
        "item_revenue": revenue,
        "item_freight": freight,
        "item_total_value": X.round_half_even(revenue + freight, 2),
    })


def fact_order_items(
    items: DataFrame,
    products: DataFrame | None = None,
    translation: DataFrame | None = None,
    sellers: DataFrame | None = None,
) -> DataFrame:
    """Item fact; without `products` or `sellers` their columns are left out."""
    out = items
    if products is not None:
        out = add_products(out, products, translation)
    if sellers is not None:
        out = add_sellers(out, sellers)
    return item_measures(out)


# --- order grain --------------------------------------------------------------------

def _distinct_values(column: str):
    """Aggregate: number of distinct values, for groups whose values fit a task (those of one order)."""
    return F.size(F.collect_set(column)).cast("bigint")


def agg_order_items(items: DataFrame) -> DataFrame:
    """Item aggregate, from one exchange of the items' narrow columns.

    An order has a few items: combining them on the map side, or expanding them for two distinct
    counts, would fill every map task with groups of one row.  A hot order is streamed by one task,
    which keeps its distinct products and sellers.
    """
    numbered = F.col("order_item_id").isNotNull()
    measured = items.where(F.col("order_id").isNotNull()).select(
        "order_id", numbered.alias("numbered"), "product_id", "seller_id",
        "item_revenue", "item_freight", "item_total_value")
    return (
        measured.repartition("order_id")
        .groupBy("order_id")
        .agg(
            F.count_if("numbered").alias("item_count"),
            _distinct_values("product_id").alias("unique_products"),
            _distinct_values("seller_id").alias("unique_sellers"),
            F.coalesce(X.exact_sum("item_revenue"), F.lit(0.0)).alias("product_revenue"),
            F.coalesce(X.exact_sum("item_freight"), F.lit(0.0)).alias("freight_value"),
            F.coalesce(X.exact_sum("item_total_value"), F.lit(0.0)).alias("order_item_total_value"),
        )
    )


def payment_types(payment_type="payment_type"):
    """Aggregate: sorted distinct types joined by ' | ', '' when all are NULL.

    The set per order is bounded by the number of payment types, whatever the
    number of payments, and is merged on the map side.
    """
    return F.array_join(F.sort_array(F.collect_set(payment_type)), " | ")


def agg_order_payments(payments: DataFrame) -> DataFrame:
    return (
        payments.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.count("payment_sequential").alias("payment_count"),
            # Payments are not rounded when cleaned: the sum is, once.
            F.coalesce(X.round_half_even(X.exact_sum("payment_value", 8), 2), F.lit(0.0)).alias("total_payment_value"),
            F.max("payment_installments").alias("max_payment_installments"),
            payment_types().alias("payment_types"),
        )
    )


def agg_order_reviews(reviews: DataFrame) -> DataFrame:
    score = F.col("review_score")
    mean = F.sum(score) / F.nullif(F.count(score), F.lit(0)).cast("double")
    return (
        reviews.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            F.count("review_id").alias("review_count"),
            X.round_half_even(mean, 2).alias("average_review_score"),
            F.min(score).alias("min_review_score"),
            F.max(score).alias("max_review_score"),
            F.count_if("has_review_comment").alias("review_comment_count"),
        )
    )


def order_freight_ratio(orders: DataFrame) -> DataFrame:
    return orders.withColumn("freight_ratio", X.ratio("freight_value", "product_revenue", 4))


def revenue_payment_difference(orders: DataFrame) -> DataFrame:
    difference = F.col("total_payment_value") - F.col("order_item_total_value")
    return orders.withColumn("revenue_payment_difference", X.round_half_even(difference, 2))


def order_presence_flags(orders: DataFrame) -> DataFrame:
    counts = {"has_items": "item_count", "has_payment": "payment_count", "has_review": "review_count"}
    return orders.withColumns({
        flag: F.col(count).isNotNull() for flag, count in counts.items() if count in orders.columns})


def fact_orders(
    orders: DataFrame,
    customers: DataFrame | None = None,
    items_agg: DataFrame | None = None,
    payments_agg: DataFrame | None = None,
    reviews_agg: DataFrame | None = None,
) -> DataFrame:
    """Order fact; the columns of parts not passed are left out.

    Customers come first, while the order row is still narrow.  The aggregates are
    already partitioned by order, so the three joins share one exchange of orders.
    Columns of cleaned orders that follow from the status and the times are derived again
    behind the joins, so that no exchange carries them.
    """
    derived = [c for c in orders.columns if c in DERIVED_ORDER_COLUMNS]
    again = set(orders.columns) >= {*DERIVED_ORDER_COLUMNS, "order_status", *LIFECYCLE_TIMES} and any(
        part is not None for part in (customers, items_agg, payments_agg, reviews_agg))
    out = orders.drop(*derived) if again else orders
    if customers is not None:
        out = out.join(
            customers.select("customer_id", "customer_unique_id", "customer_zip_code_prefix",
                             "customer_city", "customer_state"),
            "customer_id", "left")
    for part in (items_agg, payments_agg, reviews_agg):
        if part is not None:
            out = out.join(part, "order_id", "left")
    if again:
        own = [c for c in out.columns if c in orders.columns]
        out = derive_orders(out).select(*own, *derived, *[c for c in out.columns if c not in own])
    if items_agg is not None:
        out = order_freight_ratio(out)
        if payments_agg is not None:
            out = revenue_payment_difference(out)
    return order_presence_flags(out)


# --- person grain ---------------------------------------------------------------------

def customer_profile(customers: DataFrame) -> DataFrame:
    """Address of the person's greatest customer_id (text order, not the newest)."""
    return (
        customers.groupBy("customer_unique_id")
        .agg(F.max_by(
            F.struct("customer_zip_code_prefix", "customer_city", "customer_state"), "customer_id",
        ).alias("profile"))
        .select("customer_unique_id", "profile.*")
    )


def customer_orders(orders: DataFrame) -> DataFrame:
    """Order history per person; orders hold one row per order_id (guarded)."""
    return (
        orders.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            F.count("order_id").alias("order_count"),
            F.min("order_purchase_timestamp").alias("first_order_date"),
            F.max("order_purchase_timestamp").alias("last_order_date"),
            F.coalesce(X.exact_sum("product_revenue"), F.lit(0.0)).alias("total_product_revenue"),
            F.coalesce(X.exact_sum("freight_value"), F.lit(0.0)).alias("total_freight"),
            F.coalesce(X.exact_sum("order_item_total_value"), F.lit(0.0)).alias("total_order_value"),
            X.round_half_even(X.exact_mean("order_item_total_value"), 2).alias("average_order_value"),
        )
    )


def dim_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return customer_orders(orders).join(customer_profile(customers), "customer_unique_id", "left")
