"""Raw tables -> typed, trimmed tables with derived columns.

Each function is a projection: no exchange, no action.  Input columns may be text
(raw CSV) or already typed; conversions of typed columns are dropped by Catalyst.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from shopmill.functions import exprs as X
from shopmill.sources.lazy import LazyTables

LIFECYCLE_TIMES = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
)

# (flag, earlier event, later event): the flag is set when the order is reversed.
LIFECYCLE_FLAGS = (
    ("flag_carrier_before_purchase", "order_delivered_carrier_date", "order_purchase_timestamp"),
    ("flag_carrier_before_approval", "order_delivered_carrier_date", "order_approved_at"),
    ("flag_delivery_before_carrier", "order_delivered_customer_date", "order_delivered_carrier_date"),
)


def clean_string(df: DataFrame, *columns: str) -> DataFrame:
    """Trim white space of any kind; NULL stays NULL."""
    return df.withColumns({c: X.strip(c) for c in columns})


def _typed(df: DataFrame, strings=(), times=(), numbers=(), wholes=()) -> DataFrame:
    convert = {c: X.strip_to_null for c in strings}
    convert |= {c: X.to_time for c in times}
    convert |= {c: X.to_number for c in numbers}
    convert |= {c: X.to_whole for c in wholes}
    return df.select(*[convert[c](c).alias(c) for c in df.columns if c in convert])


# --- orders -------------------------------------------------------------------

def order_calendar_fields(orders: DataFrame) -> DataFrame:
    day = F.to_date("order_purchase_timestamp")
    return orders.withColumns({
        "order_purchase_date": day,
        "order_purchase_year": F.year(day).cast("bigint"),
        "order_purchase_month": F.substring(day.cast("string"), 1, 7),
        "order_purchase_month_num": F.month(day).cast("bigint"),
        "order_purchase_day": F.dayofmonth(day).cast("bigint"),
        "order_purchase_weekday": F.date_format(day, "EEEE"),
    })


def order_status_flags(orders: DataFrame) -> DataFrame:
    return orders.withColumns({
        f"is_{status}": F.col("order_status") == status
        for status in ("delivered", "canceled", "unavailable")
    })


def delivery_durations(orders: DataFrame) -> DataFrame:
    spans = {
        "delivery_days": ("order_purchase_timestamp", "order_delivered_customer_date"),
        "estimated_delivery_days": ("order_purchase_timestamp", "order_estimated_delivery_date"),
        "delivery_delay_days": ("order_estimated_delivery_date", "order_delivered_customer_date"),
    }
    return orders.withColumns({
        name: X.round_half_even(X.days_between(start, end), 2) for name, (start, end) in spans.items()
    })


def late_flag(orders: DataFrame) -> DataFrame:
    """TRUE / FALSE from the rounded delay; NULL exactly when nothing was delivered."""
    late = F.coalesce(F.col("delivery_delay_days") > 0, F.lit(False))
    return orders.withColumn("is_late", F.when(F.col("order_delivered_customer_date").isNotNull(), late))


def lifecycle_anomaly_flags(orders: DataFrame) -> DataFrame:
    return orders.withColumns({
        flag: F.coalesce(F.col(first) < F.col(second), F.lit(False))
        for flag, first, second in LIFECYCLE_FLAGS
    })


def has_date_quality_issue(orders: DataFrame) -> DataFrame:
    any_flag = F.lit(False)
    for flag, _, _ in LIFECYCLE_FLAGS:
        any_flag = any_flag | F.coalesce(F.col(flag), F.lit(False))
    return orders.withColumn("has_date_quality_issue", any_flag)


def typed_orders(orders: DataFrame) -> DataFrame:
    return _typed(orders, strings=("order_id", "customer_id", "order_status"), times=LIFECYCLE_TIMES)


#: What `derive_orders` adds, from the order status and the lifecycle times alone.
DERIVED_ORDER_COLUMNS = (
    "order_purchase_date", "order_purchase_year", "order_purchase_month", "order_purchase_month_num",
    "order_purchase_day", "order_purchase_weekday", "is_delivered", "is_canceled", "is_unavailable",
    "delivery_days", "estimated_delivery_days", "delivery_delay_days", "is_late",
    *[flag for flag, _, _ in LIFECYCLE_FLAGS], "has_date_quality_issue",
)


def derive_orders(typed: DataFrame) -> DataFrame:
    return (
        typed
        .transform(order_calendar_fields)
        .transform(order_status_flags)
        .transform(delivery_durations)
        .transform(late_flag)
        .transform(lifecycle_anomaly_flags)
        .transform(has_date_quality_issue)
    )


def clean_orders(orders: DataFrame) -> DataFrame:
    return derive_orders(typed_orders(orders))


# --- the other tables ------------------------------------------------------------

def clean_order_items(items: DataFrame) -> DataFrame:
    typed = _typed(
        items,
        strings=("order_id", "product_id", "seller_id"),
        times=("shipping_limit_date",),
        numbers=("price", "freight_value"),
        wholes=("order_item_id",),
    )
    return typed.withColumns({
        "item_total_value": X.round_half_even(F.col("price") + F.col("freight_value"), 2),
        "freight_ratio": X.ratio("freight_value", "price", 4),
    })


def clean_payments(payments: DataFrame) -> DataFrame:
    typed = _typed(
        payments,
        strings=("order_id", "payment_type"),
        numbers=("payment_installments", "payment_value"),
        wholes=("payment_sequential",),
    )
    installments, value = F.col("payment_installments"), F.col("payment_value")
    return typed.withColumns({
        # Zero installments are not a plan: treated as missing, not repaired.
        "payment_installments": F.when(installments != 0, F.rint(installments).cast("bigint")),
        "has_valid_payment_value": F.coalesce(value >= 0, F.lit(False)),
    })


def clean_reviews(reviews: DataFrame) -> DataFrame:
    typed = _typed(
        reviews,
        strings=("review_id", "order_id", "review_comment_title", "review_comment_message"),
        times=("review_creation_date", "review_answer_timestamp"),
        wholes=("review_score",),
    )
    return typed.withColumn("has_review_comment", F.col("review_comment_message").isNotNull())


def clean_customers(customers: DataFrame) -> DataFrame:
    return _typed(customers, strings=(
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"))


def clean_products(products: DataFrame) -> DataFrame:
    return _typed(
        products,
        strings=("product_id", "product_category_name"),
        wholes=("product_name_lenght", "product_description_lenght", "product_photos_qty"),
        numbers=("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"),
    )


def clean_sellers(sellers: DataFrame) -> DataFrame:
    return _typed(sellers, strings=("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"))


def clean_geolocation(geolocation: DataFrame) -> DataFrame:
    """Typed only: repeated rows are kept."""
    return _typed(
        geolocation,
        strings=("geolocation_zip_code_prefix", "geolocation_city", "geolocation_state"),
        numbers=("geolocation_lat", "geolocation_lng"),
    )


def clean_category_translation(translation: DataFrame) -> DataFrame:
    return _typed(translation, strings=("product_category_name", "product_category_name_english"))


CLEANERS = {
    "orders": clean_orders,
    "order_items": clean_order_items,
    "payments": clean_payments,
    "reviews": clean_reviews,
    "customers": clean_customers,
    "products": clean_products,
    "sellers": clean_sellers,
    "geolocation": clean_geolocation,
    "translation": clean_category_translation,
}


def clean_all(raw: Mapping[str, DataFrame]) -> LazyTables:
    """Every raw table through its cleaner, in cleaning order, planned on first use."""
    return LazyTables({
        table: (lambda table=table, clean=clean: clean(raw[table])) for table, clean in CLEANERS.items()})
