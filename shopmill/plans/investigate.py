"""Row-level extracts behind the audit findings."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from shopmill.functions import exprs as X
from shopmill.operators.cleaning import LIFECYCLE_TIMES
from shopmill.operators.guards import duplicate_keys, rows_with_repeated_hash
from shopmill.plans.checks import one_row, row_count, union_all
from shopmill.plans.quality import DATE_RULES

ITEM_KEY = ("order_id", "order_item_id")
# The columns that make two item rows the same item.
ITEM_IDENTITY = (
    "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value")

# Approval before purchase is counted by the audit but not extracted.
EXTRACTED_RULES = tuple(rule for rule in DATE_RULES if rule[0] != "approved_before_purchase")


def invalid_payment_installments(payments: DataFrame) -> DataFrame:
    return payments.where(X.to_number("payment_installments") <= 0)


# --- date sequences -------------------------------------------------------------------

def invalid_date_sequences(orders: DataFrame) -> DataFrame:
    """One row per order and violated rule, found in a single pass."""
    parsed = orders.select("order_id", "order_status", *[X.to_time(c).alias(c) for c in LIFECYCLE_TIMES])
    broken = F.array_compact(F.array(*[
        F.when(F.col(first) < F.col(second), F.lit(name)) for name, first, second in EXTRACTED_RULES]))
    return parsed.select("*", F.explode(broken).alias("anomaly_type"))


def anomaly_counts_by_type(sequences: DataFrame) -> DataFrame:
    return (
        sequences.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("orders"), "anomaly_type")
    )


def anomaly_counts_by_status(sequences: DataFrame) -> DataFrame:
    return (
        sequences.groupBy("anomaly_type", "order_status").agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("anomaly_type", "order_status")
    )


# --- orders without children --------------------------------------------------------------

def orders_without(orders: DataFrame, children: DataFrame) -> DataFrame:
    """Orders no child row refers to; an order with a NULL id is kept."""
    # One child row per order is enough; the reduction uses the exchange the join needs.
    present = children.select("order_id").distinct()
    return orders.join(present, "order_id", "left_anti").select(*orders.columns)


def status_distribution(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))
        .orderBy(F.desc("orders"), "order_status")
    )


# --- reviews --------------------------------------------------------------------------------

def multiple_reviews_per_order(reviews: DataFrame) -> DataFrame:
    return (
        reviews.where(F.col("order_id").isNotNull())
        .groupBy("order_id").agg(F.count(F.lit(1)).alias("review_count"))
        .where("review_count > 1")
    )


def review_count_distribution(repeated: DataFrame) -> DataFrame:
    return repeated.groupBy("review_count").agg(F.count(F.lit(1)).alias("orders")).orderBy("review_count")


# --- business keys -----------------------------------------------------------------------------

def _rows_sharing(items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """All rows whose key occurs more than once (NULL equals NULL).

    Keys are counted with map-side combine and the repeated ones joined back, so
    no task has to hold all rows of one key, as a window over the key would.
    """
    repeated = duplicate_keys(items, *keys).select(*[F.col(k).alias(f"dup_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"dup_{k}")) for k in keys])
    return items.join(repeated, same, "left_semi")


def order_item_key_duplicates(items: DataFrame) -> DataFrame:
    return _rows_sharing(items, ITEM_KEY)


def order_item_duplicate_key_groups(items: DataFrame) -> DataFrame:
    """Repeated keys and their size; keys with a NULL part are left out of the groups."""
    complete = items.where(F.col("order_id").isNotNull() & F.col("order_item_id").isNotNull())
    return duplicate_keys(complete, *ITEM_KEY)


def transactional_duplicates(items: DataFrame) -> DataFrame:
    return _rows_sharing(items, ITEM_IDENTITY)


def business_key_summary(items: DataFrame) -> DataFrame:
    checks = {"order_id + order_item_id uniqueness": ITEM_KEY, "full transactional identity uniqueness": ITEM_IDENTITY}
    rows = row_count(items, "rows")
    reports = []
    for name, keys in checks.items():
        complete = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        sizes = duplicate_keys(rows_with_repeated_hash(items, *keys), *keys).agg(
            F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("duplicate_rows"),
            F.count_if(F.expr(complete)).alias("duplicate_groups"))
        reports.append(one_row(rows, sizes).select(
            F.lit(name).alias("check"), "rows", "duplicate_rows", "duplicate_groups"))
    return union_all(reports)
