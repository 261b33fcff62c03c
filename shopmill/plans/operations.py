"""Delivery, review and geography marts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from shopmill.functions import exprs as X
from shopmill.plans.products import grouped, volume

_LATE = "is_delivered AND is_late"
_KNOWN = "is_delivered AND is_late IS NOT NULL"


def _if_delivered(column: str) -> Column:
    return F.when(F.col("is_delivered"), F.col(column))


def _rate(late: Column, known: Column) -> Column:
    share = F.lit(100.0) * late.cast("double") / F.nullif(known, F.lit(0)).cast("double")
    return X.round_half_away(share, 2)


def _average(column: Column | str, digits: int = 2) -> Column:
    return X.round_half_away(X.exact_mean(column, digits), digits)


def _count(condition: str) -> Column:
    return F.count_if(F.expr(condition))


def _with_median_support(orders: DataFrame, keys: list[str], extra: list[Column]) -> DataFrame:
    """First level: one row per key and distinct delivery time (hundredths of a day).

    Everything a mart needs is carried as whole-number sums, so the second level,
    with its exact median, works on a table whose size no longer grows with orders.
    """
    level = orders.groupBy(*keys, X.as_units(_if_delivered("delivery_days")).alias("days_units")).agg(
        F.count(F.lit(1)).alias("orders"),
        _count("is_delivered").alias("delivered"),
        _count("is_canceled").alias("canceled"),
        _count("is_unavailable").alias("unavailable"),
        _count(_LATE).alias("late"),
        _count("is_delivered AND NOT is_late").alias("on_time"),
        F.sum(X.as_units(_if_delivered("estimated_delivery_days"))).alias("estimated_units"),
        F.count(_if_delivered("estimated_delivery_days")).alias("estimated_n"),
        F.sum(X.as_units(_if_delivered("delivery_delay_days"))).alias("delay_units"),
        F.count(_if_delivered("delivery_delay_days")).alias("delay_n"),
        *extra,
    )
    return level.withColumn("days_n", F.when(F.col("days_units").isNotNull(), F.col("orders")))


def _mean_of(units: str, n: str) -> Column:
    mean = F.sum(units).cast("double") / F.lit(100.0) / F.nullif(F.sum(n), F.lit(0)).cast("double")
    return X.round_half_away(mean, 2)


def _mean_days() -> Column:
    total = F.sum(F.col("days_units") * F.col("days_n"))
    return X.round_half_away(total.cast("double") / F.lit(100.0) / F.sum("days_n").cast("double"), 2)


def _median_days() -> Column:
    middle = F.percentile("days_units", F.lit(0.5), F.coalesce("days_n", F.lit(1).cast("bigint")))
    return X.round_half_away(middle / F.lit(100.0), 2)


def _late_share() -> Column:
    return _rate(F.sum("late"), F.sum(F.col("late") + F.col("on_time")))


def operations_summary(orders: DataFrame) -> DataFrame:
    return _with_median_support(orders, [], []).agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.coalesce(F.sum("delivered"), F.lit(0)).alias("delivered_orders"),
        F.coalesce(F.sum("canceled"), F.lit(0)).alias("canceled_orders"),
        F.coalesce(F.sum("unavailable"), F.lit(0)).alias("unavailable_orders"),
        _mean_days().alias("average_delivery_days"),
        _median_days().alias("median_delivery_days"),
        _mean_of("estimated_units", "estimated_n").alias("average_estimated_delivery_days"),
        _mean_of("delay_units", "delay_n").alias("average_delivery_delay_days"),
        F.coalesce(F.sum("late"), F.lit(0)).alias("late_delivered_orders"),
        F.coalesce(F.sum("on_time"), F.lit(0)).alias("on_time_delivered_orders"),
        _late_share().alias("late_delivery_rate"),
    )


def monthly_operations(orders: DataFrame) -> DataFrame:
    months = ("order_purchase_year", "order_purchase_month_num", "order_purchase_month")
    return (
        orders.groupBy(*months)
        .agg(
            F.count(F.lit(1)).alias("orders"),
            _count("is_delivered").alias("delivered_orders"),
            _average(_if_delivered("delivery_days")).alias("average_delivery_days"),
            _average(_if_delivered("delivery_delay_days")).alias("average_delivery_delay_days"),
            _count(_LATE).alias("late_orders"),
            _rate(_count(_LATE), _count(_KNOWN)).alias("late_delivery_rate"),
        )
        .orderBy(F.asc_nulls_last("order_purchase_year"), F.asc_nulls_last("order_purchase_month_num"))
    )


def customer_state_operations(orders: DataFrame) -> DataFrame:
    extra = [
        F.sum(F.when(F.col("has_items"), X.as_units("product_revenue"))).alias("revenue_units"),
        F.sum(X.as_units("average_review_score")).alias("score_units"),
        F.count("average_review_score").alias("score_n"),
    ]
    return (
        _with_median_support(orders, ["customer_state"], extra)
        .groupBy("customer_state")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("delivered").alias("delivered_orders"),
            (F.sum("revenue_units").cast("double") / F.lit(100.0)).alias("revenue"),
            _mean_days().alias("average_delivery_days"),
            _median_days().alias("median_delivery_days"),
            _mean_of("delay_units", "delay_n").alias("average_delivery_delay_days"),
            F.sum("late").alias("late_orders"),
            _late_share().alias("late_delivery_rate"),
            _mean_of("score_units", "score_n").alias("average_review_score"),
        )
        .orderBy(F.desc("revenue"), "customer_state")
    )


def delivery_review_performance(orders: DataFrame) -> DataFrame:
    """By delivery outcome, for orders of any status."""
    status = F.when(F.col("is_late"), "Late").when(~F.col("is_late"), "On Time").otherwise("Unknown")
    place = F.when(F.col("delivery_status") == "Late", 1).when(F.col("delivery_status") == "On Time", 2)
    return (
        orders.groupBy(status.alias("delivery_status"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.count("average_review_score").alias("reviewed_orders"),
            _average("average_review_score").alias("average_review_score"),
            _average(_if_delivered("delivery_days")).alias("average_delivery_days"),
            _average(F.when(F.col("has_items"), F.col("freight_ratio")), 4).alias("average_freight_ratio"),
        )
        .orderBy(F.coalesce(place, F.lit(3)))
    )


def review_score_distribution(orders: DataFrame) -> DataFrame:
    """Orders per average score, rounded half to even."""
    return (
        orders.where(F.col("average_review_score").isNotNull())
        .groupBy(F.rint("average_review_score").cast("int").alias("review_score"))
        .agg(F.count(F.lit(1)).alias("orders"))
        .orderBy("review_score")
    )


def category_operations(items: DataFrame) -> DataFrame:
    revenue, freight = X.exact_sum("item_revenue"), X.exact_sum("item_freight")
    return grouped(
        items, ["product_category"], {"orders": "order_id"},
        [volume(), revenue.alias("revenue"), freight.alias("freight"),
         X.round_half_away(freight / F.nullif(revenue, F.lit(0.0)), 4).alias("freight_to_revenue_ratio"),
         _average("freight_ratio", 4).alias("average_item_freight_ratio"),
         _average("item_total_value").alias("average_item_value")],
    ).orderBy(F.desc("revenue"), "product_category")


# --- seller marts: items joined with their orders --------------------------------------

SELLER_PLACE = ["seller_city", "seller_state"]


def _pairs_with_orders(
    items: DataFrame, orders: DataFrame, keys: list[str], first: list[str] | None = None,
) -> DataFrame:
    """One row per keys and order, carrying the number of items it stands for.

    Reducing the items before the join keeps an order with very many items from
    filling one join task, and makes 'distinct orders' a plain row count.  Means
    stay at item grain by weighting with `n`.  Items meet by order, where the join wants them: in
    the map tasks nearly every pair would be a group of one row.  `first` marks one row
    of each order and these keys, for counts of orders by fewer keys; the join needs that sort anyway.
    """
    narrow = items.select(*keys, "order_id", "item_revenue", "item_freight").repartition("order_id")
    parts = {name: X.whole_and_units(f"item_{name}") for name in ("revenue", "freight")}
    pairs = narrow.groupBy(*keys, "order_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.try_sum(part).alias(f"{name}_{which}") for name, found in parts.items()
          for which, part in zip(("whole", "units"), found)])
    if first is not None:
        pairs = pairs.withColumn(
            "first", F.row_number().over(Window.partitionBy("order_id", *first).orderBy(*[k for k in keys if k not in first])) == 1)
    outcome = orders.select(
        "order_id", "is_delivered", "is_late", "delivery_days", "delivery_delay_days",
        *[c for c in ("average_review_score",) if c in orders.columns])
    return pairs.join(outcome, "order_id")


def _revenue(name: str) -> Column:
    return X.total_of(F.col(f"{name}_whole"), F.col(f"{name}_units")).alias(name)


def _weighted(column: Column | str) -> Column:
    return X.round_half_away(X.exact_weighted_mean(column, "n"), 2)


def seller_delivery_performance(
    items: DataFrame, orders: DataFrame, attach: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per seller; sums per place first, so the large step is a hash aggregate.

    A maximum of a text needs a sort-based aggregate: it is taken over the few
    (seller, city, state) rows instead of over all pairs.  `attach` adds the place
    to rows with a seller_id; without it the items hold it already.
    """
    attributes = SELLER_PLACE if attach is None else []
    def parts(name: str, column: Column | str) -> list[Column]:
        value = F.col(column) if isinstance(column, str) else column
        whole, units = X.whole_and_units(value)
        return [F.try_sum(whole * F.col("n")).alias(f"{name}_whole"), F.try_sum(units * F.col("n")).alias(f"{name}_units"),
                F.sum(F.when(value.isNotNull(), F.col("n"))).alias(f"{name}_n")]

    def mean(name: str) -> Column:
        total = X.total_of(F.col(f"{name}_whole"), F.col(f"{name}_units"))
        return X.round_half_away(total / F.nullif(F.sum(f"{name}_n"), F.lit(0)).cast("double"), 2)

    places = _pairs_with_orders(items, orders, ["seller_id", *attributes]).groupBy("seller_id", *attributes).agg(
        F.count("order_id").alias("orders"),
        F.try_sum("revenue_whole").alias("revenue_whole"),
        F.try_sum("revenue_units").alias("revenue_units"),
        *parts("days", _if_delivered("delivery_days")),
        *parts("delay", _if_delivered("delivery_delay_days")),
        *parts("score", "average_review_score"),
        _count(_LATE).alias("late"),
        _count(_KNOWN).alias("known"),
    )
    if attach is not None:
        places = attach(places)
    return places.groupBy("seller_id").agg(
        F.max("seller_city").alias("seller_city"),
        F.max("seller_state").alias("seller_state"),
        F.sum("orders").alias("orders"),
        _revenue("revenue"),
        mean("days").alias("average_delivery_days"),
        mean("delay").alias("average_delivery_delay_days"),
        F.sum("late").alias("late_orders"),
        _rate(F.sum("late"), F.sum("known")).alias("late_delivery_rate"),
        mean("score").alias("average_review_score"),
    )


def seller_state_operations(items: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per state, from one exchange of the items: rows of (state, seller, order), of which each order's first counts it."""
    late, known = (F.count_if(F.col("first") & F.expr(condition)) for condition in (_LATE, _KNOWN))
    return (
        _pairs_with_orders(items, orders, ["seller_state", "seller_id"], first=["seller_state"])
        .groupBy("seller_state")
        .agg(
            F.count_distinct("seller_id").alias("sellers"),
            F.count_if("first").alias("orders"),
            _revenue("revenue"),
            _revenue("freight"),
            _weighted(_if_delivered("delivery_days")).alias("average_delivery_days"),
            late.alias("late_orders"),
            _rate(late, known).alias("late_delivery_rate"),
        )
        .orderBy(F.desc("revenue"), "seller_state")
    )


def top_customer_states(states: DataFrame, limit: int = 10) -> DataFrame:
    return (
        states.select("customer_state", "orders", "delivered_orders", "revenue",
                      "average_delivery_days", "late_delivery_rate", "average_review_score")
        .orderBy(F.desc("revenue"), "customer_state").limit(limit)
    )
