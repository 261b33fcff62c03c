"""Product and seller marts over the item fact.

Every distinct count is an aggregate of its own over (group, value) pairs that are
partitioned by both: a hot group is spread over all tasks and only partial counts meet.
Where groups are many (sellers, products), a group is spread over a fixed number of pieces
instead, so that the partial counts are few and do not grow with the number of tasks.
Several distinct counts in one aggregate would copy every row and its measures for each of
them, and map tasks would spill groups of one row.  Marts with one row per entity are not
sorted; a stored table has no order, and sorting it would be a needless exchange.

Marts with one row per product or seller take items without those columns and a
function that attaches them by id: it runs on the finished rows, so no wide text
travels with the items and no dimension meets the whole fact.  Without it, the
items are those of a stored fact and hold the columns already.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shopmill.functions import exprs as X

#: In how many places the distinct values of one seller, or of one of many smaller groups, are counted.
SELLER_PIECES, FINE_PIECES = 64, 8

#: Adds the columns of products or sellers to rows that hold their id.
Attach = Callable[[DataFrame], DataFrame]


def volume() -> Column:
    return F.count(F.lit(1)).alias("order_items")


def grouped(
    items: DataFrame, keys: list[str], distinct: dict[str, str], measures: list[Column],
    fine: bool = False, pieces: int | None = None,
) -> DataFrame:
    """Distinct values of columns (by name of the count) and measures of every group; NULL is a group.

    `fine` says that there are many groups of few rows: their items meet before they are combined.  `pieces` is for
    groups that are many in number: the values of one are counted in so many places at most, and not in every task, each of
    which would send a row of its own for nearly every group.  The parts are put side by side by the group, without a join.
    """
    narrow = items.repartition(*keys) if fine else items
    parts = [narrow.groupBy(*keys).agg(*measures)]
    for name, column in distinct.items():
        pairs = items.select(*keys, column).where(F.col(column).isNotNull())
        if pieces is None:
            pairs = pairs.repartition(*keys, column)
        else:
            pairs = pairs.withColumn("piece", F.pmod(F.xxhash64(column), F.lit(pieces)).cast("smallint")).repartition(*keys, "piece")
        parts.append(pairs.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name)))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = [F.coalesce(F.max(name), F.lit(0)).alias(name) for name in distinct]
    return stacked.groupBy(*keys).agg(*counts, *[F.max(c).alias(c) for c in parts[0].columns if c not in keys])


def _revenue_and_freight() -> list[Column]:
    return [X.exact_sum("item_revenue").alias("revenue"), X.exact_sum("item_freight").alias("freight")]


def _total() -> Column:
    return X.exact_sum("item_total_value").alias("total_value")


def _average_price(name: str) -> Column:
    return X.round_half_away(X.exact_mean("price", 4), 2).alias(name)


def _average_value() -> Column:
    return X.round_half_away(X.exact_mean("item_total_value"), 2).alias("average_item_value")


def _average_ratio(name: str = "average_freight_ratio") -> Column:
    return X.round_half_away(X.exact_mean("freight_ratio", 4), 4).alias(name)


def category_performance(items: DataFrame) -> DataFrame:
    """Items without a category form a group of their own."""
    return grouped(
        items, ["product_category"], {"orders": "order_id", "unique_products": "product_id"},
        [volume(), *_revenue_and_freight(), _total(),
         _average_price("average_item_price"), _average_value(), _average_ratio()],
    ).orderBy(F.desc("revenue"), "product_category")


def _per_entity(
    items: DataFrame, key: str, attributes: list[str], attach: Attach | None,
    distinct: dict[str, str], measures: list[Column], fine: bool, pieces: int,
) -> DataFrame:
    if attach is None:
        return grouped(items, [key, *attributes], distinct, measures, fine, pieces)
    rows = grouped(items, [key], distinct, measures, fine, pieces)
    return attach(rows).select(key, *attributes, *[c for c in rows.columns if c != key])


def product_performance(items: DataFrame, attach: Attach | None = None) -> DataFrame:
    return _per_entity(
        items, "product_id", ["product_category", "product_category_name_english"], attach,
        {"orders": "order_id", "sellers": "seller_id"},
        [volume(), *_revenue_and_freight(), _total(),
         _average_price("average_price"), _average_value(), _average_ratio()], True, FINE_PIECES)


def seller_performance(items: DataFrame, attach: Attach | None = None) -> DataFrame:
    return _per_entity(
        items, "seller_id", ["seller_city", "seller_state"], attach,
        {"orders": "order_id", "unique_products": "product_id"},
        [volume(), *_revenue_and_freight(), _total(),
         _average_price("average_item_price"), _average_value(), _average_ratio()], False, SELLER_PIECES)


def seller_category_performance(items: DataFrame) -> DataFrame:
    return grouped(
        items, ["seller_id", "seller_state", "product_category"], {"orders": "order_id"},
        [volume(), *_revenue_and_freight(), _average_price("average_item_price")], True, FINE_PIECES)


def seller_state_performance(items: DataFrame) -> DataFrame:
    return grouped(
        items, ["seller_state"], {"sellers": "seller_id", "orders": "order_id"},
        [volume(), *_revenue_and_freight(), _total(), _average_value(), _average_ratio()],
    ).orderBy(F.desc("revenue"), "seller_state")


# --- reports: top ten by revenue, the key breaks ties -------------------------------

def top_categories(performance: DataFrame, limit: int = 10) -> DataFrame:
    return (
        performance.select("product_category", "orders", "order_items", "unique_products", "revenue")
        .orderBy(F.desc("revenue"), "product_category").limit(limit)
    )


def top_products(performance: DataFrame, limit: int = 10) -> DataFrame:
    return (
        performance.select("product_id", "product_category", "orders", "order_items", "revenue")
        .orderBy(F.desc("revenue"), "product_id").limit(limit)
    )


def top_sellers(performance: DataFrame, limit: int = 10) -> DataFrame:
    return (
        performance.select("seller_id", "seller_state", "orders", "order_items", "unique_products", "revenue")
        .orderBy(F.desc("revenue"), "seller_id").limit(limit)
    )
