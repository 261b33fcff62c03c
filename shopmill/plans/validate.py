"""Reconciliation of cleaned tables, model and marts.

Every function returns check rows; `fail_on_failures` turns a report into a gate.
Measures of one table come from one aggregate, and one-row results are put side by
side by a union, so nothing is collected and nothing is cross-joined.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from shopmill.functions import exprs as X
from shopmill.operators.cleaning import CLEANERS, LIFECYCLE_FLAGS
from shopmill.operators.guards import fail_on_failures  # noqa: F401  (part of this API)
from shopmill.plans import keys as K
from shopmill.plans.checks import Check, check_rows, key_measures, key_sizes, one_row, row_count, union_all, verdict
from shopmill.plans.investigate import ITEM_IDENTITY, ITEM_KEY
from shopmill.plans.quality import FOREIGN_KEYS, PRIMARY_KEYS, REVIEW_SCORES, fk_measures, pk_measures

Tables = Mapping[str, DataFrame]
#: What was observed while tables were written: `rows` and the measures of `TABLE_MEASURES`.
Counted = Mapping[str, Mapping[str, int | float]]
COUNT = ("count",)

# The tables of the finished warehouse.
MODEL_TABLES = (
    "fact_order_items", "agg_order_items", "agg_order_payments", "agg_order_reviews",
    "fact_orders", "dim_customers",
)
PRODUCT_SELLER_MARTS = (
    "category_performance", "product_performance", "seller_performance",
    "seller_category_performance", "seller_state_performance",
)
OPERATIONS_MARTS = (
    "operations_summary", "monthly_operations", "customer_state_operations",
    "delivery_review_performance", "review_score_distribution", "category_operations",
    "seller_delivery_performance", "seller_state_operations",
)
CATALOG_TABLES = (*MODEL_TABLES, "customer_rfm", *PRODUCT_SELLER_MARTS, *OPERATIONS_MARTS, "dim_date")

# Business key of every model table.
GRAINS = {
    "fact_order_items": ITEM_KEY,
    "fact_orders": ("order_id",),
    "dim_customers": ("customer_unique_id",),
    "agg_order_items": ("order_id",),
    "agg_order_payments": ("order_id",),
    "agg_order_reviews": ("order_id",),
}


def _c(name: str) -> Column:
    return F.col(name)


def _total(column: str, digits: int = 2) -> Column:
    return F.coalesce(X.exact_sum(column, digits), F.lit(0.0))


def _close(a: str, b: str) -> Column:
    """Equal up to 1e-8 plus 1e-5 of the second value."""
    return F.abs(_c(a) - _c(b)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(_c(b))


def _exists(names: Collection[str], listed: Collection[str]) -> list[Check]:
    return [Check(f"{name} exists", verdict(F.lit(name in listed)), F.lit("")) for name in names]


def _zero(check: str, column: str, label: str, otherwise: str = "FAIL") -> Check:
    """Passes when the measure is 0; the measure is shown plainly."""
    return Check(check, verdict(_c(column) == 0, otherwise), X.text(label, _c(column)), _c(column))


def _rows(df_or_count: DataFrame | int, name: str, like: DataFrame) -> DataFrame:
    """One-row frame with an expected row count, given or taken from a table."""
    if isinstance(df_or_count, int):
        return like.agg(F.lit(df_or_count).cast("bigint").alias(name))
    return row_count(df_or_count, name)


# --- cleaned tables --------------------------------------------------------------------

def _availability(listed: Collection[str]) -> Check:
    missing = [t for t in CLEANERS if t not in listed]
    details = f"Not there: {missing}" if missing else "All there."
    return Check("Processed dataset availability", verdict(F.lit(not missing)), F.lit(details), F.lit(len(missing)))


def processed_tables_exist(measured: DataFrame, listed: Collection[str]) -> DataFrame:
    """`listed`: the cleaned tables that exist; `measured`: any one-row frame."""
    return check_rows(measured, [_availability(listed)], COUNT)


def row_count_comparison(raw: Tables, clean: Tables) -> DataFrame:
    """(table, raw_rows, processed_rows, difference, status)."""
    same = verdict(_c("raw_rows") == _c("processed_rows"))
    return union_all([
        one_row(row_count(raw[table], "raw_rows"), row_count(clean[table], "processed_rows")).select(
            F.lit(table).alias("table"), "raw_rows", "processed_rows",
            (_c("processed_rows") - _c("raw_rows")).alias("difference"), same.alias("status"))
        for table in CLEANERS])


def _preservation_checks() -> list[Check]:
    """Over `raw_<table>` and `rows_<table>`."""
    checks = []
    for table in CLEANERS:
        before, after = f"raw_{table}", f"rows_{table}"
        checks.append(Check(
            f"{table} row-count preservation", verdict(_c(before) == _c(after)),
            X.text("Raw=", X.grouped_number(before), "; Processed=", X.grouped_number(after)),
            F.abs(_c(after) - _c(before))))
    return checks


def row_count_preservation(raw: Tables, clean: Tables) -> DataFrame:
    counts = [row_count(tables[t], f"{name}_{t}") for t in CLEANERS for name, tables in (("raw", raw), ("rows", clean))]
    return check_rows(one_row(*counts), _preservation_checks(), COUNT)


def _pk_checks() -> list[Check]:
    checks = []
    for table, key in PRIMARY_KEYS.items():
        nulls, duplicates = _c(f"{table}_nulls"), _c(f"{table}_duplicates")
        checks.append(Check(
            f"{table}.{key} uniqueness", verdict(nulls + duplicates == 0),
            X.text("Nulls=", nulls, "; duplicates=", duplicates), nulls + duplicates))
    return checks


def processed_pk(clean: Tables) -> DataFrame:
    counts = K.key_counts(clean, K.relationship_keys((), PRIMARY_KEYS))
    return check_rows(counts.agg(*pk_measures()), _pk_checks(), COUNT)


def _fk_checks() -> list[Check]:
    return [_zero(f"{child}.{key}", f"{child}_{key}_orphans", "Orphan keys=") for child, key, _, _ in FOREIGN_KEYS]


def processed_fk(clean: Tables) -> DataFrame:
    counts = K.key_counts(clean, K.relationship_keys(FOREIGN_KEYS, {}))
    return check_rows(counts.agg(*fk_measures()), _fk_checks(), COUNT)


def _counted(rules: Mapping[str, Column]) -> list[Column]:
    return [F.count_if(rule).alias(name) for name, rule in rules.items()]


def _item_value_rules() -> dict[str, Column]:
    return {"price": _c("price") < 0, "freight": _c("freight_value") < 0}


def _numeric_measures() -> dict[str, list[Column]]:
    dimensions = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")
    negative = [F.count_if(_c(d) < 0) for d in dimensions]
    return {
        "order_items": _counted(_item_value_rules()),
        "payments": [
            F.count_if(_c("payment_value") < 0).alias("payment"),
            F.count_if(_c("payment_installments") == 0).alias("zero"),
            F.count_if(_c("payment_installments") < 1).alias("below_one")],
        "reviews": [
            F.count_if(_c("review_score").isNotNull() & ~_c("review_score").isin(*REVIEW_SCORES)).alias("scores")],
        "products": [sum(negative[1:], negative[0]).alias("dimensions")],
    }


def _numeric_checks() -> list[Check]:
    return [
        _zero("order_items.price >= 0", "price", "Invalid values="),
        _zero("order_items.freight_value >= 0", "freight", "Invalid values="),
        _zero("payments.payment_value >= 0", "payment", "Invalid values="),
        Check(
            "payments.payment_installments valid",
            verdict(_c("below_one") == 0),
            X.text("Zero values=", _c("zero"), "; other invalid values=", _c("below_one")),
            _c("zero") + _c("below_one"),
        ),
        _zero("reviews.review_score between 1 and 5", "scores", "Invalid values="),
        _zero("products dimensions >= 0", "dimensions", "Invalid dimension values="),
    ]


def _passes(clean: Tables, measures: Mapping[str, list[Column]]) -> list[DataFrame]:
    return [clean[table].agg(*columns) for table, columns in measures.items()]


def processed_numeric(clean: Tables) -> DataFrame:
    return check_rows(one_row(*_passes(clean, _numeric_measures())), _numeric_checks(), COUNT)


def _delivery_measures() -> list[Column]:
    flags = [F.count_if(_c(flag).isNull()) for flag, _, _ in LIFECYCLE_FLAGS]
    return [
        F.count_if(_c("delivery_days") < 0).alias("negative"),
        F.count_if(_c("estimated_delivery_days") < 0).alias("negative_estimate"),
        F.count_if(_c("is_late").isNotNull() & _c("delivery_delay_days").isNull()).alias("late"),
        sum(flags[1:], flags[0]).alias("unset"),
    ]


def _delivery_checks() -> list[Check]:
    return [
        _zero("orders.delivery_days >= 0", "negative", "Deliveries before the purchase=", "REVIEW"),
        _zero("orders.estimated_delivery_days >= 0", "negative_estimate", "Estimates before the purchase="),
        _zero("orders.is_late consistency", "late", "Late or not without a delay="),
        Check(
            "orders data-quality flags generated",
            verdict(_c("unset") == 0),
            F.when(_c("unset") == 0, "Every flag is set.")
            .otherwise(X.text("Flags not set=", _c("unset"))),
            _c("unset"),
        ),
    ]


def delivery_metric_consistency(clean: Tables) -> DataFrame:
    return check_rows(clean["orders"].agg(*_delivery_measures()), _delivery_checks(), COUNT)


def _item_keys(items: DataFrame) -> list[K.Key]:
    """The business key and, as a digest, the whole transaction: the plain form, which tests compare with `K.repeats`."""
    return [
        K.Key("item", "order_items", K.joined(*ITEM_KEY)),
        K.Key("transaction", "order_items", K.digest(items, *ITEM_IDENTITY)),
    ]


def _item_key_measures() -> list[Column]:
    def repeated(kind: str) -> Column:
        return K.rows_with(kind, "order_items") - K.values_with(kind, "order_items")
    return [repeated("item").alias("item_duplicates"), repeated("transaction").alias("transaction_duplicates")]


def _item_key_checks() -> list[Check]:
    return [
        _zero("order_items order_id + order_item_id uniqueness", "item_key_repeats", "Duplicate rows="),
        _zero("order_items transactional uniqueness", "item_row_repeats", "Duplicate transactional rows="),
    ]


def processed_business_keys(clean: Tables) -> DataFrame:
    return check_rows(K.repeats(clean["order_items"], ITEM_KEY, ITEM_IDENTITY, {}, "item"), _item_key_checks(), COUNT)


def _item_derived_rules() -> dict[str, Column]:
    price, freight = _c("price"), _c("freight_value")
    expected_ratio = F.when(price > 0, freight / price)
    return {
        "totals": F.abs(_c("item_total_value") - (price + freight)) > 0.01,
        "ratios": F.abs(_c("freight_ratio") - expected_ratio) > 0.0001,
    }


def _derived_measures() -> dict[str, list[Column]]:
    delay = X.days_between("order_estimated_delivery_date", "order_delivered_customer_date")
    return {
        "order_items": _counted(_item_derived_rules()),
        "orders": [F.count_if(F.abs(_c("delivery_delay_days") - delay) > 0.01).alias("delays")],
    }


def _derived_checks() -> list[Check]:
    return [
        _zero("order_items.item_total_value calculation", "totals", "Incorrect calculated values="),
        _zero("order_items.freight_ratio calculation", "ratios", "Incorrect calculated values="),
        _zero("orders.delivery_delay_days calculation", "delays", "Incorrect calculated values="),
    ]


def derived_field_recompute(clean: Tables) -> DataFrame:
    return check_rows(one_row(*_passes(clean, _derived_measures())), _derived_checks(), COUNT)


def processed_data_validation(raw: Tables, clean: Tables, listed: Collection[str] | None = None) -> DataFrame:
    """The whole report on the cleaned tables: raw tables are counted, cleaned ones read at most twice (keys, values).

    The values of the items are checked where their business keys meet.
    """
    measures = {table: [F.count(F.lit(1)).alias(f"rows_{table}")] for table in CLEANERS}
    for more in (_numeric_measures(), {"orders": _delivery_measures()}, _derived_measures()):
        for table, columns in more.items():
            measures[table] += columns
    # A cleaned table that has keys and no values to check is counted with its keys.
    counted = [table for table in PRIMARY_KEYS if len(measures[table]) == 1]
    keys = K.key_counts(clean, K.relationship_keys(FOREIGN_KEYS, PRIMARY_KEYS))
    items = K.repeats(
        clean["order_items"], ITEM_KEY, ITEM_IDENTITY, _item_value_rules() | _item_derived_rules(), "item")
    found = one_row(
        *[row_count(raw[table], f"raw_{table}") for table in CLEANERS],
        *_passes(clean, {table: columns for table, columns in measures.items() if table not in (*counted, "order_items")}),
        items.withColumnRenamed("item_rows", "rows_order_items"),
        keys.agg(
            *pk_measures(), *fk_measures(),
            *[K.rows_with(PRIMARY_KEYS[table], table).alias(f"rows_{table}") for table in counted]))
    return check_rows(found, [
        _availability(clean if listed is None else listed),
        *_preservation_checks(),
        *_pk_checks(),
        *_fk_checks(),
        *_numeric_checks(),
        *_delivery_checks(),
        *_item_key_checks(),
        *_derived_checks(),
    ], COUNT)


# --- model ---------------------------------------------------------------------------------

def grain_measures(model: Tables) -> DataFrame:
    """One row: `<table>_rows`, `_nulls`, `_duplicates` of every model table's key."""
    return one_row(*[key_measures(model[t], *keys, prefix=f"{t}_") for t, keys in GRAINS.items()])


def _grain_holds(table: str) -> Column:
    return (_c(f"{table}_duplicates") == 0) & (_c(f"{table}_nulls") == 0)


def _grain_checks() -> list[Check]:
    return [
        Check(f"{t} grain", verdict(_grain_holds(t)), F.lit("Key is unique and complete"))
        for t in GRAINS]


def grain_check(model: Tables) -> DataFrame:
    return check_rows(grain_measures(model), _grain_checks())


#: What the checks need of a table besides its rows; may be observed while the table is written.
TABLE_MEASURES = {
    "fact_order_items": lambda: [
        _total("item_revenue").alias("detail_revenue"), _total("item_freight").alias("detail_freight")],
    "agg_order_items": lambda: [
        _total("product_revenue").alias("agg_revenue"), _total("freight_value").alias("agg_freight"),
        F.coalesce(F.sum("item_count"), F.lit(0)).alias("agg_item_count")],
    "fact_orders": lambda: [F.count_if("has_items").alias("with_items")],
}


def _money_measures(model: Tables, counted: Counted | None = None) -> list[DataFrame]:
    """One row for each table with measures, from its write where that was observed."""
    counted = counted or {}
    known = [F.lit(value).alias(name) for table in TABLE_MEASURES if table in counted
             for name, value in counted[table].items() if name != "rows"]
    frames = [model[t].agg(*measures()) for t, measures in TABLE_MEASURES.items() if t not in counted]
    if known:
        frames.append(model["agg_order_items"].sparkSession.range(1).select(*known))
    return frames


def _money_text(detail: str, aggregated: str) -> Column:
    return X.text("Detail=", X.grouped_number(detail, 2), "; Aggregated=", X.grouped_number(aggregated, 2))


def model_validation(model: Tables, expected_rows: Mapping[str, DataFrame | int]) -> DataFrame:
    """`expected_rows`: row counts, or tables to count, for the two facts."""
    like = model["agg_order_items"]
    measures = one_row(
        grain_measures(model), *_money_measures(model),
        _rows(expected_rows["fact_order_items"], "expected_items", like),
        _rows(expected_rows["fact_orders"], "expected_orders", like),
    )
    number = X.grouped_number

    def unique(table: str, key: str, details: str) -> Check:
        return Check(f"{table} {key}", verdict(_c(f"{table}_duplicates") == 0), F.lit(details))

    return check_rows(measures, [
        Check("fact_order_items row count", verdict(_c("fact_order_items_rows") == _c("expected_items")),
              X.text("Rows=", number("fact_order_items_rows"))),
        unique("fact_order_items", "business key", "No item key twice"),
        unique("agg_order_items", "unique order_id", "No order twice"),
        Check("order item count preserved", verdict(_c("agg_item_count") == _c("fact_order_items_rows")),
              X.text("Items summed up=", number("agg_item_count"),
                     "; items=", number("fact_order_items_rows"))),
        unique("agg_order_payments", "unique order_id", "No order twice"),
        unique("agg_order_reviews", "unique order_id", "No order twice"),
        Check("fact_orders row count", verdict(_c("fact_orders_rows") == _c("expected_orders")),
              X.text("Rows=", number("fact_orders_rows"))),
        unique("fact_orders", "unique order_id", "No order twice"),
        unique("dim_customers", "unique customer_unique_id", "No person twice"),
        Check("product revenue reconciliation", verdict(_close("detail_revenue", "agg_revenue")),
              _money_text("detail_revenue", "agg_revenue")),
        Check("freight reconciliation", verdict(_close("detail_freight", "agg_freight")),
              _money_text("detail_freight", "agg_freight")),
        Check("orders with items represented", verdict(_c("with_items") == _c("agg_order_items_rows")),
              X.text("Orders that have items=", number("with_items"),
                     "; orders among the items=", number("agg_order_items_rows"))),
    ])


def expected_counts(clean: Tables, model: Tables) -> DataFrame:
    """One row: the row count that each warehouse table must have, as `expected_<table>`.

    Each source is read once; all distinct counts of a fact share one aggregate, whose
    first level is partitioned by value, so a hot value is spread over all tasks.
    """
    items, orders = model["fact_order_items"], model["fact_orders"]

    def distinct(table: str, *columns: Column | str) -> Column:
        # A missing value is a group of its own.
        return F.count_distinct(F.struct(*columns)).alias(f"expected_{table}")

    def sizes(table: str, name: str) -> DataFrame:
        known = key_sizes(clean[table], "order_id")
        return known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"{table}_rows"),
                         F.count("order_id").alias(f"expected_{name}"))

    person, day = _c("customer_unique_id"), _c("order_purchase_date")
    scored = F.rint("average_review_score")
    return one_row(
        sizes("order_items", "agg_order_items"), sizes("payments", "agg_order_payments"), sizes("reviews", "agg_order_reviews"),
        row_count(clean["orders"], "expected_fact_orders"),
        items.agg(
            distinct("category_performance", "product_category"), distinct("product_performance", "product_id"),
            distinct("seller_performance", "seller_id"),
            distinct("seller_category_performance", "seller_id", "product_category"),
            distinct("seller_state_performance", "seller_state")),
        orders.agg(
            F.count_distinct(person).alias("expected_dim_customers"),
            distinct("monthly_operations", "order_purchase_month"),
            distinct("customer_state_operations", "customer_state"), distinct("delivery_review_performance", "is_late"),
            F.count_distinct(scored).alias("expected_review_score_distribution"),
            F.coalesce(F.datediff(F.max(day), F.min(day)) + 1, F.lit(0)).cast("bigint").alias("expected_dim_date")),
    ).withColumns({
        "expected_fact_order_items": _c("order_items_rows"),
        "expected_customer_rfm": _c("expected_dim_customers"),
        "expected_operations_summary": F.lit(1).cast("bigint"),
        "expected_category_operations": _c("expected_category_performance"),
        "expected_seller_delivery_performance": _c("expected_seller_performance"),
        "expected_seller_state_operations": _c("expected_seller_state_performance"),
    })


def catalog_validation(
    tables: Tables,
    expected_rows: Mapping[str, DataFrame | int] | DataFrame,
    listed: Collection[str] | None = None,
    counted: Counted | None = None,
) -> DataFrame:
    """All warehouse tables: presence, row counts, grains, totals.

    `expected_rows` are tables or numbers by name, or the row of `expected_counts`.  `listed` are the names found in
    the catalog (default: the tables passed).  Tables in `counted` are not read again for their rows and totals.
    """
    counted = counted or {}
    listed = set(tables if listed is None else listed)
    missing = sorted(set(CATALOG_TABLES) - listed)
    unexpected = sorted(listed - set(CATALOG_TABLES))
    like = tables["agg_order_items"]
    known = [F.lit(counted[t]["rows"]).cast("bigint").alias(f"actual_{t}") for t in CATALOG_TABLES if t in counted]
    expected = [expected_rows] if isinstance(expected_rows, DataFrame) else [
        _rows(expected_rows[t], f"expected_{t}", like) for t in CATALOG_TABLES]
    measures = one_row(
        grain_measures(tables), *_money_measures(tables, counted),
        like.sparkSession.range(1).select(F.lit(1).alias("one"), *known),
        *[row_count(tables[t], f"actual_{t}") for t in CATALOG_TABLES if t not in counted], *expected,
    )
    number = X.grouped_number
    return check_rows(measures, [
        Check("Expected tables exist", verdict(F.lit(not missing)), F.lit(f"Missing tables={missing}")),
        Check("No unexpected analytical tables", verdict(F.lit(not unexpected)),
              F.lit(f"Unexpected tables={unexpected}")),
        *[Check(f"{t} row count", verdict(_c(f"actual_{t}") == _c(f"expected_{t}")),
                X.text("Expected=", number(f"expected_{t}"), "; Actual=", number(f"actual_{t}")))
          for t in CATALOG_TABLES],
        *_grain_checks(),
        Check("Product revenue reconciliation", verdict(_c("detail_revenue") == _c("agg_revenue")),
              _money_text("detail_revenue", "agg_revenue")),
        Check("Freight reconciliation", verdict(_c("detail_freight") == _c("agg_freight")),
              _money_text("detail_freight", "agg_freight")),
        Check("Orders with items relationship", verdict(_c("with_items") == _c("actual_agg_order_items")),
              X.text("Orders that have items=", number("with_items"),
                     "; Aggregated item orders=", number("actual_agg_order_items"))),
    ])


# --- sales -----------------------------------------------------------------------------------

def sales_reconciliation(
    model: Tables,
    expected_orders: DataFrame | int,
    expected_customers: DataFrame | int,
) -> DataFrame:
    items, orders, items_agg = model["fact_order_items"], model["fact_orders"], model["agg_order_items"]
    month = X.month_start("order_purchase_timestamp")
    by_category = items.groupBy("product_category").agg(_total("item_revenue").alias("v"))
    by_state = orders.where("has_items").groupBy("customer_state").agg(_total("product_revenue").alias("v"))
    by_month = (
        orders.select("order_id", month.alias("month"))
        .join(items_agg.select("order_id", "product_revenue"), "order_id")
        .groupBy("month").agg(_total("product_revenue").alias("v")))
    monthly = orders.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    measures = one_row(
        items.agg(_total("item_revenue").alias("detail")),
        items_agg.agg(_total("product_revenue").alias("aggregated"), F.count(F.lit(1)).alias("agg_orders")),
        orders.agg(F.count(F.lit(1)).alias("orders"), F.count_if("has_items").alias("with_items")),
        row_count(model["dim_customers"], "customers"),
        _rows(expected_orders, "expected_orders", items_agg),
        _rows(expected_customers, "expected_customers", items_agg),
        by_category.agg(_total("v").alias("category")),
        by_state.agg(_total("v").alias("state")),
        by_month.agg(_total("v").alias("month_revenue")),
        monthly.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("month_orders")),
    )

    def pair(check: str, left: str, a: str, right: str, b: str, money: bool = False) -> Check:
        show = X.plain_money if money else _c
        return Check(check, verdict(_c(a) == _c(b)), X.text(f"{left}=", show(a), f"; {right}=", show(b)))

    report = check_rows(measures, [
        pair("Product revenue reconciliation", "Detail", "detail", "Aggregated", "aggregated", True),
        pair("Total order count", "Expected", "expected_orders", "Actual", "orders"),
        pair("Unique customer count", "Expected", "expected_customers", "Actual", "customers"),
        pair("Orders with items reconciliation", "Aggregated", "agg_orders", "Fact orders", "with_items"),
        pair("Category revenue reconciliation", "Category total", "category", "Revenue", "detail", True),
        pair("State revenue reconciliation", "State total", "state", "Revenue", "detail", True),
        pair("Monthly revenue reconciliation", "Monthly total", "month_revenue", "Revenue", "detail", True),
        pair("Monthly order reconciliation", "Monthly total", "month_orders", "Orders", "orders"),
    ])
    return report.withColumnRenamed("details", "detail")


# --- marts ----------------------------------------------------------------------------------------

def _same(check: str, left: str, a: str, right: str, b: str) -> Check:
    return Check(check, verdict(_c(a) == _c(b)),
                 X.text(f"{left}=", X.grouped_number(a), f", {right}=", X.grouped_number(b)))


def _within_cent(check: str, a: str, b: str) -> Check:
    gap = F.abs(_c(a) - _c(b))
    return Check(check, verdict(gap < 0.01), X.text("difference=", F.format_string("%.6f", gap)))


def _none(check: str, column: str, label: str = "invalid rows=") -> Check:
    return Check(check, verdict(_c(column) == 0), X.text(label, X.grouped_number(column)))


def rfm_validation(
    rfm: DataFrame, customers: DataFrame, expected_segments: int = 8, listed: Collection[str] = ("customer_rfm",)
) -> DataFrame:
    def outside(score: str) -> Column:
        return F.count_if(~_c(score).between(1, 5)).alias(score)

    measures = one_row(
        rfm.agg(
            F.count_if(_c("recency") < 0).alias("recency"),
            F.count_if(_c("frequency") < 1).alias("frequency"),
            F.count_if(_c("monetary") < 0).alias("monetary"),
            outside("recency_score"), outside("frequency_score"), outside("monetary_score"),
            F.count_if(F.length("rfm_score") != 3).alias("format"),
            F.count_if(_c("customer_segment").isNull()).alias("no_segment"),
            _total("monetary").alias("rfm_revenue"),
        ),
        # Distinct persons and segments are counted apart: no row blow-up by several distincts.
        key_measures(rfm, "customer_unique_id").select(_c("rows").alias("rfm_rows"), "duplicates"),
        rfm.agg(F.count_distinct("customer_segment").alias("segments")),
        customers.agg(F.count(F.lit(1)).alias("dim_rows"), _total("total_product_revenue").alias("dim_revenue")),
    )
    return check_rows(measures, [
        Check("customer_rfm table exists", verdict(F.lit("customer_rfm" in listed)), F.lit("")),
        _same("RFM row count matches customer dimension", "RFM", "rfm_rows", "dim_customers", "dim_rows"),
        _none("One RFM row per customer", "duplicates", "duplicate customers="),
        _none("Recency values are non-negative", "recency"),
        _none("Frequency values are valid", "frequency"),
        _none("Monetary values are non-negative", "monetary"),
        _none("Recency scores are between 1 and 5", "recency_score"),
        _none("Frequency scores are between 1 and 5", "frequency_score"),
        _none("Monetary scores are between 1 and 5", "monetary_score"),
        _none("RFM score has three digits", "format"),
        _none("Every customer has a segment", "no_segment", "null segments="),
        _within_cent("RFM monetary revenue reconciles", "rfm_revenue", "dim_revenue"),
        Check("Expected RFM segments are present", verdict(_c("segments") == expected_segments),
              X.text("segments=", _c("segments"))),
    ])


def _item_measures(items: DataFrame, *distinct: str) -> list[DataFrame]:
    return [
        items.agg(F.count(F.lit(1)).alias("source_items"), _total("item_revenue").alias("source_revenue"),
                  _total("item_freight").alias("source_freight")),
        *[items.agg(F.count_distinct(d).alias(f"source_{d}")) for d in distinct],
    ]


def product_seller_validation(items: DataFrame, marts: Tables, listed: Collection[str] | None = None) -> DataFrame:
    def totals(mart: str, prefix: str, *extra: Column) -> DataFrame:
        return marts[mart].agg(
            F.coalesce(F.sum("order_items"), F.lit(0)).alias(f"{prefix}_items"),
            _total("revenue").alias(f"{prefix}_revenue"),
            _total("freight").alias(f"{prefix}_freight"),
            F.count(F.lit(1)).alias(f"{prefix}_rows"), *extra)

    measures = one_row(
        *_item_measures(items, "seller_id", "product_id"),
        totals("category_performance", "category"),
        totals("product_performance", "product", F.count_if(_c("revenue") < 0).alias("negative")),
        totals("seller_performance", "seller"),
        totals("seller_category_performance", "seller_category"),
    )
    groups = {"Category": "category", "Product": "product", "Seller": "seller", "Seller-category": "seller_category"}
    listed = marts if listed is None else listed
    return check_rows(measures, [
        *_exists(PRODUCT_SELLER_MARTS, listed),
        *[_same(f"{title} order-item count reconciles", p, f"{p}_items", "source", "source_items")
          for title, p in groups.items()],
        *[_within_cent(f"{title} {what} reconciles", f"source_{what}", f"{groups[title]}_{what}")
          for what in ("revenue", "freight") for title in ("Category", "Product", "Seller")],
        _none("Product revenue is non-negative", "negative"),
        _same("Seller count reconciles", "source", "source_seller_id", "analytical", "seller_rows"),
        _same("Product count reconciles", "source", "source_product_id", "analytical", "product_rows"),
    ])


def operations_validation(
    items: DataFrame, orders: DataFrame, marts: Tables, listed: Collection[str] | None = None
) -> DataFrame:
    def bad_rate(mart: str, name: str) -> Column:
        return F.count_if((_c("late_delivery_rate") < 0) | (_c("late_delivery_rate") > 100)).alias(name)

    score = _c("average_review_score")
    summary = {"total_orders": "summary_orders", "delivered_orders": "summary_delivered",
               "late_delivered_orders": "summary_late"}
    measures = one_row(
        orders.agg(
            F.count(F.lit(1)).alias("orders"),
            F.count_if("is_delivered").alias("delivered"),
            F.count_if(_c("is_delivered") & _c("is_late")).alias("late"),
            F.count_if((score < 1) | (score > 5)).alias("bad_scores"),
            F.count(score).alias("reviewed"),
            F.count_if(_c("delivery_days") < 0).alias("negative_days")),
        *_item_measures(items, "seller_id"),
        marts["operations_summary"].select(*[_c(c).alias(a) for c, a in summary.items()]),
        marts["monthly_operations"].agg(F.coalesce(F.sum("delivered_orders"), F.lit(0)).alias("monthly_delivered")),
        marts["customer_state_operations"].agg(
            F.coalesce(F.sum("orders"), F.lit(0)).alias("state_orders"),
            bad_rate("customer_state_operations", "bad_state_rates")),
        marts["category_operations"].agg(
            _total("revenue").alias("category_revenue"), _total("freight").alias("category_freight")),
        marts["seller_delivery_performance"].agg(
            _total("revenue").alias("seller_revenue"), F.count(F.lit(1)).alias("seller_rows"),
            bad_rate("seller_delivery_performance", "bad_seller_rates")),
        marts["seller_state_operations"].agg(_total("revenue").alias("seller_state_revenue")),
        marts["review_score_distribution"].agg(F.coalesce(F.sum("orders"), F.lit(0)).alias("distribution")),
    )
    listed = marts if listed is None else listed
    return check_rows(measures, [
        *_exists(OPERATIONS_MARTS, listed),
        _same("Operations total orders reconciles", "source", "orders", "summary", "summary_orders"),
        _same("Delivered orders reconcile", "source", "delivered", "summary", "summary_delivered"),
        _same("Late delivered orders reconcile", "source", "late", "summary", "summary_late"),
        _same("Monthly delivered orders reconcile", "monthly", "monthly_delivered", "source", "delivered"),
        _same("Customer-state orders reconcile", "state", "state_orders", "source", "orders"),
        _within_cent("Category operations revenue reconciles", "source_revenue", "category_revenue"),
        _within_cent("Category operations freight reconciles", "source_freight", "category_freight"),
        _within_cent("Seller delivery revenue reconciles", "source_revenue", "seller_revenue"),
        _within_cent("Seller-state revenue reconciles", "source_revenue", "seller_state_revenue"),
        _none("Review scores remain within 1-5", "bad_scores"),
        _same("Review score distribution reconciles", "distribution", "distribution", "source", "reviewed"),
        _none("Customer-state late rates are valid", "bad_state_rates"),
        _none("Seller late rates are valid", "bad_seller_rates"),
        _none("Delivery days are non-negative", "negative_days"),
        _same("Seller delivery table covers all sellers", "source", "source_seller_id", "analytical", "seller_rows"),
    ])


def date_dim_validation(
    orders: DataFrame, dates: DataFrame, listed: Collection[str] = ("dim_date",)
) -> DataFrame:
    measures = one_row(
        orders.agg(F.min("order_purchase_date").alias("first"), F.max("order_purchase_date").alias("last")),
        dates.agg(F.min("date").alias("dim_first"), F.max("date").alias("dim_last")),
        key_measures(dates, "date"),
    ).withColumn("days", F.datediff("last", "first") + 1)
    return check_rows(measures, [
        Check("dim_date exists", verdict(F.lit("dim_date" in listed)), F.lit("")),
        _same("Date range has no missing days", "actual", "rows", "expected", "days"),
        _none("Dates are unique", "duplicates", "duplicate_dates="),
        Check("Minimum date matches source", verdict(_c("dim_first") == _c("first")),
              X.text("dimension=", _c("dim_first"), ", source=", _c("first"))),
        Check("Maximum date matches source", verdict(_c("dim_last") == _c("last")),
              X.text("dimension=", _c("dim_last"), ", source=", _c("last"))),
        _none("No null dates", "nulls", "null_dates="),
    ])
