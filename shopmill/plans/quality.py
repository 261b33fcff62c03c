"""Profile and audit of the raw tables.

Raw columns may be text or typed; numbers and times are parsed here, so that a
value that does not parse counts as missing rather than stopping the audit.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shopmill.functions import exprs as X
from shopmill.operators.cleaning import LIFECYCLE_TIMES
from shopmill.operators.guards import rows_with_repeated_hash
from shopmill.plans import keys as K
from shopmill.plans.checks import Check, check_rows, key_sizes, one_row, row_count, text_list, union_all, verdict
from shopmill.plans.checks import status_counts as quality_status_counts  # noqa: F401
from shopmill.sources.readers import csv_files, read_text_csv
from shopmill.sources.scratch import materialize

Tables = Mapping[str, DataFrame]
NUMBERS = ("count", "percentage")

# Keys, relationships and domains of the raw data model.
PRIMARY_KEYS = {"orders": "order_id", "customers": "customer_id", "products": "product_id", "sellers": "seller_id"}
FOREIGN_KEYS = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
)
CARDINALITIES = (
    ("orders", "order_items", "order_id"),
    ("orders", "payments", "order_id"),
    ("orders", "reviews", "order_id"),
    ("customers", "orders", "customer_id"),
    ("products", "order_items", "product_id"),
    ("sellers", "order_items", "seller_id"),
)
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card", "not_defined")
REVIEW_SCORES = (1, 2, 3, 4, 5)

# Fixed values: (check, column, other column); violated when the first precedes the second.
DATE_RULES = (
    ("approved_before_purchase", "order_approved_at", "order_purchase_timestamp"),
    ("carrier_before_purchase", "order_delivered_carrier_date", "order_purchase_timestamp"),
    ("carrier_before_approval", "order_delivered_carrier_date", "order_approved_at"),
    ("customer_delivery_before_purchase", "order_delivered_customer_date", "order_purchase_timestamp"),
    ("customer_delivery_before_carrier", "order_delivered_customer_date", "order_delivered_carrier_date"),
    ("estimated_delivery_before_purchase", "order_estimated_delivery_date", "order_purchase_timestamp"),
)


# --- inventory ---------------------------------------------------------------------

def exact_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row, `duplicate_rows`: rows that repeat an earlier row in every column."""
    sizes = key_sizes(rows_with_repeated_hash(df, *df.columns), *df.columns)
    return sizes.agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"))


def table_inventory(raw: Tables) -> DataFrame:
    reports = []
    for name in sorted(raw):
        df = raw[name]
        missing = [F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *missing)
        gaps = [F.col(f"m{i}") for i in range(len(df.columns))]
        reports.append(one_row(counts, exact_duplicate_rows(df)).select(
            F.lit(name).alias("table"),
            "rows",
            F.lit(len(df.columns)).cast("bigint").alias("columns"),
            "duplicate_rows",
            sum(gaps[1:], gaps[0]).alias("total_missing_values"),
            sum([(g > 0).cast("bigint") for g in gaps[1:]], (gaps[0] > 0).cast("bigint"))
            .alias("columns_with_missing_values"),
        ))
    return union_all(reports)


def folder_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Inventory of every CSV file in a folder, whatever its columns."""
    files = {path.rsplit("/", 1)[-1]: path for path in csv_files(spark, folder)}
    tables = {name.removesuffix(".csv"): read_text_csv(spark, path) for name, path in files.items()}
    return table_inventory(tables).select(
        "table", F.concat("table", F.lit(".csv")).alias("file"), "rows", "columns", "duplicate_rows",
        "total_missing_values", "columns_with_missing_values").orderBy("table")


# --- keys ------------------------------------------------------------------------------

def pk_measures() -> list[Column]:
    """`<table>_rows`, `_nulls`, `_duplicates` of every primary key, from key counts."""
    return [c for table, key in PRIMARY_KEYS.items() for c in K.uniqueness(key, table, table)]


def fk_measures() -> list[Column]:
    """`<child>_<key>_keys` and `_orphans` of every relation, from key counts."""
    return [c for child, key, parent, parent_key in FOREIGN_KEYS
            for c in K.orphans(parent_key, child, parent, f"{child}_{key}")]


def _pk_checks() -> list[Check]:
    checks = []
    for table, key in PRIMARY_KEYS.items():
        rows, nulls, duplicates = (F.col(f"{table}_{m}") for m in ("rows", "nulls", "duplicates"))
        bad = nulls + duplicates
        checks.append(Check(
            f"{table}.{key} uniqueness", verdict(bad == 0),
            X.text("Rows=", rows, ", nulls=", nulls, ", duplicates=", duplicates), bad, X.safe_percentage(bad, rows)))
    return checks


def _fk_checks() -> list[Check]:
    checks = []
    for child, key, _, _ in FOREIGN_KEYS:
        keys, orphans = F.col(f"{child}_{key}_keys"), F.col(f"{child}_{key}_orphans")
        checks.append(Check(
            f"{child}.{key} → parent key", verdict(orphans == 0),
            X.text("Non-null child keys=", keys, ", orphan keys=", orphans), orphans, X.safe_percentage(orphans, keys)))
    return checks


def pk_quality(raw: Tables) -> DataFrame:
    counts = K.key_counts(raw, K.relationship_keys((), PRIMARY_KEYS))
    return check_rows(counts.agg(*pk_measures()), _pk_checks(), numbers=NUMBERS)


def fk_quality(raw: Tables) -> DataFrame:
    counts = K.key_counts(raw, K.relationship_keys(FOREIGN_KEYS, {}))
    return check_rows(counts.agg(*fk_measures()), _fk_checks(), numbers=NUMBERS)


# --- values ------------------------------------------------------------------------------

#: Values that one report text names; the extracts hold all of them, one a row.
LISTED = 100


def most_frequent(sizes: DataFrame, value: str, wanted: Column, name: str) -> DataFrame:
    """One row: the ``LISTED`` most frequent wanted (value, n) of a table of counts, in order of value.

    However many values the data holds, no task keeps more than ``LISTED`` of them.
    """
    top = sizes.orderBy(F.desc_nulls_last(F.when(wanted, F.col("n"))), value).limit(LISTED)
    return top.agg(F.sort_array(F.collect_list(F.when(wanted, F.struct(value, "n")))).alias(name))


def beyond_listed(distinct: str) -> Column:
    """How many of so many distinct values a text does not name, as text; empty if none."""
    return F.when(F.col(distinct) > LISTED, X.text(" and ", F.col(distinct) - LISTED, " more")).otherwise("")


def _missing_cells(df: DataFrame) -> Column:
    gaps = [F.count_if(F.col(c).isNull()) for c in df.columns]
    return sum(gaps[1:], gaps[0])


def _item_measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("items"),
        F.count_if(X.unusable_amount(X.to_number("price"))).alias("price"),
        F.count_if(X.unusable_amount(X.to_number("freight_value"))).alias("freight"),
    ]


def _review_measures() -> list[Column]:
    score = X.to_number("review_score")
    return [
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(score.isNotNull() & ~score.isin(*[float(s) for s in REVIEW_SCORES])).alias("scores"),
    ]


def _unusable_payment() -> Column:
    return F.count_if(X.unusable_amount(X.to_number("payment_value")))


def _numeric_checks() -> list[Check]:
    histogram = F.concat(
        F.array_join(F.transform("plans", lambda p: X.text(p["plan"], ": ", p["n"])), ", "), beyond_listed("odd_plans"))

    def negative(check: str, label: str, count: str, total: str) -> Check:
        return Check(check, verdict(F.col(count) == 0), X.text(label, F.col(count)), F.col(count),
                     X.safe_percentage(count, total))

    return [
        negative("order_items.price valid (>= 0)", "Invalid negative prices=", "price", "items"),
        negative("order_items.freight_value valid (>= 0)", "Invalid negative freight values=", "freight", "items"),
        negative("payments.payment_value valid (>= 0)", "Invalid negative payment values=", "value", "payments"),
        Check(
            "payments.payment_installments valid (> 0)",
            verdict(F.col("installments") == 0, "REVIEW"),
            X.text("Invalid rows=", F.col("installments"), "; invalid values={", histogram, "}"),
            F.col("installments"),
            X.safe_percentage("installments", "payments"),
        ),
    ]


def numeric_quality(raw: Tables) -> DataFrame:
    items = raw["order_items"].agg(*_item_measures())
    # Payments are reduced to their few distinct installment numbers first.
    plans = (
        raw["payments"]
        .groupBy(X.to_whole("payment_installments").alias("plan"))
        .agg(F.count(F.lit(1)).alias("n"), _unusable_payment().alias("negative"))
    )
    payments = plans.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("payments"),
        F.coalesce(F.sum("negative"), F.lit(0)).alias("value"),
        F.coalesce(F.sum(F.when(F.col("plan") <= 0, F.col("n"))), F.lit(0)).alias("installments"),
        F.count_if(F.col("plan") <= 0).alias("odd_plans"),
    )
    listed = most_frequent(plans, "plan", F.col("plan") <= 0, "plans")
    return check_rows(one_row(items, payments, listed), _numeric_checks(), numbers=NUMBERS)


def _domain_checks() -> list[Check]:
    return [
        Check(
            "reviews.review_score valid (1-5)",
            verdict(F.col("scores") == 0),
            X.text("Invalid review scores=", F.col("scores")),
            F.col("scores"),
            X.safe_percentage("scores", "reviews"),
        ),
        Check(
            "payments.payment_type validity",
            verdict(F.col("odd_rows") == 0, "REVIEW"),
            X.text("Observed types=", text_list(F.col("types.payment_type")), beyond_listed("n_types"),
                   "; unexpected types=", text_list(F.col("odd_types.payment_type")), beyond_listed("n_odd_types")),
            F.col("odd_rows"),
            X.safe_percentage("odd_rows", "payments"),
        ),
    ]


def _unexpected(payment_type: str) -> Column:
    return F.col(payment_type).isNotNull() & ~F.col(payment_type).isin(*PAYMENT_TYPES)


def domain_quality(raw: Tables) -> DataFrame:
    reviews = raw["reviews"].agg(*_review_measures())
    unexpected = _unexpected("payment_type")
    sizes = key_sizes(raw["payments"], "payment_type")
    payments = sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("payments"),
        F.coalesce(F.sum(F.when(unexpected, F.col("n"))), F.lit(0)).alias("odd_rows"),
        F.count("payment_type").alias("n_types"),
        F.count_if(unexpected).alias("n_odd_types"),
    )
    types = most_frequent(sizes, "payment_type", F.col("payment_type").isNotNull(), "types")
    odd_types = most_frequent(sizes, "payment_type", unexpected, "odd_types")
    return check_rows(one_row(reviews, payments, types, odd_types), _domain_checks(), numbers=NUMBERS)


def unexpected_payment_types(payments: DataFrame) -> DataFrame:
    """Payment types outside the known ones and their rows, all of them."""
    return (
        key_sizes(payments, "payment_type")
        .where(_unexpected("payment_type"))
        .select("payment_type", F.col("n").alias("payments"))
        .orderBy(F.desc("payments"), "payment_type")
    )


# --- missing values --------------------------------------------------------------------------

def missing_values(raw: Tables) -> DataFrame:
    """(table, column) pairs with missing values; one pass per table."""
    reports = []
    for name, df in raw.items():
        counts = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
        cells = F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"))
            for i, c in enumerate(df.columns)])
        reports.append(counts.select(F.lit(name).alias("table"), "rows", F.inline(cells)))
    return (
        union_all(reports)
        .where("missing_count > 0")
        .select("table", "column", "rows", "missing_count",
                X.safe_percentage("missing_count", "rows").alias("missing_percentage"))
        .orderBy("table", F.desc("missing_percentage"), "column")
    )


def missing_by_status(orders: DataFrame) -> DataFrame:
    columns = ("order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date")
    counts = orders.groupBy("order_status").agg(
        F.count(F.lit(1)).alias("orders"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count")) for c in columns])
    return (
        counts.select("order_status", "orders", F.inline(cells))
        .select("order_status", "column", "orders", "missing_count",
                X.safe_percentage("missing_count", "orders").alias("missing_percentage"))
        .orderBy("order_status", "column")
    )


def _missing_value_check() -> Check:
    return Check(
        "Missing-value analysis",
        F.lit("INFO"),
        F.lit("Cells without a value; see the report of missing values."),
        F.col("missing_cells"),
    )


# --- dates ---------------------------------------------------------------------------------------

def timestamp_parse_quality(orders: DataFrame) -> DataFrame:
    parsed = {c: X.to_time(c) for c in LIFECYCLE_TIMES}
    counts = orders.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(t.isNull()).alias(f"missing_{c}") for c, t in parsed.items()],
        *[F.count_if(F.col(c).isNotNull() & t.isNull()).alias(f"failed_{c}") for c, t in parsed.items()])
    missing = [
        Check(f"{c} missing after parsing", F.lit("INFO"),
              F.lit("No time given, or none that can be read."),
              F.col(f"missing_{c}"), X.safe_percentage(f"missing_{c}", "rows"))
        for c in LIFECYCLE_TIMES]
    failed = [
        Check(f"{c} parse validity", verdict(F.col(f"failed_{c}") == 0),
              F.lit("Texts that are not a time."),
              F.col(f"failed_{c}"), X.safe_percentage(f"failed_{c}", "rows"))
        for c in LIFECYCLE_TIMES]
    return check_rows(counts, missing + failed, numbers=NUMBERS)


def _with_times(orders: DataFrame) -> DataFrame:
    """The orders and `time_<column>` for every lifecycle time."""
    return orders.select("*", *[X.to_time(c).alias(f"time_{c}") for c in LIFECYCLE_TIMES])


def _sequence_measures() -> list[Column]:
    def times(a: str, b: str) -> tuple[Column, Column]:
        return F.col(f"time_{a}"), F.col(f"time_{b}")
    both = [(n, *times(a, b)) for n, a, b in DATE_RULES]
    return [
        *[F.count_if(a.isNotNull() & b.isNotNull()).alias(f"known_{n}") for n, a, b in both],
        *[F.count_if(a < b).alias(f"bad_{n}") for n, a, b in both],
    ]


def _sequence_checks() -> list[Check]:
    return [
        Check(n, verdict(F.col(f"bad_{n}") == 0, "REVIEW"),
              X.text(f"{a} before {b}; comparable rows=", F.col(f"known_{n}")),
              F.col(f"bad_{n}"), X.safe_percentage(f"bad_{n}", f"known_{n}"))
        for n, a, b in DATE_RULES]


def date_sequence_quality(orders: DataFrame) -> DataFrame:
    """Six order rules; the share is of the rows where both times are known."""
    return check_rows(_with_times(orders).agg(*_sequence_measures()), _sequence_checks(), numbers=NUMBERS)


def date_quality_report(orders: DataFrame) -> DataFrame:
    return timestamp_parse_quality(orders).unionByName(date_sequence_quality(orders))


# --- relationships ----------------------------------------------------------------------------------

def relationship_cardinality(raw: Tables) -> DataFrame:
    """Children per parent key, for every relationship; a missing parent key counts as one without children."""
    relations = [(child, key, parent, key) for parent, child, key in CARDINALITIES]
    counts = K.key_counts(raw, K.relationship_keys(relations, {}))
    rows = []
    for parent, child, key in CARDINALITIES:
        here = (F.col("kind") == key) & (F.col(f"n_{parent}") > 0)
        n = F.when(here, F.when(F.col("value").isNull(), 0).otherwise(F.col(f"n_{child}")))
        rows.append(F.struct(
            F.lit(f"{parent} → {child}").alias("relationship"),
            F.count(n).alias("parent_rows"),
            F.count_if(n == 0).alias("zero_children"),
            F.count_if(n == 1).alias("one_child"),
            F.count_if(n > 1).alias("multiple_children"),
            F.max(n).alias("maximum_children"),
            X.round_half_even(F.sum(n) / F.nullif(F.count(n), F.lit(0)).cast("double"), 2).alias("average_children"),
        ))
    return counts.agg(F.array(*rows).alias("found")).select(F.inline("found"))


# --- geolocation ----------------------------------------------------------------------------------------

def _geolocation_measures(geolocation: DataFrame) -> DataFrame:
    """One scan, rolled up row -> coordinate pair -> zip -> total."""
    place = ("geolocation_zip_code_prefix", "lat", "lng")
    typed = geolocation.select(
        "geolocation_zip_code_prefix", "geolocation_city", "geolocation_state",
        X.to_number("geolocation_lat").alias("lat"), X.to_number("geolocation_lng").alias("lng"))
    rows = key_sizes(typed, *typed.columns)
    pairs = rows.groupBy(*place).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct_rows"))
    zips = pairs.groupBy("geolocation_zip_code_prefix").agg(
        F.sum("n").alias("n"),
        F.sum("distinct_rows").alias("distinct_rows"),
        F.sum(F.when(F.col("lat").isNull() | F.col("lng").isNull(), F.col("n"))).alias("incomplete"),
        F.count(F.lit(1)).alias("pairs"),
    )
    known = F.col("geolocation_zip_code_prefix").isNotNull()
    return zips.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("n") - F.sum("distinct_rows"), F.lit(0)).alias("duplicates"),
        F.count_if(known).alias("zips"),
        F.coalesce(F.sum("incomplete"), F.lit(0)).alias("incomplete"),
        F.count_if(known & (F.col("pairs") > 1)).alias("several"),
        F.coalesce(F.max(F.when(known, F.col("pairs"))), F.lit(0)).alias("most"),
    ).withColumn("share", X.safe_percentage("duplicates", "total"))


def geolocation_quality(geolocation: DataFrame) -> DataFrame:
    metrics = {
        "total_rows": "total",
        "exact_duplicate_rows": "duplicates",
        "exact_duplicate_percentage": "share",
        "unique_zip_code_prefixes": "zips",
        "rows_with_missing_coordinates": "incomplete",
        "zip_prefixes_with_multiple_coordinate_pairs": "several",
        "maximum_coordinate_pairs_for_one_zip": "most",
    }
    return _geolocation_measures(geolocation).select(F.inline(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value"))
        for metric, c in metrics.items()])))


def _geolocation_checks() -> list[Check]:
    number = X.grouped_number
    return [
        Check(
            "Geolocation exact duplicates",
            verdict(F.col("duplicates") == 0, "REVIEW"),
            X.text(number("duplicates"), " rows repeat another one in full, of ", number("total"), " (",
                   F.col("share"), "%)."),
            F.col("duplicates"),
            F.col("share"),
        ),
        Check(
            "Geolocation ZIP-prefix coordinate cardinality",
            F.lit("INFO"),
            X.text(number("several"), " prefixes with several places."),
            F.col("several"),
            X.safe_percentage("several", "zips"),
        ),
    ]


# --- categories and statuses ---------------------------------------------------------------------------------

def untranslated_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    name = "product_category_name"
    return (
        products.where(F.col(name).isNotNull()).select(name).distinct()
        .join(translation.select(name), name, "left_anti")
        .select(F.col(name).alias("untranslated_category"))
        .orderBy("untranslated_category")
    )


def _category_checks() -> list[Check]:
    return [Check(
        "Product category translation coverage",
        verdict(F.col("gaps") == 0, "REVIEW"),
        X.text("Source categories=", F.col("categories"), ", translated categories=", F.col("translated"),
               ", untranslated categories=", text_list(F.col("untranslated.product_category_name")), beyond_listed("gaps")),
        F.col("gaps"),
        X.safe_percentage("gaps", "categories"),
    )]


def category_translation_coverage(products: DataFrame, translation: DataFrame) -> DataFrame:
    name = "product_category_name"
    translated = translation.where(F.col(name).isNotNull()).select(name).distinct()
    source = key_sizes(products.where(F.col(name).isNotNull()), name)
    matched = source.join(translated.withColumn("known", F.lit(True)), name, "left")
    untranslated = F.col("known").isNull()
    measures = one_row(
        matched.agg(F.count(F.lit(1)).alias("categories"), F.count_if(untranslated).alias("gaps")),
        most_frequent(matched, name, untranslated, "untranslated"),
        row_count(translated, "translated"),
    )
    return check_rows(measures, _category_checks(), numbers=NUMBERS)


def order_status_distribution(orders: DataFrame) -> DataFrame:
    """Orders and share per status; a missing status is a group of its own."""
    counts = orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))
    total = row_count(orders, "n").scalar()
    return (
        counts.withColumn("percentage", X.safe_percentage(F.col("orders"), total))
        .orderBy(F.desc("orders"), "order_status")
    )


def _status_check() -> Check:
    return Check(
        "Order status distribution", F.lit("INFO"),
        X.text("Observed ", F.col("statuses"), " distinct order statuses."), F.col("statuses"))


# --- the whole audit -----------------------------------------------------------------------------------------------

def audit_keys(raw: Tables) -> DataFrame:
    """The key counts that the audit needs: keys, relations, and the values of the small domains."""
    return K.key_counts(raw, [
        *K.relationship_keys(FOREIGN_KEYS, PRIMARY_KEYS),
        K.plain("orders", "order_status"),
        K.plain("payments", "payment_type"),
        K.Key("plan", "payments", X.to_whole("payment_installments").cast("string")),
        K.plain("products", "product_category_name"),
        K.plain("translation", "product_category_name"),
    ])


def _domain_facts(counts: DataFrame) -> list[DataFrame]:
    """One-row frames: keys and small domains, and the values that report texts name."""
    category, kind = "product_category_name", "payment_type"
    plan = F.col("value").cast("bigint")
    given, odd_type, untranslated = F.col("value").isNotNull(), _unexpected("value"), F.col("n_translation") == 0
    facts = counts.agg(
        *pk_measures(),
        *fk_measures(),
        K.rows_with("plan", "payments").alias("payments"),
        K.rows_with("plan", "payments", plan <= 0).alias("installments"),
        K.values_with("plan", "payments", plan <= 0).alias("odd_plans"),
        K.rows_with(kind, "payments", odd_type).alias("odd_rows"),
        K.values_with(kind, "payments", given).alias("n_types"),
        K.values_with(kind, "payments", odd_type).alias("n_odd_types"),
        K.values_with(category, "products", given).alias("categories"),
        K.values_with(category, "products", given & untranslated).alias("gaps"),
        K.values_with(category, "translation", given).alias("translated"),
        K.values_with("order_status", "orders", given).alias("statuses"),
    )
    plans = K.sizes(counts, "plan", "payments", "plan", "bigint")
    types = K.sizes(counts, kind, "payments", kind)
    gaps = K.sizes(counts.where(given & untranslated), category, "products", category)
    return [
        facts,
        most_frequent(plans, "plan", F.col("plan") <= 0, "plans"),
        most_frequent(types, kind, F.col(kind).isNotNull(), "types"),
        most_frequent(types, kind, _unexpected(kind), "odd_types"),
        most_frequent(gaps, category, F.lit(True), "untranslated"),
    ]


def quality_report(raw: Tables) -> DataFrame:
    """Every check of the audit, one row each.

    Every table is read twice: once for its keys and once for everything that is counted row by row (geolocation:
    its places).  The key counts are written when this is called, as several measures read them; the rest is lazy.
    """
    measures: dict[str, list[Column]] = {
        "orders": _sequence_measures(),
        "order_items": _item_measures(),
        "payments": [_unusable_payment().alias("value")],
        "reviews": _review_measures(),
    }
    passes = []
    for table, df in raw.items():
        read = _with_times(df) if table == "orders" else df
        passes.append(read.agg(_missing_cells(df).alias(f"missing_{table}"), *measures.get(table, [])))
    counts = materialize(audit_keys(raw), "audit_keys")
    found = one_row(*passes, *_domain_facts(counts), _geolocation_measures(raw["geolocation"]))
    gaps = [F.col(f"missing_{table}") for table in raw]
    return check_rows(found.withColumn("missing_cells", sum(gaps[1:], gaps[0])), [
        *_pk_checks(),
        *_fk_checks(),
        *_numeric_checks(),
        *_domain_checks(),
        _missing_value_check(),
        _status_check(),
        *_sequence_checks(),
        *_geolocation_checks(),
        *_category_checks(),
    ], numbers=NUMBERS)
