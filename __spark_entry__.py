"""Registered queries: every operator over the sample tables, and its SQL counterpart."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle.sql import oracle_queries  # noqa: E402
from shopmill.functions import exprs as X  # noqa: E402
from shopmill.operators import cleaning as C, model as M  # noqa: E402
from shopmill.operators.guards import fail_on_failures  # noqa: E402
from shopmill.plans import (  # noqa: E402
    calendar as D, investigate as I, operations as O, products as P, quality as A, rfm as R, sales as Q,
    validate as V,
)
from shopmill.plans.warehouse import (  # noqa: E402
    Warehouse, build_marts, operations_marts, product_seller_marts, stored_marts,
)
from shopmill.sources import samples  # noqa: E402
from shopmill.sources.meter import Meter  # noqa: E402
from shopmill.sources.scratch import materialize, scratch_folder  # noqa: E402
from shopmill.sources.writers import export_marts, table_row_counts  # noqa: E402

try:
    from shopmill.llm import queries as corpus
except ImportError as missing:  # the subpackage is optional
    if not (missing.name or "").startswith(("shopmill.llm", "corpus_pipeline")):
        raise
    corpus = None

SMOKE_FOLDER = "/root/testdata/sf0.001"

class Sample(Warehouse):
    """The warehouse over one folder of sample tables."""

    _stored: dict[tuple, tuple[dict[str, DataFrame], Meter]] = {}

    def __init__(self, spark: SparkSession, folder: str, keyed: bool = True):
        super().__init__(samples.raw_tables(spark, folder, keyed))
        self.spark, self.folder, self.keyed = spark, folder, keyed

    def _once(self, what: str, build: Callable[[Meter], dict[str, DataFrame]]) -> tuple[dict[str, DataFrame], Meter]:
        """Tables written once for each session and state of the folder, and what was counted on the way."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.folder)
        state = files.agg(F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).first()[0]
        key = (self.spark.sparkContext.applicationId, self.folder, state, self.keyed, what)
        if key not in Sample._stored:
            meter = Meter(materialize, V.TABLE_MEASURES)
            Sample._stored[key] = build(meter), meter
        return Sample._stored[key]

    @property
    def stored_model(self) -> dict[str, DataFrame]:
        """The six model tables.

        Validators compare many aggregates of the same tables, so they run over
        the stored tables, as they would in production, not over the whole lineage.
        """
        return self._once("model", self.store)[0]

    def warehouse(self) -> tuple[dict[str, DataFrame], dict[str, dict]]:
        """All stored tables of the finished warehouse, and what was counted while they were written."""
        model, counts = self._once("model", self.store)
        marts, more = self._once("marts", lambda meter: {
            name: meter(df, name) for name, df in build_marts(model).items()})
        return {**model, **marts}, {**counts.counted, **more.counted}


def _safe_percentage(w: Sample) -> DataFrame:
    """Late share per status; statuses without a delivery have nothing to compare with."""
    return w.orders().groupBy("order_status").agg(
        F.count_if("is_late").alias("late"), F.count("is_late").alias("delivered"),
    ).withColumn("late_percentage", X.safe_percentage("late", "delivered"))


def _model_validation(w: Sample) -> DataFrame:
    return V.model_validation(
        w.stored_model, {"fact_order_items": w.raw["order_items"], "fact_orders": w.raw["orders"]})


def _export(w: Sample) -> DataFrame:
    return export_marts(w.spark, w.warehouse()[0], f"{scratch_folder(w.spark)}/export")


def _catalog_validation(w: Sample) -> DataFrame:
    tables, counted = w.warehouse()
    return V.catalog_validation(tables, V.expected_counts(w.clean, w.stored_model), counted=counted)


# Queries over the keyed sample tables.
QUERIES: dict[str, Callable[[Sample], DataFrame]] = {
    # sinks and counts
    "export_marts": _export,
    "table_row_counts": lambda w: table_row_counts(w.stored_model),
    # cleaning
    "clean_string": lambda w: C.clean_string(
        w.raw["reviews"], "review_comment_title", "review_comment_message",
    ).select("review_id", "review_comment_title", "review_comment_message"),
    "clean_orders": lambda w: w.clean["orders"],
    "order_calendar_fields": lambda w: w.clean["orders"].select(
        "order_id", "order_purchase_date", "order_purchase_year", "order_purchase_month",
        "order_purchase_month_num", "order_purchase_day", "order_purchase_weekday"),
    "order_status_flags": lambda w: w.clean["orders"].select(
        "order_id", "is_delivered", "is_canceled", "is_unavailable"),
    "delivery_durations": lambda w: w.clean["orders"].select(
        "order_id", "delivery_days", "estimated_delivery_days", "delivery_delay_days"),
    "late_flag": lambda w: w.clean["orders"].select("order_id", "is_late"),
    "lifecycle_anomaly_flags": lambda w: w.clean["orders"].select(
        "order_id", *[flag for flag, _, _ in C.LIFECYCLE_FLAGS]),
    "has_date_quality_issue": lambda w: w.clean["orders"].select("order_id", "has_date_quality_issue"),
    "clean_order_items": lambda w: w.clean["order_items"],
    "clean_payments": lambda w: w.clean["payments"],
    "clean_reviews": lambda w: w.clean["reviews"],
    "clean_customers": lambda w: w.clean["customers"],
    "clean_products": lambda w: w.clean["products"],
    "clean_sellers": lambda w: w.clean["sellers"],
    "clean_geolocation": lambda w: w.clean["geolocation"],
    "clean_category_translation": lambda w: w.clean["translation"],
    # model
    "fact_order_items": lambda w: w.items(products=True, sellers=True),
    "product_category_fallback": lambda w: M.add_products(
        w.clean["products"].select("product_id"), w.clean["products"], w.clean["translation"],
    ).select("product_id", "product_category_name", "product_category_name_english", "product_category"),
    "agg_order_items": lambda w: w.items_agg,
    "agg_order_payments": lambda w: w.payments_agg,
    "payment_types": lambda w: w.payments_agg.select("order_id", "payment_types"),
    "agg_order_reviews": lambda w: w.reviews_agg,
    "fact_orders": lambda w: w.orders(customers=True, items=True, payments=True, reviews=True),
    "order_freight_ratio": lambda w: w.orders(items=True).select("order_id", "freight_ratio"),
    "revenue_payment_difference": lambda w: w.orders(items=True, payments=True).select(
        "order_id", "revenue_payment_difference"),
    "order_presence_flags": lambda w: w.orders(items=True, payments=True, reviews=True).select(
        "order_id", "has_items", "has_payment", "has_review"),
    "dim_customers": lambda w: w.dim_customers,
    "customer_profile": lambda w: M.customer_profile(w.clean["customers"]),
    "join_cardinality_guard": lambda w: w.cardinality_report(),
    # sales
    "total_product_revenue": lambda w: Q.total_product_revenue(w.items()),
    "total_orders": lambda w: Q.total_orders(w.orders()),
    "unique_customers": lambda w: Q.unique_customers(w.dim_customers),
    "average_order_value": lambda w: Q.average_order_value(w.items_agg),
    "monthly_revenue": lambda w: Q.monthly_revenue(w.orders(), w.items_agg),
    "monthly_order_volume": lambda w: Q.monthly_order_volume(w.orders()),
    "revenue_by_category": lambda w: Q.revenue_by_category(w.items(products=True)),
    "revenue_by_state": lambda w: Q.revenue_by_state(w.orders(customers=True, items=True)),
    # customers
    "rfm_base": lambda w: R.rfm_base(w.dim_customers),
    "rfm_recency_score": lambda w: R.rfm_recency_score(w.dim_customers),
    "rfm_monetary_score": lambda w: R.rfm_monetary_score(w.dim_customers),
    "rfm_frequency_score": lambda w: R.rfm_frequency_score(R.rfm_base(w.dim_customers)).select(
        "customer_unique_id", "frequency", "frequency_score"),
    "rfm_segment": lambda w: R.customer_rfm(w.dim_customers).select(
        "customer_unique_id", "rfm_score", "customer_segment"),
    "customer_rfm": lambda w: R.customer_rfm(w.dim_customers),
    "rfm_segment_summary": lambda w: R.rfm_segment_summary(R.customer_rfm(w.dim_customers)),
    # products and sellers
    "category_performance": lambda w: P.category_performance(w.items(products=True)),
    "product_performance": lambda w: P.product_performance(w.items(), w.with_products),
    "seller_performance": lambda w: P.seller_performance(w.items(), w.with_sellers),
    "seller_category_performance": lambda w: P.seller_category_performance(w.items(products=True, sellers=True)),
    "seller_state_performance": lambda w: P.seller_state_performance(w.items(sellers=True)),
    "top_categories": lambda w: P.top_categories(P.category_performance(w.items(products=True))),
    "top_products": lambda w: P.top_products(P.product_performance(w.items(), w.with_products)),
    "top_sellers": lambda w: P.top_sellers(P.seller_performance(w.items(), w.with_sellers)),
    # operations
    "operations_summary": lambda w: O.operations_summary(w.orders()),
    "monthly_operations": lambda w: O.monthly_operations(w.orders()),
    "customer_state_operations": lambda w: O.customer_state_operations(
        w.orders(customers=True, items=True, reviews=True)),
    "delivery_review_performance": lambda w: O.delivery_review_performance(w.orders(items=True, reviews=True)),
    "review_score_distribution": lambda w: O.review_score_distribution(w.orders(reviews=True)),
    "category_operations": lambda w: O.category_operations(w.items(products=True)),
    "seller_delivery_performance": lambda w: O.seller_delivery_performance(
        w.items(), w.orders(reviews=True), w.with_sellers),
    "seller_state_operations": lambda w: O.seller_state_operations(w.items(sellers=True), w.orders()),
    "top_customer_states": lambda w: O.top_customer_states(
        O.customer_state_operations(w.orders(customers=True, items=True, reviews=True))),
    # calendar
    "date_range": lambda w: D.date_range(w.orders()),
    "date_series": lambda w: D.date_series(w.orders()),
    "dim_date": lambda w: D.dim_date(w.orders()),
    "dim_date_sample": lambda w: D.dim_date_sample(D.dim_date(w.orders())),
    "dim_date_bounds": lambda w: D.dim_date_bounds(D.dim_date(w.orders())),
    # audit of the raw tables
    "table_inventory": lambda w: A.table_inventory(w.raw),
    "pk_quality": lambda w: A.pk_quality(w.raw),
    "fk_quality": lambda w: A.fk_quality(w.raw),
    "numeric_quality": lambda w: A.numeric_quality(w.raw),
    "domain_quality": lambda w: A.domain_quality(w.raw),
    "missing_values": lambda w: A.missing_values(w.raw),
    "missing_by_status": lambda w: A.missing_by_status(w.raw["orders"]),
    "timestamp_parse_quality": lambda w: A.timestamp_parse_quality(w.raw["orders"]),
    "date_sequence_quality": lambda w: A.date_sequence_quality(w.raw["orders"]),
    "relationship_cardinality": lambda w: A.relationship_cardinality(w.raw),
    "geolocation_quality": lambda w: A.geolocation_quality(w.raw["geolocation"]),
    "untranslated_categories": lambda w: A.untranslated_categories(w.raw["products"], w.raw["translation"]),
    "category_translation_coverage": lambda w: A.category_translation_coverage(
        w.raw["products"], w.raw["translation"]),
    "order_status_distribution": lambda w: A.order_status_distribution(w.raw["orders"]),
    "quality_report": lambda w: A.quality_report(w.raw),
    "quality_status_counts": lambda w: A.quality_status_counts(A.quality_report(w.raw)),
    "safe_percentage": _safe_percentage,
    # extracts
    "invalid_payment_installments": lambda w: I.invalid_payment_installments(w.raw["payments"]),
    "invalid_date_sequences": lambda w: I.invalid_date_sequences(w.raw["orders"]),
    "anomaly_counts_by_type": lambda w: I.anomaly_counts_by_type(I.invalid_date_sequences(w.raw["orders"])),
    "anomaly_counts_by_status": lambda w: I.anomaly_counts_by_status(I.invalid_date_sequences(w.raw["orders"])),
    "orders_without_items": lambda w: I.orders_without(w.raw["orders"], w.raw["order_items"]),
    "orders_without_payments": lambda w: I.orders_without(w.raw["orders"], w.raw["payments"]),
    "orders_without_reviews": lambda w: I.orders_without(w.raw["orders"], w.raw["reviews"]),
    "orders_without_items_by_status": lambda w: I.status_distribution(
        I.orders_without(w.raw["orders"], w.raw["order_items"])),
    "orders_without_payments_by_status": lambda w: I.status_distribution(
        I.orders_without(w.raw["orders"], w.raw["payments"])),
    "orders_without_reviews_by_status": lambda w: I.status_distribution(
        I.orders_without(w.raw["orders"], w.raw["reviews"])),
    "multiple_reviews_per_order": lambda w: I.multiple_reviews_per_order(w.raw["reviews"]),
    "review_count_distribution": lambda w: I.review_count_distribution(
        I.multiple_reviews_per_order(w.raw["reviews"])),
    # validation
    "row_count_preservation": lambda w: V.row_count_preservation(w.raw, w.clean),
    "row_count_comparison": lambda w: V.row_count_comparison(w.raw, w.clean),
    "processed_pk": lambda w: V.processed_pk(w.clean),
    "processed_fk": lambda w: V.processed_fk(w.clean),
    "processed_numeric": lambda w: V.processed_numeric(w.clean),
    "delivery_metric_consistency": lambda w: V.delivery_metric_consistency(w.clean),
    "processed_business_keys": lambda w: V.processed_business_keys(w.clean),
    "derived_field_recompute": lambda w: V.derived_field_recompute(w.clean),
    "processed_data_validation": lambda w: V.processed_data_validation(w.raw, w.clean),
    "model_validation": _model_validation,
    "catalog_validation": _catalog_validation,
    "grain_check": lambda w: V.grain_check(w.stored_model),
    "sales_reconciliation": lambda w: V.sales_reconciliation(
        w.stored_model, w.raw["orders"], w.raw["customers"].select("customer_unique_id").distinct()),
    "rfm_validation": lambda w: V.rfm_validation(
        R.customer_rfm(w.stored_model["dim_customers"], stored=True), w.stored_model["dim_customers"]),
    "product_seller_validation": lambda w: V.product_seller_validation(
        w.stored_model["fact_order_items"], stored_marts(product_seller_marts(w.stored_model["fact_order_items"]))),
    "operations_validation": lambda w: V.operations_validation(
        w.stored_model["fact_order_items"], w.stored_model["fact_orders"],
        stored_marts(operations_marts(w.stored_model["fact_order_items"], w.stored_model["fact_orders"]))),
    "date_dim_validation": lambda w: V.date_dim_validation(
        w.stored_model["fact_orders"], D.dim_date(w.stored_model["fact_orders"])),
    "fail_on_failures": lambda w: fail_on_failures(_model_validation(w), "model"),
}

# Queries over the sample whose item keys repeat.
DUPLICATE_KEY_QUERIES: dict[str, Callable[[Sample], DataFrame]] = {
    "order_item_key_duplicates": lambda w: I.order_item_key_duplicates(w.raw["order_items"]),
    "order_item_duplicate_key_groups": lambda w: I.order_item_duplicate_key_groups(w.raw["order_items"]),
    "transactional_duplicates": lambda w: I.transactional_duplicates(w.raw["order_items"].unionAll(
        w.raw["order_items"].where("price = 0.0"))),
    "business_key_summary": lambda w: I.business_key_summary(w.raw["order_items"]),
}


def entry(spark: SparkSession) -> DataFrame:
    return queries()["revenue_by_category"](spark, SMOKE_FOLDER)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def over(query: Callable[[Sample], DataFrame], keyed: bool):
        return lambda spark, folder: query(Sample(spark, folder, keyed))

    return {
        **{name: over(query, True) for name, query in QUERIES.items()},
        **{name: over(query, False) for name, query in DUPLICATE_KEY_QUERIES.items()},
        **(corpus.QUERIES if corpus else {}),
    }


def oracle_sql() -> dict[str, str]:
    return oracle_queries() | (corpus.SQL if corpus else {})
