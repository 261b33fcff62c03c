"""Raw tables -> cleaned tables -> star schema -> marts, wired lazily.

A mart that needs two columns of a fact should not pay for the joins behind the
others, so facts can be asked for with only the parts that are read.  A stored
model (`store`) is the other way to the same end: the six tables are written once
and the marts scan just their columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from shopmill.operators import model as M
from shopmill.operators.cleaning import clean_all
from shopmill.operators.guards import fail_on_failures, join_cardinality_guard, require_unique, unique_side
from shopmill.plans import calendar, investigate, operations, products, quality, rfm, sales, validate
from shopmill.sources.meter import Meter
from shopmill.sources.scratch import materialize
from shopmill.sources.writers import export_marts, save_csv, save_folder, stored_tables


class Warehouse:
    """Lazy views of one set of raw tables; `clean` may be given as stored tables.

    With `guarded`, every join side whose key must be unique asserts so in the plan that reads it; without,
    callers run `require_unique_keys` first, as `build_all` does.
    """

    def __init__(
        self, raw: Mapping[str, DataFrame], clean: Mapping[str, DataFrame] | None = None, guarded: bool = False
    ):
        self.raw = raw
        self.clean = clean if clean is not None else clean_all(raw)
        self.guarded = guarded

    def _side(self, table: str, key: str) -> DataFrame:
        df = self.clean[table]
        return unique_side(df, key, name=table) if self.guarded else df

    # --- facts with the parts a query reads --------------------------------------

    def items(self, products: bool = False, sellers: bool = False) -> DataFrame:
        return M.fact_order_items(
            self.clean["order_items"],
            self._side("products", "product_id") if products else None,
            self._side("translation", "product_category_name") if products else None,
            self._side("sellers", "seller_id") if sellers else None,
        )

    def with_products(self, df: DataFrame) -> DataFrame:
        return M.add_products(
            df, self._side("products", "product_id"), self._side("translation", "product_category_name"))

    def with_sellers(self, df: DataFrame) -> DataFrame:
        return M.add_sellers(df, self._side("sellers", "seller_id"))

    @cached_property
    def items_agg(self) -> DataFrame:
        return M.agg_order_items(self.items())

    @cached_property
    def payments_agg(self) -> DataFrame:
        return M.agg_order_payments(self.clean["payments"])

    @cached_property
    def reviews_agg(self) -> DataFrame:
        return M.agg_order_reviews(self.clean["reviews"])

    def orders(
        self, customers: bool = False, items: bool = False, payments: bool = False, reviews: bool = False
    ) -> DataFrame:
        return M.fact_orders(
            self.clean["orders"],
            self._side("customers", "customer_id") if customers else None,
            self.items_agg if items else None,
            self.payments_agg if payments else None,
            self.reviews_agg if reviews else None,
        )

    @cached_property
    def dim_customers(self) -> DataFrame:
        return M.dim_customers(self.orders(customers=True, items=True), self.clean["customers"])

    # --- the six model tables --------------------------------------------------------

    @cached_property
    def model(self) -> dict[str, DataFrame]:
        return {
            "fact_order_items": self.items(products=True, sellers=True),
            "agg_order_items": self.items_agg,
            "agg_order_payments": self.payments_agg,
            "agg_order_reviews": self.reviews_agg,
            "fact_orders": self.orders(customers=True, items=True, payments=True, reviews=True),
            "dim_customers": self.dim_customers,
        }

    def guarded_keys(self) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
        """Every join side that must be unique, by the name of the join."""
        c = self.clean
        return {
            "items x products": (c["products"], ("product_id",)),
            "items x sellers": (c["sellers"], ("seller_id",)),
            "items x translation": (c["translation"], ("product_category_name",)),
            "payments x payment types": (self.payments_agg, ("order_id",)),
            "orders x customers": (c["customers"], ("customer_id",)),
            "orders x item aggregate": (self.items_agg, ("order_id",)),
            "orders x payment aggregate": (self.payments_agg, ("order_id",)),
            "orders x review aggregate": (self.reviews_agg, ("order_id",)),
            "customers x profiles": (M.customer_profile(c["customers"]), ("customer_unique_id",)),
        }

    def cardinality_report(self) -> DataFrame:
        return join_cardinality_guard(self.guarded_keys())

    def require_unique_keys(self) -> None:
        """Stop with the offending key if a key that joins rely on repeats.

        Aggregates are unique by construction; the keys of the cleaned tables are not.
        """
        c = self.clean
        for table, key in (*quality.PRIMARY_KEYS.items(), ("translation", "product_category_name")):
            require_unique(c[table], key, name=table)

    def store(self, save=materialize) -> dict[str, DataFrame]:
        """Write each model table once, later ones from the stored earlier ones."""
        c = self.clean
        out = {"fact_order_items": save(self.items(products=True, sellers=True), "fact_order_items")}
        out["agg_order_items"] = save(M.agg_order_items(out["fact_order_items"]), "agg_order_items")
        out["agg_order_payments"] = save(self.payments_agg, "agg_order_payments")
        out["agg_order_reviews"] = save(self.reviews_agg, "agg_order_reviews")
        out["fact_orders"] = save(M.fact_orders(
            c["orders"], c["customers"], out["agg_order_items"], out["agg_order_payments"],
            out["agg_order_reviews"]), "fact_orders")
        out["dim_customers"] = save(M.dim_customers(out["fact_orders"], c["customers"]), "dim_customers")
        return out


def product_seller_marts(items: DataFrame) -> dict[str, DataFrame]:
    return {
        "category_performance": products.category_performance(items),
        "product_performance": products.product_performance(items),
        "seller_performance": products.seller_performance(items),
        "seller_category_performance": products.seller_category_performance(items),
        "seller_state_performance": products.seller_state_performance(items),
    }


def operations_marts(items: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    return {
        "operations_summary": operations.operations_summary(orders),
        "monthly_operations": operations.monthly_operations(orders),
        "customer_state_operations": operations.customer_state_operations(orders),
        "delivery_review_performance": operations.delivery_review_performance(orders),
        "review_score_distribution": operations.review_score_distribution(orders),
        "category_operations": operations.category_operations(items),
        "seller_delivery_performance": operations.seller_delivery_performance(items, orders),
        "seller_state_operations": operations.seller_state_operations(items, orders),
    }


def stored_marts(marts: Mapping[str, DataFrame], save=materialize) -> dict[str, DataFrame]:
    """Write marts one after the other: the exchanges of one are gone before the next begins, checks read the finished rows."""
    return {name: save(df, name) for name, df in marts.items()}


def build_marts(model: Mapping[str, DataFrame], reference_date=None, stored: bool = True) -> dict[str, DataFrame]:
    """The fifteen marts over a model; `stored` says the model tables are stored."""
    items, orders = model["fact_order_items"], model["fact_orders"]
    return {
        "customer_rfm": rfm.customer_rfm(model["dim_customers"], reference_date, stored=stored),
        **product_seller_marts(items),
        **operations_marts(items, orders),
        "dim_date": calendar.dim_date(orders),
    }


def audit_reports(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Profiles and extracts of the raw tables, by name of the report."""
    orders, items = raw["orders"], raw["order_items"]
    without = {name: investigate.orders_without(orders, raw[table]) for name, table in (
        ("items", "order_items"), ("payments", "payments"), ("reviews", "reviews"))}
    return {
        "table_inventory": quality.table_inventory(raw),
        "missing_values": quality.missing_values(raw),
        "missing_by_status": quality.missing_by_status(orders),
        "date_quality": quality.date_quality_report(orders),
        "relationship_cardinality": quality.relationship_cardinality(raw),
        "geolocation_quality": quality.geolocation_quality(raw["geolocation"]),
        "untranslated_categories": quality.untranslated_categories(raw["products"], raw["translation"]),
        "order_status_distribution": quality.order_status_distribution(orders),
        "unexpected_payment_types": quality.unexpected_payment_types(raw["payments"]),
        "invalid_payment_installments": investigate.invalid_payment_installments(raw["payments"]),
        "invalid_date_sequences": investigate.invalid_date_sequences(orders),
        **{f"orders_without_{name}": df for name, df in without.items()},
        "multiple_reviews_per_order": investigate.multiple_reviews_per_order(raw["reviews"]),
        "order_item_key_duplicates": investigate.order_item_key_duplicates(items),
        "order_item_duplicate_key_groups": investigate.order_item_duplicate_key_groups(items),
        "transactional_duplicates": investigate.transactional_duplicates(items),
        "business_key_summary": investigate.business_key_summary(items),
    }


def audit_summaries(reports: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Counts over stored reports."""
    sequences = reports["invalid_date_sequences"]
    return {
        "quality_status_counts": quality.quality_status_counts(reports["data_quality_results"]),
        "anomaly_counts_by_type": investigate.anomaly_counts_by_type(sequences),
        "anomaly_counts_by_status": investigate.anomaly_counts_by_status(sequences),
        **{f"orders_without_{name}_by_status": investigate.status_distribution(reports[f"orders_without_{name}"])
           for name in ("items", "payments", "reviews")},
        "review_count_distribution": investigate.review_count_distribution(reports["multiple_reviews_per_order"]),
    }


def presentation_tables(model: Mapping[str, DataFrame], marts: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The sales queries, the segment summary and the top-ten tables, from the stored model and marts."""
    items, orders, items_agg = model["fact_order_items"], model["fact_orders"], model["agg_order_items"]
    return {
        "total_product_revenue": sales.total_product_revenue(items),
        "total_orders": sales.total_orders(orders),
        "unique_customers": sales.unique_customers(model["dim_customers"]),
        "average_order_value": sales.average_order_value(items_agg),
        "monthly_revenue": sales.monthly_revenue(orders.drop("product_revenue"), items_agg),
        "monthly_order_volume": sales.monthly_order_volume(orders),
        "revenue_by_category": sales.revenue_by_category(items),
        "revenue_by_state": sales.revenue_by_state(orders),
        "rfm_segment_summary": rfm.rfm_segment_summary(marts["customer_rfm"]),
        "top_categories": products.top_categories(marts["category_performance"]),
        "top_products": products.top_products(marts["product_performance"]),
        "top_sellers": products.top_sellers(marts["seller_performance"]),
        "top_customer_states": operations.top_customer_states(marts["customer_state_operations"]),
    }


def build_all(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    folder: str,
    reference_date=None,
    expected_segments: int = 8,
) -> dict[str, DataFrame]:
    """Audit, clean, model, marts, validation and export below `folder`.

    Each stage is written once and read back by the next; a FAIL in the model,
    catalog, sales, mart or date checks stops the run.  Findings on the raw and cleaned
    data are reported, not fatal.  Whether a table exists is read from the folder.
    """
    def saved(stage: str):
        def save(df: DataFrame, name: str) -> DataFrame:
            return spark.read.schema(df.schema).parquet(save_folder(df, f"{folder}/{stage}", name))
        return save

    def report(df: DataFrame, name: str) -> DataFrame:
        return saved("reports")(df, name)

    audit = {name: report(df, name) for name, df in audit_reports(raw).items()}
    audit["data_quality_results"] = report(quality.quality_report(raw), "data_quality_results")
    for name, df in audit_summaries(audit).items():
        report(df, name)

    clean = {table: saved("processed")(df, table) for table, df in clean_all(raw).items()}
    report(validate.row_count_comparison(raw, clean), "row_count_comparison")
    report(validate.processed_data_validation(raw, clean, stored_tables(spark, f"{folder}/processed")),
           "processed_data_validation")

    house = Warehouse(raw, clean)
    house.require_unique_keys()
    meter = Meter(saved("model"), validate.TABLE_MEASURES)
    model = house.store(meter)
    fail_on_failures(report(validate.model_validation(
        model, {"fact_order_items": clean["order_items"], "fact_orders": clean["orders"]}),
        "analytical_layer_validation"), "model")

    meter.save = saved("marts")
    marts = {name: meter(df, name) for name, df in build_marts(model, reference_date).items()}
    items, orders = model["fact_order_items"], model["fact_orders"]
    listed = stored_tables(spark, f"{folder}/marts")
    people = clean["customers"].select("customer_unique_id").where("customer_unique_id IS NOT NULL").distinct()
    gates = {
        "catalog": validate.catalog_validation(
            {**model, **marts}, validate.expected_counts(clean, model),
            [*stored_tables(spark, f"{folder}/model"), *listed], meter.counted),
        "sales": validate.sales_reconciliation(model, clean["orders"], people),
        "product_seller": validate.product_seller_validation(items, marts, listed),
        "operations": validate.operations_validation(items, orders, marts, listed),
        "date": validate.date_dim_validation(orders, marts["dim_date"], listed),
    }
    for name, checks in gates.items():
        fail_on_failures(report(checks, f"{name}_validation"), name)
    fail_on_failures(report(validate.rfm_validation(
        marts["customer_rfm"], model["dim_customers"], expected_segments, listed), "rfm_validation"), "rfm")
    for name, df in presentation_tables(model, marts).items():
        saved("presentation")(df, name)

    tables = {**model, **marts}
    export = export_marts(spark, tables, f"{folder}/export")
    save_csv(report(export, "export_row_counts"), f"{folder}/export/row_counts", single_file=True)
    return tables
