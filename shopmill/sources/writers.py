"""Table and report sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from shopmill.sources.meter import Meter, rows_written
from shopmill.sources.scratch import dropping_exchanges


def save_folder(df: DataFrame, folder: str, name: str, partition_by: Sequence[str] = ()) -> str:
    """Replace the parquet table `folder/name`."""
    path = f"{folder.rstrip('/')}/{name}"
    with dropping_exchanges(df.sparkSession):
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def stored_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parquet tables in a folder, from the listing of their files."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True).load(folder))
    names = files.select(F.element_at(F.split("path", "/"), -2).alias("name")).distinct()
    return sorted(row["name"] for row in names.collect())


def save_table(
    df: DataFrame,
    name: str,
    bucket_by: str | None = None,
    buckets: int = 0,
) -> DataFrame:
    """Create or replace a catalog table.

    Bucketing the item and order facts on `order_id` lets later joins and
    per-order aggregates between them run without an exchange.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if bucket_by and buckets:
        writer = writer.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Headered, comma-separated files; one file only for tables of bounded size."""
    out = df.coalesce(1) if single_file else df
    with dropping_exchanges(df.sparkSession):
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) for each table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# The tables handed to the dashboard, in export order.
EXPORT_TABLES = (
    "fact_orders", "fact_order_items", "dim_date", "dim_customers", "customer_rfm",
    "category_performance", "product_performance", "seller_performance",
    "operations_summary", "monthly_operations", "delivery_review_performance",
    "review_score_distribution", "customer_state_operations",
    "seller_delivery_performance", "seller_state_operations", "category_operations",
)

# Marts whose row count is bounded by a small domain (months, states, scores, days).
SINGLE_FILE_TABLES = frozenset((
    "dim_date", "operations_summary", "monthly_operations",
    "delivery_review_performance", "review_score_distribution",
    "customer_state_operations", "seller_state_operations",
))


def export_marts(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write the export tables as CSV; (table_name, row_count) of what was written, counted while writing."""
    missing = [name for name in EXPORT_TABLES if name not in tables]
    if missing:
        raise ValueError(f"tables missing from the export: {missing}")

    def save(df: DataFrame, name: str) -> DataFrame:
        save_csv(df, f"{folder.rstrip('/')}/{name}", name in SINGLE_FILE_TABLES)
        return df

    meter = Meter(save)
    for name in EXPORT_TABLES:
        meter(tables[name], name)
    return rows_written(spark, meter.counted)
