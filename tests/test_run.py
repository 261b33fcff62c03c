"""CSV files in, audited and validated tables, marts and exports out."""
from shopmill.plans import validate
from shopmill.plans.warehouse import build_all
from shopmill.sources import samples
from shopmill.sources.readers import read_raw_tables, read_tables
from shopmill.sources.writers import stored_tables


def test_build_all_from_csv(spark, sample, tmp_path):
    raw_folder = tmp_path / "raw"
    paths = {}
    for table, df in samples.raw_tables(spark, sample).items():
        paths[table] = str(raw_folder / table)
        text = df.select([df[c].cast("string").alias(c) for c in df.columns])
        text.write.option("header", True).option("escape", '"').csv(paths[table])
    out = str(tmp_path / "out")
    tables = build_all(spark, read_raw_tables(spark, paths), out)
    assert len(tables) == 21 and tables["fact_orders"].count() == 1500

    report = spark.read.parquet(f"{out}/reports/data_quality_results")
    assert report.count() == 27 and report.where("status = 'FAIL'").count() == 0
    counts = {r.table_name: r.row_count for r in spark.read.parquet(f"{out}/reports/export_row_counts").collect()}
    assert len(counts) == 16 and counts["fact_order_items"] == 6000 and counts["dim_customers"] == 1196
    reports = stored_tables(spark, f"{out}/reports")
    assert len(reports) == 37 and {"catalog_validation", "missing_values", "business_key_summary"} <= set(reports)
    assert stored_tables(spark, f"{out}/presentation") == [
        "average_order_value", "monthly_order_volume", "monthly_revenue", "revenue_by_category", "revenue_by_state",
        "rfm_segment_summary", "top_categories", "top_customer_states", "top_products", "top_sellers",
        "total_orders", "total_product_revenue", "unique_customers"]
    # The gate sees what is in the folder: a table that is not there fails it.
    clean = read_tables(spark, f"{out}/processed", stored_tables(spark, f"{out}/processed"))
    listed = [name for name in tables if name != "dim_date"]
    lost = validate.catalog_validation(tables, validate.expected_counts(clean, tables), listed)
    assert [r.check for r in lost.where("status = 'FAIL'").collect()] == ["Expected tables exist"]
    # Reading text and reading typed columns lead to the same facts.
    direct = samples.raw_tables(spark, sample)["order_items"].agg({"price": "sum"}).first()[0]
    assert abs(tables["category_performance"].agg({"revenue": "sum"}).first()[0] - direct) < 0.01
