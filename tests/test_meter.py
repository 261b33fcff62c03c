"""Counts taken while writing, and the checks that use them."""
import re
import time

import __spark_entry__ as entry_module
from pyspark.sql import functions as F

from shopmill.plans import validate as V
from shopmill.sources.meter import Meter, rows_written
from shopmill.sources.scratch import materialize
from shopmill.sources.writers import EXPORT_TABLES, export_marts, save_csv, save_folder


def scans(df) -> int:
    """Files scanned by the plan; reused exchanges do not scan again."""
    return len(re.findall(r"^\S*\(\d+\) Scan parquet|^\(\d+\) Scan parquet", df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")), re.M))


def test_meter_counts_what_is_written(spark):
    meter = Meter(materialize, {"t": lambda: [F.sum("n").alias("total")]})
    df = spark.range(1000).select((F.col("id") % 7).alias("n")).repartition(5)
    assert meter(df, "t").count() == 1000 and meter(df.where("n > 6"), "empty").count() == 0
    assert meter.counted == {"t": {"rows": 1000, "total": sum(k % 7 for k in range(1000))}, "empty": {"rows": 0}}
    assert [tuple(r) for r in rows_written(spark, meter.counted).collect()] == [("t", 1000), ("empty", 0)]


def test_meter_counts_once_behind_joins_and_shuffles(spark):
    left = spark.range(300).withColumn("k", F.col("id") % 10)
    df = left.join(spark.range(5).withColumnRenamed("id", "k"), "k").groupBy("k").count()
    meter = Meter()
    meter(df, "t")
    assert meter.counted["t"]["rows"] == 5


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if "shuffle_" in (name := files.apply(i).getName())}


def test_a_written_table_leaves_no_exchange(spark, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(3, "k").groupBy("k").count()
    for write in (lambda: materialize(df, "t"), lambda: save_folder(df, str(tmp_path), "t"),
                  lambda: save_csv(df, f"{tmp_path}/csv")):
        before = shuffle_files(spark)
        write()
        until = time.time() + 5  # executors drop the files a moment later
        while (left := shuffle_files(spark) - before) and time.time() < until:
            time.sleep(0.1)
        assert not left and spark.conf.get(key) == setting


def test_mart_checks_read_stored_marts(spark, sample):
    for name, scanned in (("product_seller_validation", 3 + 4), ("operations_validation", 3 + 7)):
        checks = entry_module.queries()[name](spark, sample)
        assert scans(checks) <= scanned and not checks.where("status <> 'PASS'").count()


def test_export_counts_rows_with_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "São\nPaulo"), (2, 'a "quoted",\r\nname'), (3, None)], "id long, city string")
    found = export_marts(spark, {name: rows for name in EXPORT_TABLES}, str(tmp_path))
    assert {r["table_name"]: r["row_count"] for r in found.collect()} == {name: 3 for name in EXPORT_TABLES}
    back = spark.read.schema(rows.schema).option("header", True).option("multiLine", True).option("escape", '"').csv(
        f"{tmp_path}/dim_customers")
    assert back.count() == 3 and {r["city"] for r in back.collect()} == {r["city"] for r in rows.collect()}


def test_catalog_validation_reads_each_source_once(spark, sample):
    house = entry_module.Sample(spark, sample)
    tables, counted = house.warehouse()
    assert set(counted) == set(V.CATALOG_TABLES)
    assert {t: counted[t]["rows"] for t in tables} == {t: df.count() for t, df in tables.items()}
    clean = {t: materialize(df, t) for t, df in house.clean.items()}
    checks = V.catalog_validation(tables, V.expected_counts(clean, tables), counted=counted)
    assert scans(checks) <= 12
    assert not checks.where("status <> 'PASS'").count()
    read_again = V.catalog_validation(tables, V.expected_counts(clean, tables))
    assert sorted(checks.collect()) == sorted(read_again.collect())


def test_catalog_validation_sees_lost_and_doubled_rows(spark, sample):
    house = entry_module.Sample(spark, sample)
    tables, counted = house.warehouse()
    expected = V.expected_counts(house.clean, tables)
    short = {**counted, "product_performance": {"rows": counted["product_performance"]["rows"] - 1}}
    failed = V.catalog_validation(tables, expected, counted=short).where("status = 'FAIL'").collect()
    assert [r["check"] for r in failed] == ["product_performance row count"]
    doubled = {**tables, "agg_order_payments": tables["agg_order_payments"].unionAll(tables["agg_order_payments"])}
    rest = {t: c for t, c in counted.items() if t != "agg_order_payments"}
    failed = {r["check"] for r in V.catalog_validation(doubled, expected, counted=rest).where("status = 'FAIL'").collect()}
    assert failed == {"agg_order_payments row count", "agg_order_payments grain"}


def test_stored_tables_follow_the_folder(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/a.parquet")
    house, built = entry_module.Sample.__new__(entry_module.Sample), []
    house.spark, house.folder, house.keyed = spark, str(tmp_path), True
    for _ in range(2):
        house._once("test", lambda meter: built.append(1) or {})
    assert len(built) == 1
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/a.parquet")
    house._once("test", lambda meter: built.append(1) or {})
    assert len(built) == 2
