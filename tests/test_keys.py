"""Key counts shared by all checks, and how often a report reads its tables."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shopmill.operators.cleaning import CLEANERS
from shopmill.operators.guards import rows_with_repeated_hash
from shopmill.plans import keys as K, quality as A, validate as V
from shopmill.plans.checks import key_sizes
from shopmill.plans.investigate import ITEM_IDENTITY, ITEM_KEY
from shopmill.plans.warehouse import Warehouse
from shopmill.sources import samples
from shopmill.sources.scratch import materialize


@pytest.fixture(scope="module")
def raw(spark, sample):
    """The raw tables as files, so that plans show every read of them."""
    return {name: materialize(df, f"raw_{name}") for name, df in samples.raw_tables(spark, sample).items()}


@pytest.fixture(scope="module")
def clean(raw):
    return {name: materialize(df, f"clean_{name}") for name, df in Warehouse(raw).clean.items()}


def reads(df, tables):
    """Scans of every table in the optimised plan."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    paths = Counter()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.nodeName().startswith("LogicalRelation") or "Relation" in leaf.nodeName():
            paths[leaf.relation().location().rootPaths().apply(0).getName()] += 1
    names = {t: frame._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0)
             .relation().location().rootPaths().apply(0).getName() for t, frame in tables.items()}
    return {t: paths[name] for t, name in names.items()}


def test_counts_of_keys_in_several_tables(spark):
    parents = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    children = spark.createDataFrame([("a",), ("c",), ("c",), (None,), (None,)], "k string")
    counts = K.key_counts({"p": parents, "c": children}, K.relationship_keys([("c", "k", "p", "k")], {"p": "k"}))
    assert {r.value: (r.n_p, r.n_c) for r in counts.collect()} == {"a": (2, 1), "b": (1, 0), "c": (0, 2), None: (1, 2)}
    assert tuple(counts.agg(*K.uniqueness("k", "p", "p")).first()) == (4, 1, 1)
    assert tuple(counts.agg(*K.orphans("k", "c", "p", "c")).first()) == (3, 2)
    empty = K.key_counts({"p": parents.limit(0), "c": children.limit(0)}, [K.plain("p", "k"), K.plain("c", "k")])
    assert tuple(empty.agg(*K.uniqueness("k", "p", "p"), *K.orphans("k", "c", "p", "c")).first()) == (0, 0, 0, 0, 0)


def test_joined_texts_differ_where_values_do(spark):
    rows = [("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("ab", None), ("-", "-"), (None, None), ("1:a", ""), ("", "1:a")]
    df = spark.createDataFrame(rows, "p string, q string")
    for text in (K.joined("p", "q"), K.digest(df, "p", "q")):
        assert df.select(text.alias("t")).distinct().count() == len(rows)
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert zeros.select(K.digest(zeros, "x").alias("t")).distinct().count() == 1


def test_repeated_transactions_are_those_that_agree_in_full(spark, clean):
    items = clean["order_items"].unionAll(clean["order_items"].limit(7)).unionAll(clean["order_items"].limit(3))
    items = items.withColumn("seller_id", F.when(F.col("price") > 500, F.col("seller_id")))
    found = K.key_counts({"order_items": items}, V._item_keys(items)).agg(*V._item_key_measures()).first()
    groups = key_sizes(rows_with_repeated_hash(items, *ITEM_IDENTITY), *ITEM_IDENTITY)
    assert found.transaction_duplicates == groups.agg(F.sum(F.col("n") - 1)).first()[0] >= 10


def test_relationships_of_missing_and_childless_parents(spark, raw):
    customers = spark.createDataFrame([("c1",), ("c2",), (None,)], "customer_id string")
    orders = spark.createDataFrame([("o1", "c1"), ("o2", "c1"), ("o3", None), ("o4", "x")], "order_id string, customer_id string")
    rows = {r.relationship: tuple(r)[1:] for r in A.relationship_cardinality(
        {**raw, "customers": customers, "orders": orders}).collect()}
    assert rows["customers → orders"] == (3, 2, 0, 1, 2, 0.67)
    none = {r.relationship: tuple(r)[1:] for r in A.relationship_cardinality(
        {**raw, "customers": customers.limit(0)}).collect()}
    assert none["customers → orders"] == (0, 0, 0, 0, None, None)


def test_the_audit_reads_each_table_twice(spark, raw):
    report = A.quality_report(raw)
    first = reads(A.audit_keys(raw), raw)
    second = reads(report, raw)
    assert all(first[t] + second[t] <= 2 for t in raw) and all(second[t] for t in raw)
    apart = [A.pk_quality(raw), A.fk_quality(raw), A.numeric_quality(raw), A.domain_quality(raw),
             A.date_sequence_quality(raw["orders"]), A.category_translation_coverage(raw["products"], raw["translation"])]
    rows = {r["check"]: r for r in report.collect()}
    for row in (r for frame in apart for r in frame.collect()):
        assert rows[row["check"]] == row


def test_the_audit_finds_what_is_broken(spark, raw):
    broken = {
        **raw,
        "orders": raw["orders"].unionAll(raw["orders"].limit(2)),
        "payments": raw["payments"].withColumn("payment_type", F.when(F.col("payment_sequential") == 1, "cash")),
        "reviews": raw["reviews"].withColumn("review_score", F.lit("six")).withColumn("order_id", F.lit("nobody")),
    }
    rows = {r["check"]: r for r in A.quality_report(broken).collect()}
    assert (rows["orders.order_id uniqueness"].status, rows["orders.order_id uniqueness"]["count"]) == ("FAIL", 2)
    assert rows["payments.payment_type validity"].details == "Observed types=['cash']; unexpected types=['cash']"
    assert rows["reviews.order_id → parent key"]["count"] == raw["reviews"].count()
    assert rows["reviews.review_score valid (1-5)"].status == "PASS"  # what does not parse is missing


def test_the_validation_reads_raw_tables_once_and_cleaned_ones_twice(spark, raw, clean):
    report = V.processed_data_validation(raw, clean)
    assert set(reads(report, raw).values()) == {1} and max(reads(report, clean).values()) <= 2
    apart = [V.row_count_preservation(raw, clean), V.processed_pk(clean), V.processed_fk(clean), V.processed_numeric(clean),
             V.delivery_metric_consistency(clean), V.processed_business_keys(clean), V.derived_field_recompute(clean)]
    rows = {r["check"]: r for r in report.collect()}
    parts = [r for frame in apart for r in frame.collect()]
    assert len(rows) == len(parts) + 1 and all(rows[r["check"]] == r for r in parts)


def test_lost_rows_of_every_table_are_named(spark, raw, clean):
    short = {t: df.limit(5) for t, df in clean.items()}
    rows = {r["check"]: r for r in V.processed_data_validation(raw, short).collect()}
    assert {rows[f"{t} row-count preservation"].status for t in CLEANERS} == {"FAIL"}


def test_groups_of_keys_hold_no_more_counters_than_tables_share_a_kind(spark):
    tables = {t: spark.createDataFrame(rows, "k string, l string") for t, rows in {
        "a": [("x", "x"), ("x", None)], "b": [("x", "y"), (None, "x")], "c": [("z", "y")]}.items()}
    keys = [K.plain("a", "k"), K.plain("b", "k"), K.plain("b", "l"), K.plain("c", "l"), K.plain("c", "m"), K.plain("a", "m")]
    tables = {t: df.withColumn("m", F.lit("x")) for t, df in tables.items()}
    counts = K.key_counts(tables, keys)
    assert counts.columns == ["kind", "value", "n_a", "n_b", "n_c"]
    assert {tuple(r) for r in counts.collect()} == {
        ("k", "x", 2, 1, 0), ("k", None, 0, 1, 0), ("l", "y", 0, 1, 1), ("l", "x", 0, 1, 0), ("m", "x", 2, 0, 1)}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("partial_count(") == 2


def test_repeated_items_are_counted_where_their_values_are_checked(spark, clean):
    items = clean["order_items"].limit(500)
    more = items.unionAll(items.limit(9)).unionAll(items.limit(4)).unionAll(
        items.limit(2).withColumn("price", F.lit(-1.0))).unionAll(items.limit(1).withColumn("price", F.lit(-0.0))).unionAll(
        items.limit(1).withColumn("price", F.lit(0.0))).unionAll(items.limit(3).withColumn("order_id", F.lit(None).cast("string")))
    rules = {"negative": F.col("price") < 0, "free": F.col("price") == 0, "unknown": F.lit(None).cast("boolean")}
    found = K.repeats(more, ITEM_KEY, ITEM_IDENTITY, rules, "item").first()
    plain = K.key_counts({"order_items": more}, V._item_keys(more)).agg(*V._item_key_measures()).first()
    assert (found.item_key_repeats, found.item_row_repeats) == tuple(plain) == (9 + 4 + 4, 9 + 4 + 1)
    assert (found.item_rows, found.negative, found.unknown) == (520, 2, 0) and found.free == more.where("price = 0").count()
    assert tuple(K.repeats(more.limit(0), ITEM_KEY, ITEM_IDENTITY, rules, "item").first()) == (0,) * 6


def test_the_validation_shuffles_each_item_key_once(spark, raw, clean):
    plan = V.processed_data_validation(raw, clean)._jdf.queryExecution().optimizedPlan().toString()
    assert "transaction" not in plan and plan.count("RepartitionByExpression [order_id") == 1
