import datetime as dt

from pyspark.sql import functions as F

from shopmill.operators import cleaning as C
from shopmill.sources.readers import read_raw_table, read_raw_tables
from shopmill.sources.schemas import RAW_COLUMNS

import pytest


def write(tmp_path, table, *rows, bom=False):
    path = tmp_path / f"{table}.csv"
    text = "\n".join([",".join(RAW_COLUMNS[table]), *rows]) + "\n"
    path.write_text(("﻿" if bom else "") + text, encoding="utf-8")
    return str(path)


def orders(spark, tmp_path, *rows):
    return C.clean_orders(read_raw_table(spark, "orders", write(tmp_path, "orders", *rows)))


def test_orders(spark, tmp_path):
    rows = {r["order_id"]: r for r in orders(
        spark, tmp_path,
        "a,ca,delivered,2017-01-01 10:00:00,2017-01-01 11:00:00,2017-01-02 10:00:00,2017-01-05 22:00:00,2017-01-05 00:00:00",
        "b,cb,delivered,2017-10-15 00:30:00,,2017-10-14 10:00:00,2017-10-20 00:05:00,2017-10-20 00:00:00",
        "c,cc,canceled,2017-02-03 00:00:00,2017-02-04 00:00:00,2017-02-03 12:00:00,,2017-02-20 00:00:00",
        "d,cd,NA,not a time,,,2017-02-03 00:00:00,",
    ).collect()}
    a, b, c, d = (rows[k] for k in "abcd")
    assert (a.order_purchase_date, a.order_purchase_year, a.order_purchase_month, a.order_purchase_month_num,
            a.order_purchase_day, a.order_purchase_weekday) == (dt.date(2017, 1, 1), 2017, "2017-01", 1, 1, "Sunday")
    assert (a.delivery_days, a.estimated_delivery_days, a.delivery_delay_days, a.is_late) == (4.5, 3.58, 0.92, True)
    assert (a.is_delivered, a.is_canceled, a.has_date_quality_issue) == (True, False, False)
    # Five minutes late rounds to 0.00 days: not late.
    assert (b.delivery_delay_days, b.is_late, b.flag_carrier_before_purchase, b.has_date_quality_issue) == (
        0.0, False, True, True)
    assert (c.is_late, c.flag_carrier_before_approval, c.flag_carrier_before_purchase, c.is_canceled) == (
        None, True, False, True)
    # Nothing parses: flags stay NULL or FALSE, never an error; delivered without an estimate is not late.
    assert (d.order_purchase_timestamp, d.order_purchase_month, d.is_delivered, d.is_late, d.delivery_days) == (
        None, None, None, False, None)


def test_items(spark, tmp_path):
    path = write(tmp_path, "order_items",
                 " a ,1,p,s,2017-01-01 00:00:00,10.0,2.5", "a,2.0,p,s,bad,0,5", "a,x,p,s,,,1")
    rows = C.clean_order_items(read_raw_table(spark, "order_items", path)).orderBy("freight_value").collect()
    assert [(r.order_id, r.order_item_id, r.item_total_value, r.freight_ratio) for r in rows] == [
        ("a", None, None, None), ("a", 1, 12.5, 0.25), ("a", 2, 5.0, None)]


def test_payments(spark, tmp_path):
    path = write(tmp_path, "payments", "a,1,voucher,0,5", "a,2,voucher,2.0,-1", "a,3,null,,")
    rows = C.clean_payments(read_raw_table(spark, "payments", path)).orderBy("payment_sequential").collect()
    assert [(r.payment_type, r.payment_installments, r.has_valid_payment_value) for r in rows] == [
        ("voucher", None, True), ("voucher", 2, False), (None, None, False)]


def test_reviews_with_line_breaks_and_quotes(spark, tmp_path):
    path = write(tmp_path, "reviews",
                 'r1,a,5,,"two\nlines, ""quoted"""," 2017-01-01 00:00:00","2017-01-02 00:00:00"',
                 'r2,a,4.0,t,"   ",2017-01-01 00:00:00,2017-01-02 00:00:00',
                 "r3,a,,t,,x,2017-01-02 00:00:00")
    rows = C.clean_reviews(read_raw_table(spark, "reviews", path)).orderBy("review_id").collect()
    assert [(r.review_score, r.review_comment_message, r.has_review_comment) for r in rows] == [
        (5, 'two\nlines, "quoted"', True), (4, None, False), (None, None, False)]


def test_zip_keeps_leading_zero(spark, tmp_path):
    path = write(tmp_path, "customers", "c,u,01037,\tsao paulo ,SP")
    row = C.clean_customers(read_raw_table(spark, "customers", path)).first()
    assert (row.customer_zip_code_prefix, row.customer_city) == ("01037", "sao paulo")


def test_products_round_whole_columns(spark, tmp_path):
    path = write(tmp_path, "products", "p,cat,40.0,2.5,3.5,100.5,1,2,x", "q,,,,,,,,")
    p, q = C.clean_products(read_raw_table(spark, "products", path)).orderBy("product_id").collect()
    assert (p.product_name_lenght, p.product_description_lenght, p.product_photos_qty, p.product_weight_g,
            p.product_width_cm) == (40, 2, 4, 100.5, None)
    assert q.product_category_name is None


def test_geolocation_keeps_duplicates(spark, tmp_path):
    path = write(tmp_path, "geolocation", "01037,-23.5,-46.6,x,SP", "01037,-23.5,-46.6,x,SP")
    assert C.clean_geolocation(read_raw_table(spark, "geolocation", path)).count() == 2


def test_byte_order_mark_is_not_part_of_the_header(spark, tmp_path):
    path = write(tmp_path, "translation", "beleza_saude,health_beauty", bom=True)
    row = C.clean_category_translation(read_raw_table(spark, "translation", path)).first()
    assert row.asDict() == {"product_category_name": "beleza_saude", "product_category_name_english": "health_beauty"}


def test_missing_path_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_raw_table(spark, "orders", str(tmp_path / "nothing.csv")).count()


def test_raw_tables_by_name(spark, tmp_path):
    path = write(tmp_path, "sellers", "s,01,city,ST")
    assert list(read_raw_tables(spark, {"sellers": path})) == ["sellers"]
    with pytest.raises(ValueError, match="unknown"):
        read_raw_tables(spark, {"buyers": path})


def test_cleaners_add_no_exchange(spark, sample):
    from shopmill.sources import samples
    raw = samples.raw_tables(spark, sample)
    for table in ("orders", "order_items", "payments", "reviews", "products", "sellers", "geolocation"):
        plan = C.CLEANERS[table](raw[table])._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, table
