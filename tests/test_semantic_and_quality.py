import datetime as dt

import pytest

from basketry.plans import quality, semantic
from tests.helpers import rows
from verify.registry import warehouse

SF = "/root/testdata/sf0.001"


def test_inventory_sizes():
    assert len(semantic.MODELS) == 6
    assert sum(len(m.measures) for m in semantic.MODELS) == 40
    assert len(semantic.METRICS) == 24
    marts = {k: v for k, v in semantic.COLUMN_METRICS.items() if k != "fct_order_item"}
    assert sum(len(v) for v in marts.values()) == 75 and len(semantic.COLUMN_METRICS["fct_order_item"]) == 6
    for metric in semantic.METRICS.values():
        semantic.model_of(metric.measure)


def test_every_metric_runs(spark):
    w = warehouse(spark, SF)
    row = semantic.metric_query(w, list(semantic.METRICS)).first().asDict()
    assert row["total_orders"] == w["fct_order"].count() and row["order_item_rows"] == w["fct_order_item"].count()
    for table in semantic.COLUMN_METRICS:
        assert semantic.column_metrics(w[table], table).count() == 1


def test_foreign_dimension_does_not_multiply(spark):
    w = warehouse(spark, SF)
    by = semantic.metric_query(w, ["order_item_rows"], ["customer__first_order_contains_promo_flag"])
    assert sum(r[1] for r in rows(by)) == w["fct_order_item"].count()


def test_unknown_dimension_is_refused(spark):
    w = warehouse(spark, SF)
    with pytest.raises(ValueError):
        semantic.metric_query(w, ["units_sold"], ["c_name"])
    with pytest.raises(ValueError):
        semantic.metric_query(w, ["units_sold"], ["promo__promo_type"])


def test_shares_sum_to_one(spark):
    monthly = warehouse(spark, SF)["rpt_category_monthly"].groupBy("order_month").sum("revenue_share").collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in monthly)


def test_checks_on_small_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    parent = spark.createDataFrame([("a",)], "p string")
    assert quality.not_null(df, "k").count() == 1
    assert rows(quality.unique(df, "k")) == [("a", 2)]
    assert rows(quality.relationship(df, "k", parent, "p")) == [("b",)]


def test_reconciliation_reasons(spark):
    raw = spark.createDataFrame(
        [("ok", "3.00"), ("dup", "1"), ("dup", "1"), ("bad", "x"), ("off", "9")], "purchase_key string, total_basket_value string"
    )
    orders = spark.createDataFrame(
        [(k, k, None) for k in ("ok", "dup", "bad", "off", "gone")], "order_sk string, purchase_key string, total_basket_value_eur decimal(18,4)"
    )
    items = spark.createDataFrame(
        [("ok", 1.5), ("ok", 1.5), ("dup", 1.0), ("off", 1.0)], "order_sk string, v double"
    ).selectExpr("order_sk", "cast(v as decimal(18,4)) as order_item_row_final_amount_gross_eur")
    got = {r.purchase_key: r.failure_reason for r in quality.revenue_reconciliation(raw, orders, items).collect()}
    assert got == {
        "dup": "duplicate_raw_purchase_key_rows", "bad": "raw_total_basket_value_unparsable",
        "off": "derived_vs_raw_value_mismatch", "gone": "missing_raw_purchase_key",
    }


def test_invalid_windows(spark):
    d = dt.date
    promos = spark.createDataFrame(
        [("a", d(2023, 1, 1), d(2023, 1, 2), 10), ("b", d(2023, 1, 2), d(2023, 1, 2), 10), ("c", d(2023, 1, 1), d(2023, 1, 2), 101)],
        "item_key string, promo_start_date date, promo_end_date date, discount_pct long",
    )
    assert sorted(r.item_key for r in quality.invalid_promo_windows(promos).collect()) == ["b", "c"]
