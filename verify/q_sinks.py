"""Exports: all columns, and the place of every row in the written files."""

from __future__ import annotations

from basketry.session import scratch_path
from basketry.sources import sinks
from verify.oracle_base import b, r, t
from verify.q_core import ITEM_SQL, ORDER_SQL
from verify.q_reports import _BEHAVIOR, _PAIR, _PATTERN, _SCORE, BUCKET
from verify.registry import add


def _export(function, table: str):
    def run(w, s, d):
        path = scratch_path(s, "export")
        out = function(w[table], path)
        return sinks.read_ordered(s, path, out.schema)

    return run


def _placed(statement: str, order: str) -> str:
    return f"select *, row_number() over (order by {order}) as position from ({statement})"


add("snk1_export_orders", _export(sinks.export_orders, "fct_order"), _placed(ORDER_SQL, "order_ts_utc, order_sk"))
add("snk2_export_order_items", _export(sinks.export_order_items, "fct_order_item"), _placed(ITEM_SQL, "order_ts_utc, order_item_sk"))
add(
    "snk3_export_kpis",
    _export(sinks.export_category_kpis, "rpt_kpi_long"),
    _placed(
        f"select {t('mon', 'order_month')}, metric as metric_name, cat as item_category, {r('val', 'metric_value')} from kpi",
        "order_month, item_category, metric_name",
    ),
)
add(
    "snk4_export_scorecard",
    _export(sinks.export_category_scorecard, "rpt_category_scorecard"),
    _placed(_SCORE, "revenue_eur desc, category nulls first"),
)
add("snk5_export_customer_promo", _export(sinks.export_customer_promo, "rpt_customer_promo"), _placed(_BEHAVIOR, "customer_sk"))
add(
    "snk6_export_pairs",
    _export(sinks.export_pair_affinity, "rpt_product_pairs"),
    f"select a as product_a, b as product_b, k as pair_orders, ka as product_a_orders, kb as product_b_orders, tot as total_orders, {_PAIR}, "
    f"cat_a as category_a, cat_b as category_b, {_PATTERN} as pattern, {BUCKET} as actionability_bucket, {b('rk', 'actionability_rank')}, "
    "row_number() over (order by rk, lift desc, k desc, a, b) as position from prod_pairs",
)
