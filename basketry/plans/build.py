"""The build as an ordered list of tables: what each reads, how it is made, and whether it is stored.

A `view` stays a lazy DataFrame. A `table` is written once to shared storage and read back, which keeps the
plans of its readers short and lets a lost executor recompute only the last step. Of a large table in the scratch folder only the
columns are stored that no others give; the rest, hex keys above all, is worked out by those who read it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from basketry.config import Settings
from basketry.operators import curation, enrich, history, staging
from basketry.operators.upsert import NEXT, drop_staged, recover, take_place
from basketry.plans import audit, core, reporting
from basketry.session import materialize, scratch_path
from basketry.sources.sinks import LAYOUTS, write_table_layout

RAW = ("raw_item_logs", "raw_promos", "raw_purchases", "raw_baskets")


# the tables that readers outside the build use
MARTS = (
    "fct_order", "fct_order_item", "dim_item_history", "dim_item_current", "dim_promo", "dim_customer", "rpt_category_monthly",
    "rpt_kpi_long", "rpt_kpi_mom", "rpt_category_scorecard", "rpt_star_products", "rpt_daypart", "rpt_category_pairs",
    "rpt_product_pairs", "rpt_customer_promo", "rpt_multi_category_items", "aud_item_log_curation", "aud_item_log_curation_summary",
    "aud_order_item_match", "aud_order_item_match_summary", "aud_promo_coverage", "aud_promo_coverage_summary", "aud_promo_anomaly",
    "aud_promo_anomaly_summary", "aud_price_anomaly", "aud_price_anomaly_summary", "aud_row_flow", "aud_row_flow_summary",
    "aud_issue_details", "aud_control_status",
)


@dataclass(frozen=True)
class Model:
    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    stored: bool = False
    # columns worked out from the rows that are stored
    derive: Callable[[DataFrame], DataFrame] | None = None


def models(cfg: Settings, run_ts: dt.datetime) -> list[Model]:
    """Models in build order; every input is raw or listed earlier."""

    def m(name: str, inputs: str, make: Callable[..., DataFrame], stored: bool = False,
          derive: Callable[[DataFrame], DataFrame] | None = None) -> Model:
        return Model(name, tuple(inputs.split()), make, stored, derive)

    def with_tables(function: Callable[..., DataFrame], inputs: str) -> Callable[..., DataFrame]:
        names = inputs.split()
        return lambda *dfs: function(dict(zip(names, dfs)))

    flow_inputs = (
        "raw_purchases stg_purchases int_purchases stg_order_items int_priced int_promoted fct_order_item fct_order "
        "raw_item_logs stg_item_logs int_item_logs int_item_scd2 dim_item_history dim_item_current raw_promos "
        "stg_promos dim_promo aud_item_log_curation_summary"
    )
    issue_inputs = (
        "aud_item_log_curation aud_order_item_match aud_promo_coverage aud_promo_anomaly aud_price_anomaly "
        "aud_row_flow raw_purchases fct_order fct_order_item"
    )
    control_inputs = (
        "aud_item_log_curation_summary aud_order_item_match_summary aud_promo_coverage_summary "
        "aud_promo_anomaly_summary aud_price_anomaly_summary aud_row_flow_summary aud_issue_details"
    )
    return [
        m("stg_item_logs", "raw_item_logs", staging.stage_item_logs),
        m("stg_promos", "raw_promos", staging.stage_promos),
        m("stg_purchases", "raw_purchases", lambda r: staging.stage_purchase_logs(r, cfg)),
        m("stg_order_items", "raw_baskets", staging.explode_basket, True),
        m("int_item_logs", "stg_item_logs", lambda s: curation.curate_item_logs(s, cfg), True),
        m("int_purchases", "stg_purchases", lambda s: curation.curate_purchases(s, cfg), True),
        m("int_item_scd2", "int_item_logs", lambda c: history.item_scd2(c, cfg.split_unit, cfg.rows_per_task), True),
        m("int_priced", "stg_order_items int_purchases int_item_scd2",
          lambda i, p, h: core.order_items_with_price(i, p, h, cfg, disjoint=True)),
        m("int_promo_segments", "stg_promos", core.keyed_promo_segments, True),
        m("int_promoted", "stg_order_items int_purchases int_item_scd2 int_promo_segments",
          lambda i, p, h, s: core.promoted_rows(i, p, h, s, cfg), True, core.promoted_columns),
        m("int_order_rollups", "int_purchases int_promoted", lambda p, i: enrich.orders_with_rollups(p, i, cfg)),
        m("fct_order_item", "int_promoted", core.fct_order_item),
        m("fct_order", "int_purchases int_promoted", lambda p, i: enrich.rollup_rows(p, i, cfg), True,
          lambda r: core.fct_order(enrich.rollup_columns(r), cfg)),
        m("dim_item_history", "int_item_scd2", core.dim_item_history),
        m("dim_item_current", "dim_item_history", core.dim_item_current),
        m("dim_promo", "stg_promos", core.dim_promo),
        m("dim_customer", "fct_order", core.dim_customer, True),
        m("int_order_categories", "fct_order_item fct_order", reporting.order_category_rows, True,
          reporting.order_category_columns),
        m("rpt_category_monthly", "fct_order_item fct_order int_order_categories", reporting.category_monthly, True),
        m("rpt_kpi_long", "rpt_category_monthly", reporting.category_kpi_long),
        m("rpt_kpi_mom", "rpt_kpi_long", reporting.category_kpi_mom),
        m("rpt_category_scorecard", "fct_order_item int_order_categories", reporting.category_scorecard),
        m("rpt_star_products", "fct_order_item", reporting.star_products),
        m("rpt_daypart", "fct_order_item", lambda i: reporting.category_daypart_monthly(i, cfg)),
        m("rpt_category_pairs", "fct_order_item", lambda i: reporting.category_pairs(i, cfg)),
        m("rpt_product_pairs", "fct_order_item", lambda i: reporting.product_pairs(i, cfg), True),
        m("rpt_customer_promo", "fct_order_item fct_order", reporting.customer_promo_behavior, True),
        m("rpt_multi_category_items", "fct_order_item", reporting.items_in_several_categories),
        m("aud_item_log_curation", "raw_item_logs stg_item_logs int_item_logs", audit.item_log_curation, True),
        m("aud_item_log_curation_summary",
          "aud_item_log_curation raw_item_logs stg_item_logs int_item_logs int_item_scd2 dim_item_history "
          "dim_item_current", lambda *t: audit.item_log_curation_summary(*t, cfg=cfg), True),
        m("aud_order_item_match", "fct_order_item", audit.order_item_match),
        m("aud_order_item_match_summary", "aud_order_item_match", lambda a: audit.order_item_match_summary(a, cfg)),
        m("aud_promo_coverage", "dim_promo dim_item_current", audit.promo_item_coverage),
        m("aud_promo_coverage_summary", "aud_promo_coverage", lambda a: audit.promo_item_coverage_summary(a, cfg)),
        m("aud_price_anomaly", "int_item_logs", lambda c: audit.item_price_anomalies(c, run_ts, cfg.split_unit), True),
        m("aud_price_anomaly_summary", "aud_price_anomaly", lambda a: audit.item_price_anomaly_summary(a, cfg)),
        m("aud_promo_anomaly", "dim_promo", lambda p: audit.promo_discount_anomalies(p, run_ts)),
        m("aud_promo_anomaly_summary", "aud_promo_anomaly", lambda a: audit.promo_discount_anomaly_summary(a, cfg)),
        m("aud_row_flow", flow_inputs, with_tables(lambda t: audit.row_flow(t, run_ts), flow_inputs), True),
        m("aud_row_flow_summary", "aud_row_flow", lambda f: audit.row_flow_summary(f, cfg)),
        m("aud_issue_details", issue_inputs, with_tables(lambda t: audit.issue_details(t, run_ts), issue_inputs), True),
        m("aud_control_status", control_inputs,
          with_tables(lambda t: audit.control_status(t, run_ts, cfg), control_inputs)),
    ]


class Warehouse(Mapping):
    """Tables by name, made when first asked for from the raw feeds."""

    def __init__(self, raw: Mapping[str, DataFrame], cfg: Settings = Settings(),
                 run_ts: dt.datetime = dt.datetime(2024, 1, 1), layout: bool = False, root: str | None = None):
        """With `layout` stored tables are partitioned by date as declared in `LAYOUTS`.

        With `root` they are published as `root/<name>`, each replaced as a whole once its new version is complete; without it
        they lie in the session's scratch folder under names of their own.
        """
        self._layout, self._root = layout, root
        self._models = {m.name: m for m in models(cfg, run_ts)}
        self._made: dict[str, DataFrame] = dict(raw)
        self._raw = tuple(raw)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            model = self._models[name]
            df = model.make(*[self[i] for i in model.inputs])
            derive = model.derive or (lambda rows: rows)
            if self._layout or self._root is not None:
                # tables that others read, or that are sorted by their keys, have all columns
                df, derive = derive(df), lambda rows: rows
            self._made[name] = derive(self._store(name, df) if model.stored else df)
        return self._made[name]

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        dated = self._layout and name in LAYOUTS
        if self._root is None:
            return write_table_layout(df, scratch_path(spark, name), name) if dated else materialize(df, name)
        path = f"{self._root}/{name}"
        recover(spark, path)
        drop_staged(spark, path)
        if dated:
            written = write_table_layout(df, path + NEXT, name)
        else:
            df.write.mode("overwrite").parquet(path + NEXT)
            written = df
        take_place(spark, path)
        return spark.read.schema(written.schema).parquet(path).select(*df.columns)

    def publish(self, names: Sequence[str] = MARTS) -> None:
        """Write marts below `root`, those that are views as well, so that they can be read without this library."""
        if self._root is None:
            raise ValueError("a warehouse without a root has no place to publish to")
        for name in names:
            if not self._models[name].stored:
                self._made[name] = self._store(name, self[name])
            else:
                self[name]

    def __iter__(self):
        return iter((*self._raw, *self._models))

    def __len__(self) -> int:
        return len(self._raw) + len(self._models)

    def build(self) -> None:
        """Make everything, in build order."""
        for name in self._models:
            self[name]
