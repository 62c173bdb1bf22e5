"""Sources, staging, curation, history, joins, enrichment, core marts and incremental processing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import curation, enrich, history, joins, pairs, staging, temporal, upsert
from basketry.functions import parse_event_time
from basketry.plans import core, incremental, quality
from basketry.session import materialize, scratch_path
from basketry.sources import raw as raw_feeds
from basketry.sources import sinks
from basketry.streaming import curate_stream, curated_view
from verify import fixtures as fx
from verify.oracle_base import b, berlin, n, r, t
from verify.registry import CFG, add

D18 = "decimal(18,4)"


# ------------------------------------------------------------------------------------- sources, sinks


def _as_csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def _read_back(spark, path: str, df: DataFrame) -> DataFrame:
    """An exported file with the types of the table it came from."""
    return spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)


add(
    "src1_item_logs",
    lambda w, s, d: raw_feeds.read_item_logs(s, _as_csv(w["raw_item_logs"], "csv-logs")).select(
        "log_item_id", "item_key", "time_log_created_utc",
        F.get_json_object("payload", "$.price_attributes[0].vat_rate_in_percent").alias("vat"),
        F.get_json_object("payload", "$.name[1].value").alias("name_de"),
    ),
    "select log_item_id, item_key, coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' Z', 'bad time') as time_log_created_utc, "
    "case vat when 7 then '7.00' else '19.00' end as vat, de as name_de from raw_logs",
)
add(
    "src2_promos",
    lambda w, s, d: raw_feeds.read_promos(s, _as_csv(w["raw_promos"], "csv-promos")),
    "select coalesce(cast(s as varchar), 'not a date') as promo_start_date, cast(e as varchar) as promo_end_date, item_key, "
    "kind as promo_type, cast(pct as varchar) as discount_in_percentage from stg_promo",
)
add(
    "src3_purchase_logs",
    lambda w, s, d: raw_feeds.read_purchase_logs(s, _as_csv(w["raw_purchases"], "csv-purchases")).select(
        "time_order_received_utc", "purchase_key", "customer_key", "delivery_distance_line_meters", "total_basket_value"
    ),
    "select coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' Z', 'unknown') as time_order_received_utc, purchase_key, "
    "customer_key, cast(distance as varchar) as delivery_distance_line_meters, "
    "coalesce(cast(cast(total as decimal(18,2)) as varchar), 'n/a') as total_basket_value from raw_buys",
)
add(
    "src4_replace_load",
    lambda w, s, d: raw_feeds.write_replace(w["raw_promos"], scratch_path(s, "raw-promos")).groupBy("promo_type").agg(
        F.count(F.lit(1)).alias("row_count")
    ),
    "select kind as promo_type, count(*) as row_count from stg_promo group by all",
)
add(
    "src5_dev_window",
    lambda w, s, d: raw_feeds.dev_date_window(
        w["int_purchases"], "time_order_received_utc",
        type(CFG)(dev_sampling=True, dev_start="1997-11-01", dev_end="1998-02-01"),
    ).select("purchase_key", "time_order_received_utc"),
    f"select purchase_key, {t('ts', 'time_order_received_utc')} from buys where ts >= '1997-11-01' and ts < '1998-02-01'",
)


add(
    "snk7_layout",
    lambda w, s, d: sinks.write_layout(
        w["fct_order_item"], scratch_path(s, "layout"), "order_date", ["order_sk", "item_key_sk"], "month"
    ).groupBy(F.col("part_date").alias("part_month")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("units_in_order_item_row").alias("units")
    ),
    f"select {t('mon', 'part_month')}, count(*) as row_count, {b('sum(units)', 'units')} from items group by mon",
)

# ------------------------------------------------------------------------------------------- staging

add(
    "stg1_item_logs",
    lambda w, s, d: w["stg_item_logs"].drop("payload_raw"),
    f"select log_item_id, item_key, {t('ts', 'time_log_created_utc')}, item_name_en, item_name_de, item_name_preferred, "
    f"brand_name, item_category, number_of_units, weight_in_grams, {n('price', 'product_base_price_gross_eur')}, "
    f"{n('vat_rate_pct')}, {t('src', 'time_item_created_in_source_utc')} from stg_logs",
)
add(
    "stg2_purchases",
    lambda w, s, d: w["stg_purchases"].drop("item_basket_description_raw"),
    f"select purchase_key, customer_key, {t('ts', 'time_order_received_utc')}, {t('ts::date', 'order_date_utc')}, "
    f"cast(cast({berlin('ts')} as date) as varchar) as order_date_berlin, distance as delivery_distance_line_meters, "
    f"{n('service', 'service_fee_eur')}, {n('courier', 'courier_base_fee_eur')}, {n('total', 'total_basket_value_eur')} from raw_buys",
)
add(
    "stg3_explode_basket",
    lambda w, s, d: w["stg_order_items"],
    "select purchase_key, item_key, units as item_count from lines",
)
add(
    "stg4_promos",
    lambda w, s, d: w["stg_promos"],
    f"select item_key, {t('s', 'promo_start_date')}, {t('e', 'promo_end_date')}, kind as promo_type, {b('pct', 'discount_pct')} from stg_promo",
)

# -------------------------------------------------------------------------- curation, change history

EV_COLS = ["log_item_id", "item_key", "time_log_created_utc", "item_category", "product_base_price_gross_eur"]
EV_SQL = f"log_item_id, item_key, {t('ts', 'time_log_created_utc')}, item_category, {n('price', 'product_base_price_gross_eur')}"

add(
    "cur1_event_time",
    lambda w, s, d: curation.drop_null_event_time(w["stg_item_logs"], "time_log_created_utc").groupBy("item_key").agg(
        F.count(F.lit(1)).alias("row_count")
    ),
    "select item_key, count(*) as row_count from stg_logs where ts is not null group by all",
)
add(
    "cur2_best_per_log",
    lambda w, s, d: curation.best_per_log(fx.event_item_logs(s, d)).select(*EV_COLS),
    f"select {EV_SQL} from ev_best",
)
add(
    "cur3_conflicts",
    lambda w, s, d: curation.resolve_conflicts(curation.best_per_log(fx.event_item_logs(s, d))).select(*EV_COLS),
    f"select {EV_SQL} from ev_slot",
)
add(
    "cur4_curated_events",
    lambda w, s, d: curation.curate_item_logs(fx.event_item_logs(s, d)).select(*EV_COLS),
    f"select {EV_SQL} from ev_cur",
)
add(
    "cur4_curated_logs",
    lambda w, s, d: w["int_item_logs"].select(*EV_COLS),
    f"select {EV_SQL} from logs_cur",
)
add(
    "cur5_purchases",
    lambda w, s, d: curation.curate_purchases(w["stg_purchases"], cutoff=dt.datetime(1998, 1, 1)).select(
        "purchase_key", "time_order_received_utc", "order_date_berlin"
    ),
    f"select purchase_key, {t('ts', 'time_order_received_utc')}, {t('day_local', 'order_date_berlin')} from buys where ts >= '1998-01-01'",
)


def _event_states(w, s, d):
    events = curation.curate_item_logs(fx.event_item_logs(s, d))
    return history.with_previous_state(events, "item_key", "time_log_created_utc", ["log_item_id"], history.TRACKED)


add(
    "scd1_state_hash",
    lambda w, s, d: _event_states(w, s, d).select("log_item_id", "attribute_state_hash", "previous_attribute_state_hash"),
    "select log_item_id, st as attribute_state_hash, lag(st) over (partition by item_key order by ts, log_item_id) "
    "as previous_attribute_state_hash from ev_state",
)
add(
    "scd2_change_events",
    lambda w, s, d: history.change_events(_event_states(w, s, d)).select("log_item_id", "attribute_state_hash"),
    "select log_item_id, st as attribute_state_hash from ev_scd",
)
add(
    "scd3_event_windows",
    lambda w, s, d: history.item_scd2(curation.curate_item_logs(fx.event_item_logs(s, d))).select(
        "item_scd_sk", "log_item_id", "valid_from_utc", "valid_to_utc", "is_current", "product_base_price_gross_eur"
    ),
    f"select item_scd_sk, log_item_id, {t('valid_from', 'valid_from_utc')}, {t('valid_to', 'valid_to_utc')}, is_current, "
    f"{n('price', 'product_base_price_gross_eur')} from ev_scd",
)
add(
    "scd3_item_windows",
    lambda w, s, d: w["int_item_scd2"].select(
        "item_scd_sk", "item_key_sk", "item_key", "valid_from_utc", "valid_to_utc", "is_current", "item_category"
    ),
    f"select item_scd_sk, item_key_sk, item_key, {t('valid_from', 'valid_from_utc')}, {t('valid_to', 'valid_to_utc')}, "
    "is_current, item_category from scd",
)

# --------------------------------------------------------------------------------------------- joins

add(
    "jn1_items_purchases",
    lambda w, s, d: w["stg_order_items"].join(w["int_purchases"], "purchase_key").groupBy("customer_key").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("item_count").alias("units")
    ),
    f"select customer_key, count(*) as row_count, {b('sum(units)', 'units')} from lines join buys using (purchase_key) group by all",
)
PRICED = ["order_item_sk", "item_key", "item_scd_sk", "item_unit_base_price_gross_eur", "valid_from_utc"]
PRICED_SQL = (
    f"select order_item_sk, item_key, item_scd_sk, {n('unit_price', 'item_unit_base_price_gross_eur')}, "
    f"{t('valid_from', 'valid_from_utc')} from priced"
)
for strategy in ("broadcast", "asof"):
    add(
        f"jn2_time_valid_{strategy}",
        lambda w, s, d, strategy=strategy: core.order_items_with_price(
            w["stg_order_items"], w["int_purchases"], w["int_item_scd2"], CFG, strategy, disjoint=True
        ).select(*PRICED),
        PRICED_SQL,
    )
for strategy in ("broadcast", "asof"):
    add(
        f"jn3_promo_window_{strategy}",
        lambda w, s, d, strategy=strategy: temporal.apply_promo_segments(
            w["int_priced"], w["int_promo_segments"], cfg=CFG, strategy=strategy
        ).select("order_item_sk", "promo_sk", "promo_type", "discount_pct"),
        f"select order_item_sk, promo_sk, promo_type, {b('pct', 'discount_pct')} from promoted",
    )
add(
    "jn4_order_rollups",
    lambda w, s, d: w["int_order_rollups"].select(
        "order_sk", "total_units_in_order", "distinct_order_item_rows_in_order", "promo_order_item_rows_in_order",
        "promo_units_in_order", "derived_order_items_final_amount_gross_eur",
    ),
    f"select order_sk, {b('n_units', 'total_units_in_order')}, {b('n_rows', 'distinct_order_item_rows_in_order')}, "
    f"{b('p_rows', 'promo_order_item_rows_in_order')}, {b('p_units', 'promo_units_in_order')}, "
    f"{n('final', 'derived_order_items_final_amount_gross_eur')} from ords",
)
add(
    "jn5_affected_keys",
    lambda w, s, d: joins.restrict_to_keys(
        w["fct_order"], w["fct_order"].where("order_ts_utc >= timestamp'2001-07-01'").select("customer_sk"), "customer_sk"
    ).select("order_sk", "customer_sk"),
    "select order_sk, customer_sk from ords where customer_sk in (select customer_sk from ords where ts >= '2001-07-01')",
)
add(
    "jn6_orders_without_items",
    lambda w, s, d: joins.anti(w["fct_order"], w["fct_order_item"], "order_sk").select("order_sk", "purchase_key"),
    "select order_sk, purchase_key from ords where order_sk not in (select order_sk from items)",
)
add(
    "jn7_basket_pairs",
    lambda w, s, d: pairs.basket_pairs(
        w["fct_order_item"].where("item_category is not null"), "order_sk", "item_category"
    ),
    f"select a, b, {b('k', 'pair_orders')} from cat_pairs",
)
add(
    "jn8_attach_pairs",
    lambda w, s, d: pairs.attach_pairs(
        w["fct_order_item"].where("item_category is not null").withColumn("mon", F.trunc("order_date", "month")),
        "order_sk", "item_category", ["mon"],
    ),
    f"select {t('x.mon', 'mon')}, x.c as a, y.c as b, count(*) as pair_orders "
    "from (select distinct mon, order_sk, item_category c from items) x join (select distinct mon, order_sk, item_category c from items) y "
    "on x.order_sk = y.order_sk and x.mon = y.mon and x.c <> y.c group by x.mon, x.c, y.c",
)
add(
    "jn9_with_totals",
    lambda w, s, d: joins.with_totals(
        w["fct_order_item"].groupBy("item_key").agg(F.sum("units_in_order_item_row").alias("units")),
        w["fct_order_item"].agg(F.sum("units_in_order_item_row").alias("all_units")),
    ),
    f"select item_key, {b('sum(units)', 'units')}, {b('(select sum(units) from items)', 'all_units')} from items group by item_key",
)
add(
    "jn10_null_safe_join",
    lambda w, s, d: joins.null_safe_join(
        w["fct_order_item"].groupBy("item_category").agg(F.count(F.lit(1)).alias("row_count")),
        w["fct_order_item"].where("is_promo_item").groupBy("item_category").agg(F.count(F.lit(1)).alias("promo_rows")),
        ["item_category"],
    ),
    "select item_category, count(*) as row_count, nullif(count(*) filter (where is_promo), 0) as promo_rows from items group by all",
)
add(
    "jn11_overlaps",
    lambda w, s, d: quality.overlapping_promos(w["stg_promos"]),
    "with q as (select *, row_number() over (order by item_key, s, e, kind, pct) as rn from stg_promo where s < e), "
    "met as (select a.rn, count(b.rn) as k from q a join q b on a.item_key = b.item_key and a.rn <> b.rn and a.s < b.e and b.s < a.e group by a.rn) "
    f"select item_key, {t('s', 'promo_start_date')}, {t('e', 'promo_end_date')}, kind as promo_type, {b('pct', 'discount_pct')}, "
    f"{b('count(rn)', 'copies')}, {b('max(k)', '"overlaps"')} from q join met using (rn) group by item_key, s, e, kind, pct",
)


def _late_history(w):
    """History whose windows close a day late, so neighbours overlap."""
    late = F.col("valid_to_utc") + F.expr("interval 1 day")
    return w["int_item_scd2"].withColumn("valid_to_utc", F.when(F.col("is_current"), F.col("valid_to_utc")).otherwise(late))


LATE = "(select *, case when is_current then valid_to else valid_to + interval 1 day end as late from scd)"
for strategy in ("broadcast", "asof"):
    add(
        f"jn2_overlapping_history_{strategy}",
        lambda w, s, d, strategy=strategy: core.order_items_with_price(
            w["stg_order_items"], w["int_purchases"], _late_history(w), CFG, strategy
        ).select("order_item_sk", "item_key", "item_scd_sk"),
        "select order_item_sk, p.item_key, h.item_scd_sk from priced p left join "
        f"{LATE} h on p.item_key = h.item_key and p.ts >= h.valid_from and p.ts < h.late "
        "qualify row_number() over (partition by order_item_sk order by h.valid_from desc nulls last, h.late desc, h.log_item_id desc, h.item_scd_sk desc) = 1",
    )
add(
    "jn12_scalar_counts",
    lambda w, s, d: joins.with_totals(
        joins.with_totals(
            w["fct_order"].agg(F.count(F.lit(1)).alias("order_rows")),
            w["fct_order_item"].agg(F.count(F.lit(1)).alias("item_rows")),
        ),
        w["dim_item_current"].agg(F.count(F.lit(1)).alias("current_items")),
    ),
    "select (select count(*) from ords) as order_rows, (select count(*) from items) as item_rows, "
    "(select count(*) from scd where is_current) as current_items",
)

# ---------------------------------------------------------------------------------------- enrichment

add(
    "enr1_amounts",
    lambda w, s, d: w["int_promoted"].select(
        "order_item_sk", "discount_pct_applied", "is_promo_item", "order_item_row_base_amount_gross_eur",
        "item_unit_discount_amount_gross_eur", "item_unit_final_price_gross_eur",
        "order_item_row_discount_amount_gross_eur", "order_item_row_final_amount_gross_eur",
    ),
    f"select order_item_sk, {b('disc', 'discount_pct_applied')}, is_promo as is_promo_item, "
    f"{n('base', 'order_item_row_base_amount_gross_eur')}, {n('unit_disc', 'item_unit_discount_amount_gross_eur')}, "
    f"{n('unit_final', 'item_unit_final_price_gross_eur')}, {n('row_disc', 'order_item_row_discount_amount_gross_eur')}, "
    f"{n('final', 'order_item_row_final_amount_gross_eur')} from items",
)
add(
    "enr1_direct_lines",
    lambda w, s, d: enrich.decompose_amounts(
        fx.table(s, d, "lineitem").select(
            "l_orderkey", "l_linenumber",
            F.col("l_extendedprice").cast("decimal(18,2)").cast(D18).alias("item_unit_base_price_gross_eur"),
            F.col("l_quantity").cast("long").alias("units_in_order_item_row"),
            F.round(F.col("l_discount") * 100).cast("long").alias("discount_pct"),
        )
    ).groupBy("l_orderkey").agg(
        F.sum("order_item_row_final_amount_gross_eur").alias("final_amount"),
        F.count_if("is_promo_item").alias("promo_rows"),
    ),
    "select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2)) * cast(l_quantity as decimal(4,0)) "
    "* (100 - cast(round(l_discount * 100) as decimal(4,0))) * cast(0.01 as decimal(3,2))) as double) as final_amount, "
    "count(*) filter (where l_discount > 0) as promo_rows from lineitem group by all",
)
add(
    "enr2_order_totals",
    lambda w, s, d: enrich.order_totals(w["int_purchases"]).select(
        "order_sk", "basket_plus_service_fee_eur", "total_customer_paid_eur"
    ),
    f"select order_sk, {n('with_service', 'basket_plus_service_fee_eur')}, {n('paid', 'total_customer_paid_eur')} from ords",
)
add(
    "enr3_item_rollup",
    lambda w, s, d: enrich.order_item_rollup(w["int_promoted"]),
    f"select order_sk, count(*) as distinct_order_item_rows_in_order, {b('sum(units)', 'total_units_in_order')}, "
    f"count(*) filter (where is_promo) as promo_order_item_rows_in_order, {b('sum(promo_units)', 'promo_units_in_order')}, "
    f"{n('sum(base)', 'derived_order_items_base_amount_gross_eur')}, {n('sum(row_disc)', 'derived_order_items_discount_amount_gross_eur')}, "
    f"{n('sum(final)', 'derived_order_items_final_amount_gross_eur')} from items group by order_sk",
)
add(
    "enr4_customer_sequence",
    lambda w, s, d: w["int_order_rollups"].select(
        "purchase_key", "customer_order_number", "is_first_order_for_customer", "has_any_promo_units_in_order"
    ),
    "select purchase_key, seq as customer_order_number, is_first as is_first_order_for_customer, "
    "has_promo as has_any_promo_units_in_order from ords",
)

# ---------------------------------------------------------------------------------------- core marts

add(
    "dim1_calendar_orders",
    lambda w, s, d: core.dim_date(s, *fx.date_bounds(w["fct_order"], "order_date")).join(
        w["fct_order"].groupBy("order_date").agg(F.count(F.lit(1)).alias("orders")),
        F.col("date_day") == F.col("order_date"), "left",
    ).drop("order_date").withColumn("orders", F.coalesce("orders", F.lit(0))),
    "select cast(c as varchar) as date_day, year(c) as year, quarter(c) as quarter, month(c) as month, "
    "cast(strftime(c, '%U') as bigint) as week, dayname(c) as day_of_week, dayofweek(c) in (0, 6) as is_weekend, "
    "coalesce(k, 0) as orders from (select unnest(generate_series((select min(order_date) from ords), (select max(order_date) from ords), interval 1 day))::date as c) "
    "left join (select order_date, count(*) as k from ords group by all) on order_date = c",
)
add(
    "dim2_item_history",
    lambda w, s, d: w["dim_item_history"].select(
        "item_scd_sk", "item_key_sk", "item_key", "log_item_id", "valid_from_utc", "valid_to_utc", "is_current",
        "item_name_preferred", "item_category", "brand_name", "number_of_units", "weight_in_grams",
        "product_base_price_gross_eur", "vat_rate_pct", "time_item_created_in_source_utc",
    ),
    f"select item_scd_sk, item_key_sk, item_key, log_item_id, {t('valid_from', 'valid_from_utc')}, {t('valid_to', 'valid_to_utc')}, "
    f"is_current, item_name_preferred, item_category, brand_name, number_of_units, weight_in_grams, "
    f"{n('price', 'product_base_price_gross_eur')}, {n('vat_rate_pct')}, {t('src', 'time_item_created_in_source_utc')} from scd",
)
add(
    "dim3_item_current",
    lambda w, s, d: w["dim_item_current"],
    f"select item_key, item_key_sk, item_scd_sk, item_name_en, item_name_de, item_name_preferred, item_category, brand_name, "
    f"number_of_units, weight_in_grams, {n('price', 'current_product_base_price_gross_eur')}, {n('vat_rate_pct', 'current_vat_rate_pct')}, "
    f"{t('valid_from', 'current_valid_from_utc')} from scd where is_current",
)
add(
    "dim4_promo",
    lambda w, s, d: w["dim_promo"],
    f"select promo_sk, item_key_sk, item_key, kind as promo_type, pct as discount_pct, {t('s', 'promo_start_date')}, "
    f"{t('e', 'promo_end_date')} from promo_dim",
)
CUSTOMER_SQL = (
    f"select customer_sk, customer_key, {t('first_ts', 'first_order_ts_utc')}, {t('last_ts', 'last_order_ts_utc')}, "
    f"n as lifetime_orders, {n('value', 'lifetime_basket_value_eur')}, promo_n as orders_with_promo, "
    "first_promo as first_order_contains_promo_flag from cust"
)
add("dim5_customer", lambda w, s, d: w["dim_customer"], CUSTOMER_SQL)
ORDER_SQL = (
    f"select order_sk, customer_sk, purchase_key, customer_key, {t('ts', 'order_ts_utc')}, {t('ts_local', 'order_ts_berlin')}, "
    f"{t('day_utc', 'order_date_utc')}, {t('order_date')}, hour(ts) as order_hour_utc, hour(ts_local) as order_hour_berlin, "
    f"dayname(order_date) as order_day_name, distance as delivery_distance_line_meters, {n('total', 'total_basket_value_eur')}, "
    f"{n('service', 'service_fee_eur')}, {n('courier', 'courier_base_fee_eur')}, {n('with_service', 'basket_plus_service_fee_eur')}, "
    f"{n('paid', 'total_customer_paid_eur')}, {b('n_units', 'total_units_in_order')}, {b('n_rows', 'distinct_order_item_rows_in_order')}, "
    f"{b('p_rows', 'promo_order_item_rows_in_order')}, {b('p_units', 'promo_units_in_order')}, has_promo as has_any_promo_units_in_order, "
    f"{n('base', 'derived_order_items_base_amount_gross_eur')}, {n('disc', 'derived_order_items_discount_amount_gross_eur')}, "
    f"{n('final', 'derived_order_items_final_amount_gross_eur')}, seq as customer_order_number, "
    "is_first as is_first_order_for_customer from ords"
)
add("fct1_order", lambda w, s, d: w["fct_order"], ORDER_SQL)
ITEM_SQL = (
    f"select order_item_sk, order_sk, customer_sk, purchase_key, customer_key, item_key, item_key_sk, item_scd_sk, promo_sk, "
    f"{t('ts', 'order_ts_utc')}, {t('day_utc', 'order_date_utc')}, {t('order_date')}, units as units_in_order_item_row, "
    f"{n('unit_price', 'item_unit_base_price_gross_eur')}, {b('disc', 'discount_pct_applied')}, "
    f"{n('unit_disc', 'item_unit_discount_amount_gross_eur')}, {n('unit_final', 'item_unit_final_price_gross_eur')}, "
    f"{n('base', 'order_item_row_base_amount_gross_eur')}, {n('row_disc', 'order_item_row_discount_amount_gross_eur')}, "
    f"{n('final', 'order_item_row_final_amount_gross_eur')}, is_promo as is_promo_item, item_name_en, item_name_de, "
    f"item_name_preferred, item_category, brand_name, {n('vat_rate_pct')} from items"
)
add("fct2_order_item", lambda w, s, d: w["fct_order_item"], ITEM_SQL)

# --------------------------------------------------------------------------------------- incremental

SPLIT = dt.datetime(2000, 6, 1)


def _split_orders(w):
    rollups = w["int_order_rollups"]
    early = enrich.orders_with_rollups(w["int_purchases"].where(F.col("time_order_received_utc") < F.lit(SPLIT)), w["int_promoted"], CFG)
    return rollups, core.fct_order(early, CFG)


def _upserted_orders(w, s, d):
    """First load up to a date, then a refresh that starts a week before it."""
    _, target = _split_orders(w)
    return core.refresh_fct_order(target, w["int_purchases"], w["int_promoted"], SPLIT - dt.timedelta(days=7), CFG)


add("ups1_refresh_orders", _upserted_orders, ORDER_SQL)


def _upserted_table(w, s, d):
    path = scratch_path(s, "fct-order")
    rollups, target = _split_orders(w)
    # rows move between the partition of no month and their own, in both directions
    month = lambda n: F.when(F.col("customer_order_number") % n != 0, F.trunc("order_date", "month"))
    keep = ["order_sk", "order_date", "customer_order_number"]
    upsert.upsert_table(s, path, target.select(*keep, month(7).alias("mon")), ["order_sk"], "mon")
    fresh = core.fct_order(rollups.where(F.col("time_order_received_utc") >= F.lit(SPLIT - dt.timedelta(days=7))), CFG)
    return upsert.upsert_table(s, path, fresh.select(*keep, month(5).alias("mon")), ["order_sk"], "mon").select(*keep)


add(
    "ups1_upsert_partitioned",
    _upserted_table,
    f"select order_sk, {t('order_date')}, seq as customer_order_number from ords",
)
add(
    "ups1_refresh_customers",
    lambda w, s, d: core.refresh_dim_customer(
        core.dim_customer(w["fct_order"].where(F.col("order_ts_utc") < F.lit(SPLIT))), w["fct_order"], SPLIT
    ),
    CUSTOMER_SQL,
)
add(
    "ups1_refresh_items_current",
    lambda w, s, d: core.refresh_dim_item_current(
        core.dim_item_current(w["dim_item_history"]), w["dim_item_history"], dt.datetime(1999, 1, 1)
    ).select("item_key", "item_scd_sk"),
    "select item_key, item_scd_sk from scd where is_current",
)
add(
    "ups2_sync_columns",
    lambda w, s, d: upsert.upsert(
        w["fct_order"].where(F.col("order_ts_utc") < F.lit(SPLIT)).select("order_sk", "order_day_name"),
        w["fct_order"].where(F.col("order_ts_utc") >= F.lit(SPLIT)).select("order_sk", "order_hour_utc"),
        ["order_sk"],
    ),
    f"select order_sk, case when ts >= '{SPLIT}' then hour(ts) end as order_hour_utc from ords",
)
NOW = dt.datetime(2024, 1, 1)


def _watermarks(w, s, d):
    store = upsert.WatermarkStore(s, scratch_path(s, "watermarks"), CFG)
    store.ensure()
    store.put("fct_order", w["fct_order"].where(F.col("order_ts_utc") < F.lit(SPLIT)), "order_ts_utc", NOW)
    store.put("fct_order", w["fct_order"], "order_ts_utc", NOW)
    store.put("dim_item_current", w["dim_item_current"], "current_valid_from_utc", NOW)
    store.put("empty", w["fct_order"].where("false"), "order_ts_utc", NOW)
    return store


add(
    "wm1_watermarks",
    lambda w, s, d: _watermarks(w, s, d).table(),
    f"select 'fct_order' as model_name, cast(max(ts) as varchar) as watermark_ts, '{NOW}' as updated_at from ords union all "
    f"select 'dim_item_current', cast(max(valid_from) as varchar), '{NOW}' from scd where is_current",
)


def _after_cutoff(w, s, d):
    store = _watermarks(w, s, d)
    shallow, deep, unknown = store.cutoff("fct_order"), store.cutoff("fct_order", lookback_days=60), store.cutoff("none")
    at = F.col("order_ts_utc")
    return w["fct_order"].agg(
        F.count_if(at >= F.lit(shallow)).alias("in_lookback"),
        F.count_if(at >= F.lit(deep)).alias("in_backfill"),
        F.count_if(at >= F.lit(unknown)).alias("from_floor"),
    )


add(
    "wm4_cutoff",
    _after_cutoff,
    "select count(*) filter (where ts >= (select max(ts) from ords) - interval 7 day) as in_lookback, "
    "count(*) filter (where ts >= (select max(ts) from ords) - interval 60 day) as in_backfill, "
    "count(*) filter (where ts >= timestamp '2020-01-01' - interval 7 day) as from_floor from ords",
)


add(
    "wm2_lookup",
    lambda w, s, d: w["fct_order"].agg(
        F.count_if(F.col("order_ts_utc") >= F.lit(_watermarks(w, s, d).get("fct_order"))).alias("at_watermark")
    ),
    "select count(*) filter (where ts >= (select max(ts) from ords)) as at_watermark from ords",
)


# an incremental run over feeds of which a first run has seen a part: equal to one run over everything
CORE_CUT = dt.datetime(1999, 3, 1)


_landed: dict[int, dict[str, DataFrame]] = {}


def _feeds(w) -> tuple[dict, dict]:
    """(feeds of the first run, all): later rows are missing, and some old logs and promotions come late. Feeds are landed once."""
    if id(w) not in _landed:
        _landed[id(w)] = {name: materialize(w[name], name) for name in ("raw_item_logs", "raw_promos", "raw_purchases", "raw_baskets")}
    feeds = _landed[id(w)]
    missing = lambda *cols: F.crc32(F.concat_ws("|", *cols).cast("binary")) % 3 != 0
    before = lambda column: parse_event_time(column) < F.lit(CORE_CUT)
    first = {
        **feeds,
        "raw_item_logs": feeds["raw_item_logs"].where(before("time_log_created_utc") & missing(F.col("log_item_id").cast("string"))),
        "raw_promos": feeds["raw_promos"].where(missing(*feeds["raw_promos"].columns)),
        "raw_purchases": feeds["raw_purchases"].where(before("time_order_received_utc")),
    }
    return first, feeds


_runs: dict[tuple[str, str], incremental.CoreTables] = {}


def _after_two_runs(w, s, d) -> incremental.CoreTables:
    """Core tables after a first run and an incremental one; made once per Spark application and data folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _runs:
        first, feeds = _feeds(w)
        tables = incremental.CoreTables(s, scratch_path(s, "core"), CFG, grain="month")
        tables.run(first, "r1", NOW)
        tables.run(feeds, "r2", NOW)
        _runs[key] = tables
    return _runs[key]


def _backfilled(w, s, d) -> DataFrame:
    """A purchase feed that lacked old rows; a lookback deep enough takes them in."""
    _, feeds = _feeds(w)
    old = parse_event_time("time_order_received_utc") < F.lit(CORE_CUT)
    some = F.crc32(F.col("purchase_key").cast("string").cast("binary")) % 20 != 0
    tables = incremental.CoreTables(s, scratch_path(s, "core"), CFG, grain="month")
    tables.run({**feeds, "raw_purchases": feeds["raw_purchases"].where(~old | some)}, "r1", NOW)
    tables.run(feeds, "r2", NOW, lookback_days=365 * 30)
    return tables.table("fct_order")


def _refreshed(w, s, d) -> DataFrame:
    """Tables that hold other rows, then a full refresh."""
    first, feeds = _feeds(w)
    tables = incremental.CoreTables(s, scratch_path(s, "core"), CFG, grain="month")
    tables.run({**first, "raw_purchases": first["raw_purchases"].withColumn("customer_key", F.lit("other"))}, "r1", NOW)
    tables.run(feeds, "r2", NOW, full_refresh=True)
    return tables.table("dim_customer")


add("wm5_incremental", lambda w, s, d: _after_two_runs(w, s, d).table("fct_order").select(*w["fct_order"].columns), ORDER_SQL)
add("wm5_incremental_items", lambda w, s, d: _after_two_runs(w, s, d).fct_order_item(), ITEM_SQL)
add("wm5_incremental_customers", lambda w, s, d: _after_two_runs(w, s, d).table("dim_customer"), CUSTOMER_SQL)
add("wm5_backfill", lambda w, s, d: _backfilled(w, s, d).select(*w["fct_order"].columns), ORDER_SQL)
add("wm5_full_refresh", _refreshed, CUSTOMER_SQL)


def _run_log(w, s, d):
    log = upsert.RunLog(s, scratch_path(s, "runs"), CFG)
    log.ensure()
    latest = w["fct_order"].agg(F.max("order_ts_utc")).first()[0]
    log.put("r1", "rpt_kpi_long", latest, NOW)
    log.put("r1", "rpt_kpi_long", latest, NOW + dt.timedelta(hours=1))
    log.put("r2", "rpt_kpi_long", latest, NOW)
    return log


add(
    "run1_run_log",
    lambda w, s, d: _run_log(w, s, d).table().select(
        "run_id", "model_name", "as_of_run_ts", "as_of_run_date", "publish_tag", "incremental_lookback_days", "created_at", "updated_at"
    ),
    "select v.run_id, 'rpt_kpi_long' as model_name, cast(max(ts) as varchar) as as_of_run_ts, "
    "cast(cast(max(ts) as date) as varchar) as as_of_run_date, 'scheduled' as publish_tag, 7::bigint as incremental_lookback_days, "
    "'2024-01-01 00:00:00' as created_at, v.u as updated_at from ords, "
    "(values ('r1', '2024-01-01 01:00:00'), ('r2', '2024-01-01 00:00:00')) v(run_id, u) group by v.run_id, v.u",
)
add(
    "aud17_freshness",
    lambda w, s, d: upsert.freshness(_watermarks(w, s, d).table(), _run_log(w, s, d).table(), ["rpt_kpi_long"])[1],
    "select 'rpt_kpi_long' as model_name, 2::bigint as run_rows, cast(max(ts) as varchar) as latest_run_ts from ords",
)


def _streamed(w, s, d):
    feed = scratch_path(s, "feed")
    events = materialize(fx.event_item_logs(s, d), "staged-events")
    events.repartition(4, "item_key").write.parquet(feed)
    state = scratch_path(s, "stream-state")
    source = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(feed)
    curate_stream(source, state, scratch_path(s, "stream-checkpoint")).awaitTermination()
    return curated_view(s, state).select(*EV_COLS)


add("str1_curate_stream", _streamed, f"select {EV_SQL} from ev_cur")
