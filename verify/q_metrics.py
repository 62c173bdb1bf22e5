"""Metric layer, and the aggregate, window, ordering and scalar building blocks on the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.config import DAYPARTS_FIVE
from basketry.functions import (
    count_where,
    daypart,
    distinct_list,
    local_time,
    month_of,
    parse_date,
    parse_event_time,
    plain_number,
    quantile,
    safe_divide,
    sample_values,
    sum_where,
    sunday_week,
    surrogate_key,
    try_money,
)
from basketry.operators.ranking import kpi_long, measure_rollup, top_n, top_n_per_group
from basketry.plans import core, semantic
from verify import fixtures as fx
from verify.oracle_base import b, berlin, div, n, r, sk, t, txt
from verify.registry import add

# -------------------------------------------------------------------------------------- metric layer

add(
    "sem1_models",
    lambda w, s, d: semantic.metric_query(w, [m.name for m in semantic.METRICS.values() if m.name not in ("total_orders",)], []).select(
        "customers", "item_count_current", "item_versions_count", "promo_rule_count", "avg_discount_pct", "order_item_rows", "line_revenue_eur"
    ),
    "select (select count(*) from cust) as customers, (select count(*) from scd where is_current) as item_count_current, (select count(*) from scd) as item_versions_count, "
    "(select count(*) from promo_dim) as promo_rule_count, (select round(avg(pct), 6) from promo_dim) as avg_discount_pct, "
    f"(select count(*) from items) as order_item_rows, (select cast(sum(final) as double) from items) as line_revenue_eur",
)
add(
    "sem2_metrics_by_month",
    lambda w, s, d: semantic.metric_query(
        w, ["total_orders", "basket_value_eur", "total_units_in_order", "promo_units_in_order", "total_customer_paid_eur"], ["metric_time"], "month"
    ),
    f"select {t('mon', 'metric_time')}, count(*) as total_orders, {n('sum(total)', 'basket_value_eur')}, {b('sum(n_units)', 'total_units_in_order')}, "
    f"{b('sum(p_units)', 'promo_units_in_order')}, {n('sum(paid)', 'total_customer_paid_eur')} from ords group by mon",
)
add(
    "sem3_items_by_category_quarter",
    lambda w, s, d: semantic.metric_query(
        w, ["line_revenue_eur", "units_sold", "discount_pct_applied", "avg_item_unit_final_price_gross_eur"], ["metric_time", "item_category"], "quarter"
    ),
    f"select cast(date_trunc('quarter', order_date)::date as varchar) as metric_time, item_category, {n('sum(final)', 'line_revenue_eur')}, {b('sum(units)', 'units_sold')}, "
    f"{r('avg(disc)', 'discount_pct_applied')}, {r(div('sum(unit_final)', 'count(unit_final)'), 'avg_item_unit_final_price_gross_eur')} from items group by 1, 2",
)
add(
    "sem3_filtered",
    lambda w, s, d: semantic.metric_query(w, ["units_sold"], ["brand_name"], where=F.col("is_promo_item")),
    f"select brand_name, {b('sum(units)', 'units_sold')} from items where is_promo group by brand_name",
)
add(
    "sem4_foreign_dimension",
    lambda w, s, d: semantic.metric_query(
        w, ["line_revenue_eur", "order_item_rows"], ["customer__first_order_contains_promo_flag", "item__brand_name"]
    ),
    f"select first_promo as customer__first_order_contains_promo_flag, c.brand_name as item__brand_name, {n('sum(final)', 'line_revenue_eur')}, count(*) as order_item_rows "
    "from items i left join cust using (customer_sk) left join (select * from scd where is_current) c on c.item_key_sk = i.item_key_sk group by first_promo, c.brand_name",
)
add(
    "sem4_several_models",
    lambda w, s, d: semantic.metric_query(w, ["total_orders", "line_revenue_eur", "promo_rule_count"], ["metric_time"], "month"),
    f"select cast(coalesce(a.mon, z.mon, p.mon) as varchar) as metric_time, o as total_orders, {n('v', 'line_revenue_eur')}, k as promo_rule_count from "
    "(select mon, count(*) as o from ords group by mon) a full join (select mon, sum(final) as v from items group by mon) z on z.mon = a.mon "
    "full join (select date_trunc('month', s)::date as mon, count(*) as k from promo_dim group by 1) p on p.mon is not distinct from a.mon",
)
add(
    "sem5_item_columns",
    lambda w, s, d: semantic.column_metrics(w["fct_order_item"], "fct_order_item", ["item_category"]),
    f"select item_category, count(distinct order_item_sk) as order_item_rows, count(distinct order_sk) as orders, {b('sum(units)', 'units_sold')}, "
    f"{r(div('sum(unit_final)', 'count(unit_final)'), 'avg_item_unit_final_price_gross_eur')}, {n('sum(row_disc)', 'total_discount_gross_eur')}, {n('sum(final)', 'total_revenue_gross_eur')} "
    "from items group by item_category",
)
add(
    "sem5_monthly_columns",
    lambda w, s, d: semantic.column_metrics(
        w["rpt_category_monthly"], "rpt_category_monthly", ["order_month"],
        ["cm_revenue_eur", "cm_orders", "promo_cm_units_sold", "cm_avg_discount_rate", "cm_avg_sku_count", "cm_avg_top_sku_share"],
    ),
    f"select {t('mon', 'order_month')}, {n('sum(rev)', 'cm_revenue_eur')}, {b('sum(n_ord)', 'cm_orders')}, {b('sum(p_units)', 'promo_cm_units_sold')}, "
    f"{r('avg(' + div('disc', 'base') + ')', 'cm_avg_discount_rate')}, {r('avg(skus)', 'cm_avg_sku_count')}, {r('avg(top1)', 'cm_avg_top_sku_share')} from cat_month group by mon",
)
add(
    "sem5_pair_columns",
    lambda w, s, d: semantic.column_metrics(
        w["rpt_category_pairs"], "rpt_category_pairs", [], ["cscp_pair_orders_sum", "cscp_support_avg", "cscp_lift_avg"]
    ),
    f"select {b('sum(k)', 'cscp_pair_orders_sum')}, {r('avg(support)', 'cscp_support_avg')}, {r('avg(lift)', 'cscp_lift_avg')} from cat_pairs",
)

# ---------------------------------------------------------------------------------------- aggregates

def line_revenue():
    price, discount = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    return (price * (1 - discount)).cast("decimal(20,4)")


REV_SQL = "cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(20,4))"

add(
    "agg1_functions",
    lambda w, s, d: fx.table(s, d, "lineitem").groupBy("l_returnflag").agg(
        F.sum(line_revenue()).alias("revenue"), F.count(F.lit(1)).alias("row_count"), F.count_distinct("l_suppkey").alias("suppliers"),
        F.avg("l_quantity").alias("avg_quantity"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
        F.min("l_linestatus").alias("any_status"), count_where(F.col("l_discount") > 0).alias("discounted"),
        F.stddev_pop("l_quantity").alias("spread_quantity"),
    ),
    f"select l_returnflag, {n(f'sum({REV_SQL})', 'revenue')}, count(*) as row_count, count(distinct l_suppkey) as suppliers, {r('avg(l_quantity)', 'avg_quantity')}, "
    f"{t('min(l_shipdate)', 'first_ship')}, {t('max(l_shipdate)', 'last_ship')}, min(l_linestatus) as any_status, count(*) filter (where l_discount > 0) as discounted, "
    f"{r('stddev_pop(l_quantity)', 'spread_quantity')} from lineitem group by l_returnflag",
)
add(
    "agg1_distinct_rollup",
    lambda w, s, d: measure_rollup(
        fx.table(s, d, "lineitem").join(fx.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")),
        ["l_returnflag"], {"units": F.col("l_quantity").cast("long")}, order="l_orderkey", customer="o_custkey",
    ),
    f"select l_returnflag, {b('sum(units)', 'units')}, {b('sum(o)', 'orders')}, count(*) as customers, count(*) filter (where o > 1) as repeat_customers from "
    "(select l_returnflag, o_custkey, sum(cast(l_quantity as bigint)) as units, count(distinct l_orderkey) as o from lineitem join orders on l_orderkey = o_orderkey group by 1, 2) group by 1",
)
add(
    "agg2_conditional",
    lambda w, s, d: fx.table(s, d, "lineitem").groupBy("l_linestatus").agg(
        sum_where(F.col("l_discount") > 0.05, F.col("l_quantity").cast("long")).alias("units_high"),
        F.count_distinct(F.when(F.col("l_discount") > 0, F.col("l_partkey"))).alias("discounted_parts"),
        F.max((F.col("l_tax") > 0).cast("long")).alias("any_tax"),
    ),
    f"select l_linestatus, {b('sum(case when l_discount > 0.05 then l_quantity else 0 end)', 'units_high')}, "
    "count(distinct case when l_discount > 0 then l_partkey end) as discounted_parts, cast(max(cast(l_tax > 0 as int)) as bigint) as any_tax from lineitem group by l_linestatus",
)
add(
    "agg3_quantiles",
    lambda w, s, d: fx.table(s, d, "events").groupBy("user_id").agg(
        *[quantile("value", k, (25, 50, 75, 90, 95)).alias(f"p{k}") for k in (25, 50, 75, 90, 95)]
    ),
    "select user_id, " + ", ".join(r(f"quantile_disc(value, {k / 100})", f"p{k}") for k in (25, 50, 75, 90, 95)) + " from events group by user_id",
)
add(
    "agg4_sample_ids",
    lambda w, s, d: sample_values(fx.table(s, d, "orders"), "o_orderkey", 200),
    "select array_to_string(list(k order by k), '|') as o_orderkey from (select distinct o_orderkey as k from orders order by 1 limit 200)",
)
add(
    "agg5_distinct_list",
    lambda w, s, d: fx.table(s, d, "part").select("p_name", "p_type").distinct().groupBy("p_name").agg(distinct_list("p_type").alias("types")),
    "select p_name, string_agg(distinct p_type, ', ' order by p_type) as types from part group by p_name",
)
add(
    "agg6_having",
    lambda w, s, d: fx.table(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1"),
    "select l_orderkey, l_partkey, count(*) as row_count from lineitem group by all having count(*) > 1",
)
add(
    "agg7_distinct",
    lambda w, s, d: fx.table(s, d, "lineitem").select("l_suppkey", "l_returnflag").distinct(),
    "select distinct l_suppkey, l_returnflag from lineitem",
)
add(
    "agg8_long_kpis",
    lambda w, s, d: kpi_long(
        fx.table(s, d, "orders").groupBy("o_orderpriority").agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("c"), F.max("o_totalprice").alias("m")
        ),
        ["o_orderpriority"], {"Orders": "n", "Customers": "c", "Largest Order": "m"}, "metric_name", "metric_value",
    ),
    "with x as (select o_orderpriority, count(*)::double as n, count(distinct o_custkey)::double as c, max(o_totalprice) as m from orders group by 1) "
    "select o_orderpriority, 'Orders' as metric_name, n as metric_value from x union all select o_orderpriority, 'Customers', c from x "
    "union all select o_orderpriority, 'Largest Order', m from x",
)

# ------------------------------------------------------------------------------- windows, orderings

add(
    "win1_row_number",
    lambda w, s, d: top_n_per_group(
        fx.table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"],
        [F.desc("o_totalprice"), F.asc("o_orderkey")], 1,
    ),
    "select o_custkey, o_orderkey, o_totalprice, 1::bigint as rank from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1",
)
add(
    "win2_global_rank",
    lambda w, s, d: top_n(
        fx.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum(line_revenue()).alias("revenue")), [F.desc("revenue"), F.asc("l_suppkey")], 10, "rank"
    ),
    f"select l_suppkey, {n('v', 'revenue')}, row_number() over (order by v desc, l_suppkey) as rank from (select l_suppkey, sum({REV_SQL}) as v from lineitem group by 1 order by v desc, l_suppkey limit 10)",
)


def _user_days(s, d):
    return fx.table(s, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


_DAYS = "(select user_id, ts::date as day, count(*) as n from events group by 1, 2)"
add(
    "win3_lag",
    lambda w, s, d: _user_days(s, d).withColumn("prev_n", F.lag("n").over(W.partitionBy("user_id").orderBy("day"))),
    f"select user_id, {t('day')}, n, lag(n) over (partition by user_id order by day) as prev_n from {_DAYS}",
)
add(
    "win4_lead",
    lambda w, s, d: _user_days(s, d).withColumn("next_day", F.lead("day").over(W.partitionBy("user_id").orderBy("day"))),
    f"select user_id, {t('day')}, n, cast(lead(day) over (partition by user_id order by day) as varchar) as next_day from {_DAYS}",
)
add(
    "win5_window_over_aggregate",
    lambda w, s, d: fx.table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(line_revenue()).alias("revenue")).withColumn(
        "rank", F.row_number().over(W.partitionBy("l_returnflag").orderBy(F.desc("revenue"))).cast("long")
    ),
    f"select l_returnflag, l_linestatus, {n('v', 'revenue')}, row_number() over (partition by l_returnflag order by v desc) as rank from "
    f"(select l_returnflag, l_linestatus, sum({REV_SQL}) as v from lineitem group by 1, 2)",
)
add(
    "win6_qualify",
    lambda w, s, d: top_n_per_group(
        fx.table(s, d, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"],
        [F.desc("p_retailprice"), F.asc("p_partkey")], 3,
    ),
    "select p_brand, p_partkey, p_retailprice, row_number() over w as rank from part "
    "window w as (partition by p_brand order by p_retailprice desc, p_partkey) qualify row_number() over w <= 3",
)
add(
    "ord1_sorted_mart",
    lambda w, s, d: fx.table(s, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "o_orderpriority"),
    "select o_orderpriority, count(*) as orders from orders group by 1 order by 2 desc, 1",
)
add(
    "ord2_top_n",
    lambda w, s, d: top_n(fx.table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 30),
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 30",
)
add(
    "ord3_top_n_per_group",
    lambda w, s, d: top_n_per_group(
        fx.table(s, d, "lineitem").groupBy("l_returnflag", "l_partkey").agg(F.sum(line_revenue()).alias("revenue")),
        ["l_returnflag"], [F.desc("revenue"), F.asc("l_partkey")], 10,
    ),
    f"select l_returnflag, l_partkey, {n('v', 'revenue')}, row_number() over w as rank from (select l_returnflag, l_partkey, sum({REV_SQL}) as v from lineitem group by 1, 2) "
    "window w as (partition by l_returnflag order by v desc, l_partkey) qualify row_number() over w <= 10",
)
add(
    "ord4_custom_order",
    lambda w, s, d: fx.table(s, d, "events").groupBy(daypart(F.hour(F.col("ts").cast("timestamp")), DAYPARTS_FIVE).alias("daypart")).agg(F.count(F.lit(1)).alias("row_count")).orderBy(
        F.when(F.col("daypart").startswith("Morning"), 1).when(F.col("daypart").startswith("Lunch"), 2).otherwise(3), "daypart"
    ),
    "select case when h between 6 and 10 then 'Morning (06-10)' when h between 11 and 14 then 'Lunch (11-14)' when h between 15 and 17 then 'Afternoon (15-17)' "
    "when h between 18 and 22 then 'Evening (18-22)' else 'Night (23-05)' end as daypart, count(*) as row_count from (select hour(ts) as h from events) group by 1",
)
add(
    "set1_union_all",
    lambda w, s, d: fx.table(s, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).unionByName(
        fx.table(s, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    ),
    "select 'customer' as kind, c_name as name, c_acctbal as balance from customer union all select 'supplier', s_name, s_acctbal from supplier",
)

# ------------------------------------------------------------------------------------------ scalars


def events(s, d):
    return fx.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


add(
    "fn1_safe_divide",
    lambda w, s, d: fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", safe_divide("l_extendedprice", F.col("l_tax") * 100).alias("ratio")),
    "select l_orderkey, l_linenumber::bigint as l_linenumber, round(l_extendedprice / nullif(l_tax * 100, 0), 6) as ratio from lineitem",
)
add(
    "fn2_parse_time",
    lambda w, s, d: events(s, d).select(
        "event_id",
        parse_event_time(F.when(F.col("event_id") % 9 == 0, F.lit("broken")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" Z")))).alias("parsed"),
    ),
    "select event_id, case when event_id % 9 <> 0 then cast(ts as varchar) end as parsed from events",
)
add(
    "fn3_parse_date",
    lambda w, s, d: fx.table(s, d, "orders").select(
        "o_orderkey", parse_date(F.when(F.col("o_orderkey") % 8 == 0, F.lit("2020-13-45")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("parsed")
    ),
    "select o_orderkey, case when o_orderkey % 8 <> 0 then cast(o_orderdate::date as varchar) end as parsed from orders",
)
add(
    "fn4_json",
    lambda w, s, d: events(s, d).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")),
    "select event_id, cast(props ->> '$.k' as bigint) as k from events",
)
add(
    "fn5_to_json",
    lambda w, s, d: fx.table(s, d, "nation").join(fx.table(s, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.to_json(F.struct("n_name", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey")).alias("n_regionkey")), {"ignoreNullFields": "false"}).alias("payload")
    ),
    "select c_custkey, to_json(struct_pack(n_name := n_name, n_regionkey := case when n_regionkey > 1 then n_regionkey end))::varchar as payload "
    "from customer join nation on c_nationkey = n_nationkey",
)
add(
    "fn6_try_cast",
    lambda w, s, d: fx.table(s, d, "orders").select(
        "o_orderkey", try_money(F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("amount")
    ),
    "select o_orderkey, case when o_orderkey % 10 <> 0 then cast(cast(o_totalprice as decimal(18,2)) as double) end as amount from orders",
)
add(
    "fn7_surrogate_key",
    lambda w, s, d: fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", surrogate_key("l_orderkey", F.when(F.col("l_linenumber") > 1, F.col("l_partkey"))).alias("key")),
    f"select l_orderkey, l_linenumber::bigint as l_linenumber, {sk('l_orderkey', 'case when l_linenumber > 1 then l_partkey end')} as key from lineitem",
)
add(
    "fn8_local_time",
    lambda w, s, d: w["fct_order"].select("order_sk", local_time("order_ts_utc", "Europe/Berlin").alias("local"), local_time("order_ts_utc", "Europe/Berlin").cast("date").alias("local_date")),
    f"select order_sk, cast({berlin('ts')} as varchar) as local, cast({berlin('ts')}::date as varchar) as local_date from ords",
)
add(
    "fn9_month",
    lambda w, s, d: fx.table(s, d, "orders").groupBy(month_of("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("orders")),
    "select cast(date_trunc('month', o_orderdate)::date as varchar) as month, count(*) as orders from orders group by 1",
)
add(
    "fn10_calendar_parts",
    lambda w, s, d: fx.table(s, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"), F.month("o_orderdate").alias("m"), sunday_week("o_orderdate").alias("week"),
        F.dayofweek("o_orderdate").alias("dow"), F.hour(F.timestamp_seconds(fx.order_seconds())).alias("h"),
    ),
    "select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m, cast(strftime(o_orderdate, '%U') as bigint) as week, "
    "dayofweek(o_orderdate) + 1 as dow, hour(o_orderdate + to_seconds(o_orderkey * 7919 % 86400)) as h from orders",
)
add(
    "fn11_day_name",
    lambda w, s, d: fx.table(s, d, "orders").groupBy(F.date_format("o_orderdate", "EEEE").alias("day_name")).agg(F.count(F.lit(1)).alias("orders")),
    "select dayname(o_orderdate) as day_name, count(*) as orders from orders group by 1",
)
add(
    "fn12_calendar",
    lambda w, s, d: core.dim_date(s, *fx.date_bounds(fx.table(s, d, "orders"), "o_orderdate")).join(
        fx.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("date_day")), "date_day"
    ).groupBy("year", "week").agg(F.count(F.lit(1)).alias("orders")),
    "select year(o_orderdate) as year, cast(strftime(o_orderdate, '%U') as bigint) as week, count(*) as orders from orders group by 1, 2",
)
add(
    "fn13_time_arithmetic",
    lambda w, s, d: events(s, d).select("event_id", (F.col("ts") - F.make_interval(days=F.lit(7))).alias("week_before")),
    "select event_id, cast(ts - interval 7 day as varchar) as week_before from events",
)
add(
    "fn14_numeric",
    lambda w, s, d: fx.table(s, d, "customer").select(
        "c_custkey", F.greatest(F.lit(0.0), "c_acctbal").alias("floor_zero"), F.abs("c_acctbal").alias("size"), F.round("c_acctbal", 1).alias("rounded"),
        F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(0)), F.lit(-1)).alias("nation"), F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("side"),
        plain_number("c_acctbal", 2).alias("text"),
    ),
    "select c_custkey, greatest(0.0::double, c_acctbal) as floor_zero, abs(c_acctbal) as size, round(cast(c_acctbal as decimal(18,2)), 1)::double as rounded, "
    f"cast(coalesce(nullif(c_nationkey, 0), -1) as bigint) as nation, case when c_acctbal < 0 then 'debt' else 'credit' end as side, {txt('c_acctbal')} as text from customer",
)
add(
    "fn15_text",
    lambda w, s, d: fx.table(s, d, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" / "), "p_brand").alias("label"), F.trim(F.concat(F.lit("  "), "p_type")).alias("kind"),
        F.lower("p_brand").like("brand#1%").alias("brand_one"), F.col("p_name").startswith("red").alias("is_red"),
    ),
    "select p_partkey, p_name || ' / ' || p_brand as label, p_type as kind, lower(p_brand) like 'brand#1%' as brand_one, starts_with(p_name, 'red') as is_red from part",
)
add(
    "fn16_run_stamp",
    lambda w, s, d: w["aud_row_flow"].groupBy("audit_generated_at_utc").agg(F.count(F.lit(1)).alias("steps")),
    "select '2024-01-01 00:00:00' as audit_generated_at_utc, count(*) as steps from flow",
)
