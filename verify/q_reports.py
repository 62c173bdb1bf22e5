"""Reporting marts, answers and dashboard datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.plans import answers as ans
from basketry.plans import dashboards as bi
from basketry.plans import reporting as rpt
from verify.oracle_base import BUCKET, KPI, b, div, n, r, t, txt
from verify.registry import CFG, add

# ---------------------------------------------------------------------------------------- reporting


def rows(w):
    return rpt.category_rows(w["fct_order_item"])


add(
    "rpt1_category_monthly",
    lambda w, s, d: w["rpt_category_monthly"],
    f"select {t('mon', 'order_month')}, cat as item_category, {n('rev', 'revenue_eur')}, {n('base', 'base_revenue_eur')}, "
    f"{n('disc', 'discount_eur')}, {r(div('disc', 'base'), 'discount_rate')}, {b('units', 'units_sold')}, n_ord as orders, "
    f"n_cust as customers, {r(div('rev', 't_rev'), 'revenue_share')}, {r(div('n_ord', 't_ord'), 'order_penetration')}, "
    f"{r(div('n_cust', 't_cust'), 'customer_penetration')}, {r(div('rev', 'units'), 'asp_eur')}, "
    f"{r(div('rev', 'n_ord'), 'revenue_per_order_eur')}, {r(div('units', 'n_ord'), 'units_per_order')}, "
    f"{r(div('n_ord', 'n_cust'), 'orders_per_customer')}, {r('rep_rate', 'repeat_customer_rate')}, skus as sku_count, "
    f"{r('top1', 'top_sku_share')}, {r('top3', 'top_3_share')}, other as top_attached_category, {r('rate', 'cross_sell_attach_rate')}, "
    f"{n('rev', 'order_item_rows_revenue_eur')}, {n('disc', 'order_item_rows_discount_eur')}, "
    f"{r(div('rev', 'units'), 'weighted_avg_selling_price_eur')}, n_cust as distinct_customers_in_month, "
    f"first_n as distinct_customers_whose_first_order_included_category_in_month, "
    f"rep_cust as distinct_customers_with_repeat_orders_including_category_in_month, {b('p_units', 'promo_units_sold')}, "
    f"{r('ou', 'avg_order_units_for_orders_with_category')}, {r('dist', 'avg_delivery_distance_meters')} from cat_month",
)
add(
    "rpt1a_monthly_totals",
    lambda w, s, d: rpt.monthly_totals(rows(w)),
    f"select {t('mon', 'order_month')}, {n('sum(final)', 'total_revenue_eur')}, count(distinct order_sk) as total_orders, "
    "count(distinct customer_sk) as total_customers from cat_rows group by mon",
)
add(
    "rpt1b_repeat_rate",
    lambda w, s, d: rpt.repeat_rate(rows(w)),
    f"select {t('mon', 'order_month')}, cat as item_category, {r('rep_rate', 'repeat_customer_rate')} from cat_month",
)
add(
    "rpt1c_concentration",
    lambda w, s, d: rpt.monthly_concentration(rows(w)),
    f"select {t('mon', 'order_month')}, cat as item_category, skus as sku_count, {r('top1_or_null', 'top_sku_share')}, "
    f"{r('top3_or_null', 'top_3_share')} from cat_month",
)
add(
    "rpt1d_top_attached",
    lambda w, s, d: rpt.top_attached(rpt.monthly_baskets(rows(w))),
    f"select {t('mon', 'order_month')}, cat as item_category, other as top_attached_category, {r('rate', 'cross_sell_attach_rate')} "
    "from cat_month where other is not null",
)
add(
    "rpt1e_order_context",
    lambda w, s, d: rpt.order_context(w["fct_order_item"], w["fct_order"]),
    f"select {t('mon', 'order_month')}, cat as item_category, first_n as distinct_customers_whose_first_order_included_category_in_month, "
    f"rep_cust as distinct_customers_with_repeat_orders_including_category_in_month, {r('dist', 'avg_delivery_distance_meters')}, "
    f"{r('ou', 'avg_order_units_for_orders_with_category')} from cat_month",
)
add(
    "rpt2_kpi_long",
    lambda w, s, d: w["rpt_kpi_long"],
    f"select {t('mon', 'order_month')}, cat as item_category, metric as metric_name, {r('val', 'metric_value')} from kpi",
)
add(
    "rpt3_kpi_mom",
    lambda w, s, d: w["rpt_kpi_mom"],
    f"select {t('mon', 'order_month')}, cat as item_category, metric as metric_name, {r('val', 'metric_value')}, "
    f"{r('prev', 'previous_month_metric_value')}, {r('delta', 'mom_absolute_change')}, {r('pct', 'mom_percentage_change')} from kpi_mom",
)
_SCORE = f"""
with a as (
  select item_category as c, sum(final) as rev, sum(base) as base, sum(row_disc) as disc, sum(units) as units,
         count(distinct order_sk) as o, count(distinct customer_sk) as k, count(distinct case when is_promo then order_sk end) as po
  from items group by all
), tt as (select sum(final) as t_rev, count(distinct order_sk) as t_o, count(distinct customer_sk) as t_k from items),
rp as (select item_category as c, count(*) filter (where m > 1) as rk from
  (select item_category, customer_sk, count(distinct order_sk) as m from items group by all) group by all),
sp as (
  select c, sum(case when rn = 1 then v end) as s1, sum(case when rn <= 3 then v else 0 end) as s3 from (
    select item_category as c, product, sum(final) as v,
           row_number() over (partition by item_category order by sum(final) desc, product nulls first) as rn
    from items group by item_category, product) group by all
)
select a.c as category, round(cast(rev as double), 2) as revenue_eur, round(100 * {div('rev', 't_rev')}, 2) as share_pct,
       cast(units as bigint) as units, o as orders, k as customers, round(100 * {div('o', 't_o')}, 1) as order_pen_pct,
       round(100 * {div('k', 't_k')}, 1) as customer_pen_pct, round({div('rev', 'units')}, 2) as asp_eur,
       round(100 * {div('disc', 'base')}, 2) as disc_pct, round(100 * {div('po', 'o')}, 2) as promo_pct,
       round({div('rev', 'o')}, 2) as rev_per_order_eur, round({div('o', 'k')}, 2) as orders_per_customer,
       round(100 * {div('rk', 'k')}, 1) as repeat_pct, round(100 * {div('s1', 'rev')}, 1) as top_sku_pct,
       round(100 * {div('s3', 'rev')}, 1) as top_3_pct, {n('t_rev', 'total_revenue_eur')}, t_o as total_orders,
       t_k as total_customers, po as promo_orders, rk as repeat_customers, {n('s1', 'top_sku_revenue_eur')}, {n('s3', 'top_3_revenue_eur')}
from a join rp on rp.c is not distinct from a.c join sp on sp.c is not distinct from a.c, tt
"""
add("rpt4_category_scorecard", lambda w, s, d: w["rpt_category_scorecard"], f"select * from ({_SCORE})")
add(
    "rpt5_star_products",
    lambda w, s, d: w["rpt_star_products"],
    f"select row_number() over (order by v desc, product nulls first) as rank_no, product as product_name, coalesce(br, 'Unknown') as brand_name, "
    f"round(cast(v as double), 2) as revenue_eur, round(100 * {div('v', '(select sum(final) from items)')}, 2) as share_pct, "
    f"cast(u as bigint) as units, o as orders, k as customers, round({div('v', 'u')}, 2) as asp_eur, "
    f"round(100 * {div('ds', 'bs')}, 2) as disc_pct, "
    "case when row_number() over (order by v desc, product nulls first) <= 2 then 'HERO' end as hero_flag from ("
    "select product, min(nullif(trim(brand_name), '')) as br, sum(final) as v, sum(units) as u, count(distinct order_sk) as o, "
    "count(distinct customer_sk) as k, sum(row_disc) as ds, sum(base) as bs from items group by product order by v desc, product nulls first limit 10)",
)
add(
    "rpt6_daypart",
    lambda w, s, d: w["rpt_daypart"],
    f"select {t('i.mon', 'order_month')}, item_category, dayofweek(ts_local) + 1 as day_of_week_berlin_num, dayname(ts_local) as day_of_week_berlin, "
    "hour(ts_local) as order_hour_berlin, case when hour(ts_local) between 6 and 10 then 'Morning (06-10)' "
    "when hour(ts_local) between 11 and 16 then 'Afternoon (11-16)' when hour(ts_local) between 17 and 22 then 'Evening (17-22)' "
    f"else 'Night (23-05)' end as daypart_berlin, {n('sum(i.final)', 'revenue_eur')}, {b('sum(units)', 'units_sold')} "
    "from items i join ords o using (order_sk) where item_category is not null group by 1, 2, 3, 4, 5, 6",
)
_PAIR = ", ".join(
    r(src, name)
    for src, name in [
        ("support", "support"), ("exp_s", "expected_support_independent"), ("exp_n", "expected_pair_orders_independent"),
        ("delta", "pair_orders_vs_expected_delta"), ("delta_pct", "pair_orders_vs_expected_pct"),
        ("conf_ab", "confidence_a_to_b"), ("conf_ba", "confidence_b_to_a"), ("lift", "lift"),
    ]
)
add(
    "rpt7_category_pairs",
    lambda w, s, d: w["rpt_category_pairs"],
    f"select a as category_a, b as category_b, k as pair_orders, ka as category_a_orders, kb as category_b_orders, tot as total_orders, "
    f"{r('ka::double / tot', 'category_a_order_penetration')}, {r('kb::double / tot', 'category_b_order_penetration')}, {_PAIR}, "
    f"{BUCKET} as actionability_bucket, {b('rk', 'actionability_rank')} from cat_pairs",
)
_PATTERN = (
    "case when cat_a = 'SMALL' and cat_b = 'SMALL' then 'Chip + Chip' "
    "when (cat_a = 'SMALL' and cat_b = 'LARGE') or (cat_a = 'LARGE' and cat_b = 'SMALL') then 'Chip + Dip' "
    "when cat_a in ('MEDIUM', 'PROMO') and cat_b in ('MEDIUM', 'PROMO') then 'Choc + Choc' else 'Cross-category' end"
)
add(
    "rpt8_product_pairs",
    lambda w, s, d: w["rpt_product_pairs"],
    f"select a as product_a, b as product_b, k as pair_orders, ka as product_a_orders, kb as product_b_orders, tot as total_orders, "
    f"{r('ka::double / tot', 'product_a_order_penetration')}, {r('kb::double / tot', 'product_b_order_penetration')}, {_PAIR}, "
    f"cat_a as category_a, cat_b as category_b, {_PATTERN} as pattern, {BUCKET} as actionability_bucket, "
    f"{b('rk', 'actionability_rank')} from prod_pairs",
)
_BEHAVIOR = (
    f"select customer_sk, customer_key, {t('first_ts', 'first_order_ts_utc')}, {t('first_local', 'first_order_ts_berlin')}, "
    "f_any as first_order_had_any_promo_units, f_only as first_order_had_only_promo_units, with_p as orders_with_any_promo_units, "
    f"no_p as orders_with_no_promo_units, {b('pu', 'promo_units_purchased')}, {b('nu', 'non_promo_units_purchased')}, "
    f"{n('pv', 'promo_value_eur')}, {n('nv', 'non_promo_value_eur')}, only_p as promo_only_customer_flag, n as lifetime_orders from cust_promo"
)
add("rpt9_customer_promo", lambda w, s, d: w["rpt_customer_promo"], _BEHAVIOR)
add(
    "rpt10_multi_category",
    lambda w, s, d: w["rpt_multi_category_items"],
    "select item_key, min(coalesce(product, 'Unknown Item')) as product_name, count(distinct coalesce(item_category, 'Unknown')) as distinct_category_count, "
    "string_agg(distinct coalesce(item_category, 'Unknown'), ', ' order by coalesce(item_category, 'Unknown')) as categories_seen, "
    f"{t('min(order_date)', 'first_seen_order_date')}, {t('max(order_date)', 'last_seen_order_date')}, count(*) as total_rows "
    "from items group by item_key having count(distinct coalesce(item_category, 'Unknown')) > 1",
)

# ------------------------------------------------------------------------------------------ answers

add(
    "ans1_service_area",
    lambda w, s, d: ans.service_area(w["fct_order"]),
    f"select {t('order_date')}, count(*) as orders, {r('avg(distance)', 'avg_delivery_distance_m')}, min(distance) as min_delivery_distance_m, "
    "max(distance) as max_delivery_distance_m, quantile_disc(distance, 0.5) as p50_delivery_distance_m, "
    "quantile_disc(distance, 0.9) as p90_delivery_distance_m from ords group by order_date",
)
add(
    "ans2_items_prices",
    lambda w, s, d: ans.items_and_prices(w["fct_order_item"]),
    f"select {t('order_date')}, item_key, item_name_preferred, item_category, {b('sum(units)', 'units_sold')}, "
    f"{r(div('sum(final)', 'sum(units)'), 'weighted_avg_selling_price_eur')}, {r(div('sum(base)', 'sum(units)'), 'weighted_avg_base_price_eur')} "
    "from items group by order_date, item_key, item_name_preferred, item_category",
)
add(
    "ans3_promo_units",
    lambda w, s, d: ans.promo_units_by_day(w["fct_order_item"]),
    f"select {t('order_date')}, {b('sum(promo_units)', 'promo_units_sold')}, {b('sum(units)', 'total_units_sold')}, "
    f"{r(div('sum(promo_units)', 'sum(units)'), 'promo_unit_share')} from items group by order_date",
)
add(
    "ans4_promo_adoption",
    lambda w, s, d: ans.promo_adoption(w["rpt_customer_promo"]),
    f"select customer_sk, customer_key, n as lifetime_orders, with_p as orders_with_any_promo_units, no_p as orders_with_no_promo_units, "
    f"{b('pu', 'promo_units_purchased')}, {b('nu', 'non_promo_units_purchased')}, {n('pv', 'promo_value_eur')}, {n('nv', 'non_promo_value_eur')}, "
    f"{r(div('with_p', 'n'), 'promo_order_rate')}, {r(div('pu', 'pu + nu'), 'promo_unit_share')}, only_p as promo_only_customer_flag from cust_promo",
)
add(
    "ans5_repeat_behavior",
    lambda w, s, d: ans.repeat_behavior(w["fct_order"]),
    "select count(*) as total_customers, count(*) filter (where n = 1) as one_time_customers, count(*) filter (where n > 1) as repeat_customers, "
    f"{r(div('count(*) filter (where n > 1)', 'count(*)'), 'repeat_customer_rate')}, {r('avg(n)', 'avg_orders_per_customer')} from cust",
)
add(
    "ans6_fees",
    lambda w, s, d: ans.fees_vs_basket(w["fct_order"]),
    f"select {t('order_date')}, {n('sum(total)', 'basket_value_eur')}, {n('sum(service)', 'service_fee_eur')}, {n('sum(courier)', 'courier_base_fee_eur')}, "
    f"{r(div('sum(service)', 'sum(total)'), 'service_fee_to_basket_ratio')}, {r(div('sum(courier)', 'sum(total)'), 'courier_fee_to_basket_ratio')}, "
    f"{r(div('sum(service + courier)', 'sum(total)'), 'total_fee_to_basket_ratio')} from ords group by order_date",
)
add(
    "ans7_revenue",
    lambda w, s, d: ans.revenue_by_day(w["fct_order"]),
    f"select {t('order_date')}, count(*) as orders, {n('sum(paid)', 'total_customer_paid_revenue_proxy_eur')}, {n('sum(total)', 'basket_revenue_component_eur')}, "
    f"{n('sum(service)', 'service_fee_component_eur')}, {n('sum(courier)', 'courier_fee_component_eur')} from ords group by order_date",
)
add(
    "ans8_courier",
    lambda w, s, d: ans.courier_cost_by_day(w["fct_order"]),
    f"select {t('order_date')}, count(*) as orders, {n('sum(courier)', 'courier_cost_eur')}, "
    f"{r(div('sum(courier)', 'count(*)'), 'avg_courier_cost_per_order_eur')} from ords group by order_date",
)
add(
    "ans9_best_categories",
    lambda w, s, d: ans.best_categories(w["rpt_category_monthly"], w["fct_order_item"]),
    f"select c.cat as item_category, {n('rev', 'category_revenue_eur')}, {b('u', 'category_units_sold')}, {r(div('rev', 'u'), 'category_weighted_avg_selling_price_eur')}, "
    f"item_key as star_item_key, item_name_preferred as star_item_name, {n('v', 'star_item_revenue_eur')}, {b('su', 'star_item_units_sold')} "
    "from (select cat, sum(rev) as rev, sum(units) as u from cat_month group by all) c left join ("
    "select item_category, item_key, item_name_preferred, sum(final) as v, sum(units) as su from items group by item_category, item_key, item_name_preferred "
    "qualify row_number() over (partition by item_category order by sum(final) desc, item_key) = 1) s on s.item_category = c.cat",
)
_LAG = """(select mon, cat, rev, units, p_units as promo, ou, cast(rev as double) / units as asp, lag(rev) over w as b_rev,
  lag(units) over w as b_units, lag(cast(rev as double) / units) over w as b_asp
  from cat_month window w as (partition by cat order by mon))"""
add(
    "ans10_declining",
    lambda w, s, d: ans.declining_categories(w["rpt_category_monthly"]),
    f"select {t('mon', 'order_month')}, cat as item_category, {n('rev', 'revenue_eur')}, {n('b_rev', 'prev_revenue_eur')}, {n('rev - b_rev', 'revenue_mom_change_eur')}, "
    f"{b('units', 'units_sold')}, {b('b_units', 'prev_units_sold')}, {b('units - b_units', 'units_mom_change')}, {r('asp', 'weighted_avg_selling_price_eur')}, "
    f"{r('b_asp', 'prev_weighted_avg_selling_price_eur')}, {r('asp - b_asp', 'weighted_asp_mom_change_eur')}, {b('promo', 'promo_units_sold')}, "
    f"{r(div('promo', 'units'), 'promo_unit_share')}, {r('ou', 'avg_order_units')} from {_LAG} where rev < b_rev",
)
add(
    "ans11_pair_affinity",
    lambda w, s, d: ans.pair_affinity(w["rpt_product_pairs"]),
    f"select a as product_a, cat_a as category_a, b as product_b, cat_b as category_b, k as pair_orders, {r('support')}, {r('conf_ab', 'confidence_a_to_b')}, "
    f"{r('conf_ba', 'confidence_b_to_a')}, {r('lift')}, {r('exp_n', 'expected_pair_orders_independent')}, {r('delta', 'pair_orders_vs_expected_delta')}, "
    f"{BUCKET} as actionability_bucket from prod_pairs",
)
add(
    "ans12_consumption",
    lambda w, s, d: ans.consumption_by_time(w["fct_order_item"]),
    "select dayname(o.order_date) as order_day_name, hour(ts_local) as order_hour_berlin, item_category, count(distinct i.order_sk) as orders, "
    f"count(distinct i.customer_sk) as customers, {b('sum(units)', 'units_sold')}, {n('sum(i.final)', 'revenue_eur')} "
    "from items i join ords o using (order_sk) group by 1, 2, 3",
)
add(
    "ans13_acquisition",
    lambda w, s, d: ans.promo_acquisition(w["rpt_customer_promo"]),
    "select count(*) as customers_total, count(*) filter (where f_any) as customers_first_order_with_promo_units, "
    f"{r(div('count(*) filter (where f_any)', 'count(*)'), 'first_order_promo_acquisition_rate')}, count(*) filter (where f_only) as customers_first_order_only_promo_units, "
    f"{r(div('count(*) filter (where f_only)', 'count(*)'), 'first_order_only_promo_rate')}, count(*) filter (where only_p) as customers_always_promo_only, "
    f"{r(div('count(*) filter (where only_p)', 'count(*)'), 'lifetime_promo_only_customer_rate')} from cust_promo",
)


def _perf(where: str) -> str:
    return (
        f"select {t('mon', 'period_month')}, cat as item_category, {n('rev', 'revenue_eur')}, {b('units', 'units_sold')}, n_ord as orders_with_category, "
        f"{r(div('rev', 'units'), 'weighted_asp_eur')}, {r(div('p_units', 'units'), 'promo_unit_share')}, "
        f"{r(div('rep_cust', 'first_n + rep_cust'), 'repeat_customer_mix_ratio')}, "
        f"{r(div('rev - lag(rev) over w', 'lag(rev) over w'), 'revenue_mom_growth_ratio')}, "
        f"{r(div('units - lag(units) over w', 'lag(units) over w'), 'units_mom_growth_ratio')}, "
        f"{r(div('n_ord - lag(n_ord) over w', 'lag(n_ord) over w'), 'orders_mom_growth_ratio')} "
        f"from cat_month {where} window w as (partition by cat order by mon)"
    )


add("ans14_performance", lambda w, s, d: ans.category_performance(w["rpt_category_monthly"]), _perf(""))
add(
    "ans14_performance_year",
    lambda w, s, d: ans.category_performance(w["rpt_category_monthly"], "1998-01-01", "1998-12-01"),
    _perf("where mon between date '1998-01-01' and date '1998-12-01'"),
)
_CONTROL = f"""
with a as (
  select cat, sum(rev) as rev, sum(units) as units, sum(n_ord) as o, sum(p_units) as pu, sum(first_n) as fn, sum(rep_cust) as rc,
         avg(cast(rev as double)) as m, stddev_pop(cast(rev as double)) as sd,
         arg_min(rev, mon) as r0, arg_max(rev, mon) as r1, arg_min(units, mon) as u0, arg_max(units, mon) as u1,
         arg_min(n_ord, mon) as o0, arg_max(n_ord, mon) as o1
  from cat_month group by cat
), st as (
  select item_category, item_key, min(item_name_preferred) as nm, sum(final) as v from items group by item_category, item_key
  qualify row_number() over (partition by item_category order by sum(final) desc, item_key) = 1
)
select cat as item_category, {n('rev', 'total_revenue_eur')}, {b('units', 'total_units_sold')}, {b('o', 'total_orders_with_category')},
  {r(div('rev', 'units'), 'weighted_asp_eur')}, {r(div('pu', 'units'), 'promo_unit_share')}, {r(div('rc', 'fn + rc'), 'repeat_customer_mix_ratio')},
  {r(div('r1 - r0', 'r0'), 'revenue_growth_ratio_first_to_last')}, {r(div('u1 - u0', 'u0'), 'unit_growth_ratio_first_to_last')},
  {r(div('o1 - o0', 'o0'), 'order_growth_ratio_first_to_last')}, {r('sd / m', 'revenue_cv')}, item_key as star_item_key, nm as star_item_name,
  {n('v', 'star_item_revenue_eur')}, {r(div('v', 'rev'), 'star_item_revenue_share')},
  cast(coalesce({div('v', 'rev')} >= 0.65, false) as bigint) as control_high_star_concentration_flag,
  cast(coalesce(sd / m >= 0.6, false) as bigint) as control_high_revenue_volatility_flag,
  cast(coalesce({div('pu', 'units')} >= 0.12, false) as bigint) as control_high_promo_dependency_flag,
  cast(coalesce({div('rc', 'fn + rc')} <= 0.95, false) as bigint) as control_low_repeat_mix_flag
from a left join st on st.item_category = a.cat
"""
add(
    "ans15_controls",
    lambda w, s, d: ans.scorecard_controls(w["rpt_category_monthly"], w["fct_order_item"]),
    f"select * from ({_CONTROL})",
)
add(
    "ans16_star_detail",
    lambda w, s, d: ans.star_products_detail(w["fct_order_item"]),
    f"select item_category, item_key, nm as item_name_preferred, {n('v', 'revenue_eur')}, {b('u', 'units_sold')}, o as orders_count, "
    f"{r(div('v', 'cv'), 'revenue_share_in_category')}, {r(div('u', 'cu'), 'unit_share_in_category')}, rk as revenue_rank_in_category from ("
    "select item_category, item_key, min(item_name_preferred) as nm, sum(final) as v, sum(units) as u, count(distinct order_sk) as o, "
    "sum(sum(final)) over (partition by item_category) as cv, sum(sum(units)) over (partition by item_category) as cu, "
    "row_number() over (partition by item_category order by sum(final) desc, item_key) as rk "
    "from items where item_category is not null group by item_category, item_key) where rk <= 10",
)

# --------------------------------------------------------------------------------------- dashboards


def _last(source: str = "ords") -> str:
    return f"mon = (select max(mon) from {source})"


def tip(title: str, value: str, comment: str, source: str) -> str:
    return f"select '{title}' as insight_title, {value} as insight_value, {comment} as insight_comment {source}"


add(
    "bi1_headlines",
    lambda w, s, d: bi.latest_month_headlines(w["fct_order"], w["fct_order_item"]),
    "select 'Top category by units (latest month)' as insight_name, coalesce((select item_category from items "
    f"where mon = (select max(mon) from ords) group by item_category order by sum(units) desc, item_category nulls first limit 1), 'n/a') as insight_value "
    f"union all select 'Orders in latest month', cast(count(*) as varchar) from ords where {_last()} "
    f"union all select 'Promo order share (latest month)', {txt(div('count(*) filter (where has_promo)', 'count(*)') + ' * 100')} from ords where {_last()}",
)
add(
    "bi2_service_area",
    lambda w, s, d: bi.service_area_monthly(w["fct_order"]),
    f"select {t('mon', 'period_month')}, count(*) as orders_count, round(avg(distance), 2) as avg_delivery_distance_m, "
    "quantile_disc(distance, 0.5) as p50_delivery_distance_m, quantile_disc(distance, 0.9) as p90_delivery_distance_m from ords group by mon",
)
add(
    "bi2_insight",
    lambda w, s, d: bi.service_area_insight(w["fct_order"]),
    tip("Service area trend", f"'latest avg distance: ' || {txt('avg(distance)')} || ' m'", "'based on latest month'", f"from ords where {_last()}"),
)
add(
    "bi3_items_prices",
    lambda w, s, d: bi.items_prices_monthly(w["fct_order_item"]),
    f"select {t('mon', 'period_month')}, item_category, {b('sum(units)', 'units_sold')}, {r(div('sum(final)', 'sum(units)'), 'weighted_avg_unit_selling_price_eur')} "
    "from items group by mon, item_category",
)
add(
    "bi3_insight",
    lambda w, s, d: bi.items_prices_insight(w["fct_order_item"]),
    tip("Top category by units (latest month)", "item_category", "'units=' || cast(sum(units) as varchar)",
        f"from items where {_last('items')} group by item_category order by sum(units) desc, item_category nulls first limit 1"),
)
add(
    "bi4_promo_uptake",
    lambda w, s, d: bi.promo_uptake_monthly(w["fct_order"], w["fct_order_item"]),
    f"select {t('mon', 'period_month')}, {b('pu', 'promo_units')}, {b('u', 'total_units')}, {r(div('pu', 'u'), 'promo_unit_share')}, "
    f"po as orders_with_any_promo, o as total_orders, {r(div('po', 'o'), 'promo_order_share')} from "
    "(select mon, sum(promo_units) as pu, sum(units) as u from items group by mon) join "
    "(select mon, count(*) filter (where has_promo) as po, count(*) as o from ords group by mon) using (mon)",
)
add(
    "bi4_insight",
    lambda w, s, d: bi.promo_uptake_insight(w["fct_order_item"]),
    tip("Promo unit share (latest month)", f"{txt(div('sum(promo_units)', 'sum(units)') + ' * 100')} || '%'", "'share of units bought on promo'",
        f"from items where {_last('items')}"),
)
add(
    "bi5_repeat_orders",
    lambda w, s, d: bi.repeat_orders_monthly(w["fct_order"]),
    f"select {t('mon', 'period_month')}, count(*) filter (where is_first) as first_orders, count(*) filter (where not is_first) as repeat_orders, "
    f"{r(div('count(*) filter (where not is_first)', 'count(*)'), 'repeat_order_share')} from ords group by mon",
)
add(
    "bi5_insight",
    lambda w, s, d: bi.repeat_orders_insight(w["fct_order"]),
    tip("Repeat order share (latest month)", f"{txt(div('count(*) filter (where not is_first)', 'count(*)') + ' * 100')} || '%'",
        "'customer return signal'", f"from ords where {_last()}"),
)
add(
    "bi6_fees",
    lambda w, s, d: bi.fees_monthly(w["fct_order"]),
    f"select {t('mon', 'period_month')}, {n('sum(total)', 'basket_value_eur')}, {n('sum(service)', 'service_fee_eur')}, {n('sum(courier)', 'courier_base_fee_eur')}, "
    f"{r(div('sum(service)', 'sum(total)'), 'service_fee_to_basket_ratio')}, {r(div('sum(courier)', 'sum(total)'), 'courier_fee_to_basket_ratio')} from ords group by mon",
)
add(
    "bi6_insight",
    lambda w, s, d: bi.fees_insight(w["fct_order"]),
    tip("Service fee / basket (latest month)", f"{txt(div('sum(service)', 'sum(total)') + ' * 100')} || '%'", "'pricing pressure indicator'", f"from ords where {_last()}"),
)
add(
    "bi7_revenue",
    lambda w, s, d: bi.revenue_monthly(w["fct_order"]),
    f"select {t('mon', 'period_month')}, {n('sum(paid)', 'customer_paid_total_eur')}, {n('sum(total)', 'basket_value_eur')}, {n('sum(service)', 'service_fee_eur')}, "
    f"{n('sum(courier)', 'courier_base_fee_eur')} from ords group by mon",
)
add(
    "bi7_insight",
    lambda w, s, d: bi.revenue_insight(w["fct_order"]),
    tip("Customer paid total (latest month)", txt("sum(paid)"), "'EUR'", f"from ords where {_last()}"),
)
add(
    "bi8_courier",
    lambda w, s, d: bi.courier_monthly(w["fct_order"]),
    f"select {t('mon', 'period_month')}, {n('sum(courier)', 'total_courier_cost_eur')}, {r(div('sum(courier)', 'count(*)'), 'avg_courier_cost_per_order_eur')} from ords group by mon",
)
add(
    "bi8_insight",
    lambda w, s, d: bi.courier_insight(w["fct_order"]),
    tip("Avg courier cost per order (latest month)", txt(div("sum(courier)", "count(*)")), "'EUR per order'", f"from ords where {_last()}"),
)
add(
    "bi9_category_growth",
    lambda w, s, d: bi.category_growth(w["rpt_category_monthly"]),
    f"select {t('mon', 'period_month')}, cat as item_category, {n('rev', 'revenue_eur')}, {b('units', 'units_sold')}, {r(div('rev', 'units'), 'weighted_avg_selling_price_eur')} from cat_month",
)
add(
    "bi9_insight",
    lambda w, s, d: bi.category_growth_insight(w["rpt_category_monthly"]),
    tip("Top categories (latest month)", "concat_ws(', ', coalesce(min(cat) filter (where k = 1), 'n/a'), coalesce(min(cat) filter (where k = 2), 'n/a'), coalesce(min(cat) filter (where k = 3), 'n/a'))", "'Updates automatically after each refresh'",
        f"from (select cat, row_number() over (order by rev desc, cat) as k from cat_month where {_last('cat_month')})"),
)
add(
    "bi10_stars",
    lambda w, s, d: bi.stars_per_category(w["fct_order_item"]),
    f"select item_category, item_key, item_name_preferred, {n('sum(final)', 'revenue_eur')}, {b('sum(units)', 'units_sold')}, "
    "row_number() over (partition by item_category order by sum(final) desc, item_key, item_name_preferred nulls first) as category_rank "
    "from items group by item_category, item_key, item_name_preferred "
    "qualify row_number() over (partition by item_category order by sum(final) desc, item_key, item_name_preferred nulls first) <= 10",
)
add(
    "bi10_insight",
    lambda w, s, d: bi.stars_insight(w["fct_order_item"]),
    tip("Top product per category (sample)", "item_category || ': ' || item_name_preferred", txt("sum(final)"),
        "from items group by item_category, item_name_preferred order by sum(final) desc, item_category nulls first, item_name_preferred nulls first limit 1"),
)
_DEC = "(select *, lag(rev) over (partition by cat order by mon) as p_rev from cat_month)"
add(
    "bi11_declining",
    lambda w, s, d: bi.declining_monthly(w["rpt_category_monthly"]),
    f"select {t('mon', 'period_month')}, cat as item_category, {n('rev', 'revenue_eur')}, {n('p_rev', 'prev_revenue_eur')}, {n('rev - p_rev', 'revenue_mom_change_eur')}, "
    f"{b('units', 'units_sold')} from {_DEC} where rev < p_rev",
)
add(
    "bi11_insight",
    lambda w, s, d: bi.declining_insight(w["rpt_category_monthly"]),
    tip("Biggest declining category", "cat || ' @ ' || cast(mon as varchar)", f"'MoM change EUR: ' || {txt('rev - p_rev')}",
        f"from {_DEC} where rev < p_rev order by rev - p_rev, mon, cat limit 1"),
)
add(
    "bi12_pairs",
    lambda w, s, d: bi.strongest_pairs(w["rpt_product_pairs"]),
    f"select a || ' + ' || b as item_pair, k as pair_orders, {r('support')}, {r('conf_ab', 'confidence_a_to_b')}, {r('conf_ba', 'confidence_b_to_a')}, {r('lift')} "
    "from prod_pairs order by prod_pairs.lift desc, k desc, a || ' + ' || b limit 200",
)
add(
    "bi12_insight",
    lambda w, s, d: bi.strongest_pair_insight(w["rpt_product_pairs"]),
    tip("Strongest pair (by lift)", "a || ' + ' || b", f"'lift=' || {txt('lift', 3)} || ', orders=' || cast(k as varchar)",
        "from prod_pairs order by lift desc, k desc, a || ' + ' || b limit 1"),
)
_DAYPART = (
    "(select case when h between 6 and 10 then 'Morning (06-10)' when h between 11 and 14 then 'Lunch (11-14)' "
    "when h between 15 and 17 then 'Afternoon (15-17)' when h between 18 and 22 then 'Evening (18-22)' else 'Night (23-05)' end as daypart, "
    "item_category, cast(sum(units) as bigint) as units_sold from (select i.*, hour(ts_local) as h from items i join ords o using (order_sk)) group by 1, 2)"
)
add("bi13_dayparts", lambda w, s, d: bi.daypart_categories(w["fct_order_item"]), f"select * from {_DAYPART}")
add(
    "bi13_insight",
    lambda w, s, d: bi.daypart_insight(w["fct_order_item"]),
    tip("Top daypart-category by units", "daypart || ': ' || item_category",
        "'units=' || cast(units_sold as varchar) || '; calc=SUM(units_in_order_item_row) by Berlin daypart + category'",
        f"from {_DAYPART} order by units_sold desc, daypart, item_category nulls first limit 1"),
)
add(
    "bi14_segments",
    lambda w, s, d: bi.first_order_segments(w["rpt_customer_promo"]),
    "select 'First order had any promo' as segment, count(*) filter (where f_any) as customers from cust_promo union all "
    "select 'First order had only promo', count(*) filter (where f_only) from cust_promo union all "
    "select 'No promo on first order', count(*) filter (where not f_any) from cust_promo",
)
add(
    "bi14_insight",
    lambda w, s, d: bi.first_order_insight(w["rpt_customer_promo"]),
    tip("Promo-acquired first orders", f"{txt(div('count(*) filter (where f_any)', 'count(*)') + ' * 100')} || '%'",
        f"'Only-promo first orders: ' || {txt(div('count(*) filter (where f_only)', 'count(*)') + ' * 100')} || '%'", "from cust_promo"),
)
add(
    "bi15_star_pack",
    lambda w, s, d: ans.star_products_detail(w["fct_order_item"]).select(
        "item_category", "item_key", "revenue_eur", "revenue_rank_in_category"
    ),
    f"select item_category, item_key, {n('sum(final)', 'revenue_eur')}, row_number() over (partition by item_category order by sum(final) desc, item_key) as revenue_rank_in_category "
    "from items where item_category is not null group by item_category, item_key "
    "qualify row_number() over (partition by item_category order by sum(final) desc, item_key) <= 10",
)


def deep(w):
    return bi.deep_dive_rows(w["fct_order_item"], cfg=CFG)


add(
    "bi16_deep_dive_rows",
    lambda w, s, d: deep(w).groupBy("item_category", "adjusted_category").agg(F.count(F.lit(1)).alias("row_count")),
    "select cat as item_category, adj as adjusted_category, count(*) as row_count from dd group by all",
)
_SW = {
    "Revenue EUR": "rev", "Orders": "o", "Customers": "k", "Units Sold": "u", "Discount Rate": div("ds", "bs"),
    "Weighted Avg Selling Price EUR": div("rev", "u"), "Revenue Per Order EUR": div("rev", "o"),
}
add(
    "bi17_switchable_kpis",
    lambda w, s, d: bi.switchable_kpis(deep(w)),
    "with m as (select mon, cat, sum(final) as rev, count(distinct order_sk) as o, count(distinct customer_sk) as k, sum(units) as u, "
    "sum(row_disc) as ds, sum(base) as bs from dd group by mon, cat) select * from ("
    + " union all ".join(
        f"select {t('mon', 'period_month')}, cat as item_category, '{k}' as kpi_name, {r(v, 'kpi_value')} from m" for k, v in _SW.items()
    ) + ")",
)


def _scale(column: str, name: str, extra: bool) -> str:
    more = f", {r(div('sum(final)', 'sum(units)'), 'asp_eur')}, {r(div('sum(row_disc)', 'sum(base)'), 'discount_rate')}" if extra else ""
    return (
        f"select {column} as {name}, {n('sum(final)', 'revenue_eur')}, {r(div('sum(final)', '(select sum(final) from dd)'), 'revenue_share')}, "
        f"count(distinct order_sk) as orders, {r(div('count(distinct order_sk)', '(select count(distinct order_sk) from dd)'), 'order_penetration')}, "
        f"count(distinct customer_sk) as customers, {r(div('count(distinct customer_sk)', '(select count(distinct customer_sk) from dd)'), 'customer_penetration')}, "
        f"{b('sum(units)', 'units_sold')}{more} from dd group by {column}"
    )


add("bi18_category_scale", lambda w, s, d: bi.category_scale(deep(w)), _scale("cat", "item_category", False))
_SPREAD = (
    "(select cat, count(*) as skus, sum(v) as cv, sum(v) filter (where rk = 1) as v1, sum(v) filter (where rk <= 3) as v3 from ("
    "select cat, prod, sum(final) as v, row_number() over (partition by cat order by sum(final) desc, prod) as rk from dd group by cat, prod) group by cat)"
)
add(
    "bi19_category_quality",
    lambda w, s, d: bi.category_quality(deep(w)),
    f"select c.cat as item_category, {r(div('rev', 'u'), 'asp_eur')}, {r(div('ds', 'bs'), 'discount_rate')}, {r(div('rev', 'o'), 'revenue_per_order_eur')}, "
    f"{r(div('u', 'o'), 'units_per_order')}, {r('opc', 'orders_per_customer')}, {r('rr', 'repeat_customer_rate')}, skus as sku_count, "
    f"{r(div('v1', 'rev'), 'top_sku_share')}, {r(div('v3', 'rev'), 'top_3_share')} from "
    "(select cat, sum(final) as rev, sum(base) as bs, sum(row_disc) as ds, sum(units) as u, count(distinct order_sk) as o from dd group by cat) c join "
    "(select cat, avg(m) as opc, count(*) filter (where m > 1)::double / count(*) as rr from (select cat, customer_sk, count(distinct order_sk) as m from dd group by cat, customer_sk) group by cat) x "
    f"on x.cat = c.cat join {_SPREAD} y on y.cat = c.cat",
)
add("bi20_adjusted_scale", lambda w, s, d: bi.adjusted_category_scale(deep(w)), _scale("adj", "adjusted_category", True))
add(
    "bi21_trend",
    lambda w, s, d: bi.category_trend(deep(w)),
    f"select {t('mon', 'period_month')}, cat as item_category, {n('sum(final)', 'revenue_eur')}, {b('sum(units)', 'units_sold')} from dd group by mon, cat",
)
_ATTACH = (
    "with oc as (select distinct order_sk, cat from dd), bs as (select cat, count(*) as o from oc group by cat) "
    "select x.cat as base_category, y.cat as attached_category, any_value(o) as base_orders, count(*) as attached_orders, "
    "round(count(*)::double / any_value(o), 6) as attach_rate from oc x join oc y on x.order_sk = y.order_sk and x.cat <> y.cat join bs on bs.cat = x.cat "
    "group by x.cat, y.cat order by count(*)::double / any_value(o) desc, count(*) desc, x.cat, y.cat limit 50"
)
add("bi22_attach_rates", lambda w, s, d: bi.attach_rates(deep(w)), f"select * from ({_ATTACH})")
add(
    "bi23_star_skus",
    lambda w, s, d: bi.star_skus(deep(w)),
    f"select prod as product_name, string_agg(distinct cat, ', ' order by cat) as category_mapping_in_file, {n('sum(final)', 'revenue_eur')}, "
    f"{r(div('sum(final)', '(select sum(final) from dd)'), 'revenue_share')}, count(distinct order_sk) as orders, count(distinct customer_sk) as customers, "
    f"{r(div('sum(final)', 'sum(units)'), 'asp_eur')}, {r(div('sum(row_disc)', 'sum(base)'), 'discount_rate')} from dd group by prod order by sum(final) desc, prod limit 10",
)


def _summary(words) -> str:
    raw_title, adj_title, prefix, top_title, top_note, at_title, at_note = words
    return (
        f"select * from (select '{raw_title}' as insight_title, cat as insight_value, '{prefix}' || {txt('sum(final)')} as insight_comment from dd group by cat order by sum(final) desc, cat limit 1) "
        f"union all select * from (select '{adj_title}', adj, '{prefix}' || {txt('sum(final)')} from dd group by adj order by sum(final) desc, adj limit 1) "
        f"union all select '{top_title}', {txt(div('sum(v)', '(select sum(final) from dd)') + ' * 100')}, '{top_note}' from "
        "(select prod, sum(final) as v from dd group by prod order by v desc, prod limit 2) "
        f"union all select '{at_title}', {txt(div('count(*) filter (where x and y)', 'count(*) filter (where x)') + ' * 100')}, '{at_note}' from "
        "(select order_sk, bool_or(cat = 'LARGE') as x, bool_or(cat = 'SMALL') as y from dd group by order_sk)"
    )


add("bi24_summary", lambda w, s, d: bi.executive_summary(deep(w), CFG), _summary(bi.SUMMARY_DEEP_DIVE))
add(
    "bi25_overview",
    lambda w, s, d: bi.overview_kpis(deep(w)),
    "select count(*) as order_item_rows, count(distinct order_sk) as orders, count(distinct customer_sk) as customers, count(distinct item_key) as products, "
    f"count(distinct cat) as categories, {b('sum(units)', 'units_sold')}, round(cast(sum(final) as double), 2) as final_revenue_eur, "
    f"round(cast(sum(base) as double), 2) as base_revenue_eur, round(cast(sum(row_disc) as double), 2) as discount_eur, "
    f"round({div('sum(row_disc)', 'sum(base)')}, 4) as discount_rate from dd",
)
add(
    "bi26_raw_adjusted",
    lambda w, s, d: bi.raw_and_adjusted_scorecard(deep(w)),
    f"select 'raw' as view_type, * from ({_scale('cat', 'category', True)}) union all select 'adjusted', * from ({_scale('adj', 'category', True)})",
)
for _kind, _column, _sql in (("raw", "item_category", "cat"), ("adjusted", "adjusted_category", "adj")):
    add(
        f"bi27_revenue_{_kind}",
        lambda w, s, d, c=_column: bi.revenue_by_category(deep(w), c),
        f"select {_sql} as category, {n('sum(final)', 'revenue_eur')} from dd group by {_sql}",
    )
add(
    "bi28_trend",
    lambda w, s, d: bi.revenue_trend(deep(w)),
    f"select {t('mon', 'period_month')}, cat as category, {n('sum(final)', 'revenue_eur')} from dd group by mon, cat",
)
add(
    "bi28_growth",
    lambda w, s, d: bi.revenue_growth(deep(w)),
    f"select {t('mon', 'period_month')}, cat as category, {r(div('v - lag(v) over w', 'lag(v) over w'), 'mom_growth_ratio')} from "
    "(select mon, cat, sum(final) as v from dd group by mon, cat) window w as (partition by cat order by mon)",
)
add(
    "bi29_discount_concentration",
    lambda w, s, d: bi.discount_and_concentration(deep(w)),
    f"select c.cat as category, {r(div('ds', 'bs'), 'discount_rate')}, {r(div('v1', 'cv'), 'top_sku_share')}, {r(div('v3', 'cv'), 'top_3_share')}, skus as sku_count "
    f"from (select cat, sum(base) as bs, sum(row_disc) as ds from dd group by cat) c join {_SPREAD} y on y.cat = c.cat",
)
add("bi30_summary_overview", lambda w, s, d: bi.executive_summary(deep(w), CFG, bi.SUMMARY_OVERVIEW), _summary(bi.SUMMARY_OVERVIEW))
assert len(KPI) == len(rpt.KPI_LABELS)
