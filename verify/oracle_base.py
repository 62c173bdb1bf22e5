"""Shared pieces of the oracle: the raw feeds, staging, history, facts and marts as DuckDB CTEs.

Written independently of the Spark code, straight from the rules in `verify/fixtures.py` and the data model.
`sql(final)` puts the CTEs a statement mentions in front of it.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}


def sk(*cols: str) -> str:
    parts = ", ".join(f"coalesce(cast({c} as varchar), '_dbt_null_')" for c in cols)
    return f"md5(concat_ws('||', {parts}))"


def t(col: str, name: str | None = None) -> str:
    """Dates and timestamps as text."""
    return f"cast({col} as varchar) as {name or col.split('.')[-1]}"


def b(col: str, name: str | None = None) -> str:
    return f"cast({col} as bigint) as {name or col.split('.')[-1]}"


def n(col: str, name: str | None = None) -> str:
    """Money and other decimals as double."""
    return f"cast({col} as double) as {name or col.split('.')[-1]}"


def r(col: str, name: str | None = None) -> str:
    """Ratios, rounded."""
    return f"round(cast({col} as double), 6) as {name or col.split('.')[-1]}"


def div(x: str, y: str) -> str:
    return f"(cast({x} as double) / nullif(cast({y} as double), 0))"


def txt(x: str, digits: int = 2) -> str:
    return (
        f"regexp_replace(cast(cast(round(cast({x} as double), {digits}) as decimal(38,{digits})) as varchar), "
        r"'\.?0+$', '')"
    )


def sql(final: str) -> str:
    if final.lstrip().lower().startswith("with "):
        final = f"select * from ({final})"
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(final)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{c} AS MATERIALIZED ({CTES[c]})" for c in order) + "\n" + final


BERLIN = "timezone('Europe/Berlin', timezone('UTC', {0}))"


def berlin(ts: str) -> str:
    return BERLIN.format(ts)


CTES["raw_logs"] = """
with g as (
  select p_partkey p, v, p_name, p_brand, p_type, cast(round(p_retailprice * 100) as bigint) c,
         case when p_partkey % 3 = 0 and v in (2, 4) then v - 1 else v end step
  from part, (select unnest(range(0, 5)) v)
), h as (
  select p, v, 'L' || p || '-' || v as log_item_id, 'I' || p as item_key,
         timestamp '1995-01-01' + to_seconds((v * 450 + p % 97) * 86400 + (p % 24) * 3600) as ts,
         case when p % 13 = 0 and v = 2 then null
              else (case when p % 17 = 0 and v = 1 then -1 else 1 end)
                 * (case when p % 29 = 0 and v = 3 then 6 else 1 end) * (c * (100 + 5 * step) // 100) end as cents,
         case when p % 19 = 0 or p % 400 = 3 then null else p_name end as en,
         case when p % 400 = 3 then null else 'de ' || p_name end as de,
         case when p % 31 = 0 then null when p % 37 = 0 then ' ' else p_brand end as brand,
         case when p % 40 = 7 then null when p % 50 = 0 and v >= 3 then 'SEASONAL' else p_type end as category,
         p % 6 + 1 as pieces, case when p % 23 = 0 then null else 50 + p % 450 end as grams,
         case when p % 2 = 0 then 7 else 19 end as vat
  from g
), k as (select *, ts - interval 1 day as src from h)
select * from k
union all by name
select * replace (ts - interval 2 hour as ts, abs(cents) + 100 as cents) from k where p % 7 = 0 and v = 1
union all by name
select * replace ('X' || p as log_item_id, src + interval 2 day as src, coalesce(cents, 5000) + 300 as cents)
from k where p % 11 = 0 and v = 2
union all by name
select * replace ('N' || p as log_item_id, null as ts) from k where p % 43 = 0 and v = 0
"""
CTES["stg_logs"] = """
select log_item_id, item_key, ts, en as item_name_en, de as item_name_de, coalesce(en, de) as item_name_preferred,
       brand as brand_name, category as item_category, cast(pieces as bigint) as number_of_units,
       cast(grams as bigint) as weight_in_grams,
       cast(cast(cents as decimal(16,0)) * cast(0.01 as decimal(3,2)) as decimal(18,4)) as price,
       cast(vat as decimal(18,4)) as vat_rate_pct, src
from raw_logs
"""
CTES["logs_best"] = """
select * from stg_logs where ts is not null
qualify row_number() over (partition by log_item_id order by coalesce(price > 0, false) desc, ts desc) = 1
"""
CTES["logs_slot"] = """
select * from logs_best
qualify row_number() over (partition by item_key, ts
  order by coalesce(price > 0, false) desc, src desc nulls last, log_item_id desc) = 1
"""
CTES["logs_cur"] = "select * from logs_slot where price > 0"
STATE = (
    "item_name_en, item_name_de, item_name_preferred, item_category, brand_name, number_of_units, weight_in_grams, "
    "price, vat_rate_pct"
)
CTES["scd"] = f"""
with o as (
  select *, row({STATE}) as st, lag(row({STATE})) over w as before, row_number() over w as rn
  from logs_cur window w as (partition by item_key order by ts, log_item_id)
), c as (select * from o where rn = 1 or st is distinct from before)
select {sk("item_key", "cast(ts as varchar) || '+00'", "log_item_id")} as item_scd_sk, {sk("item_key")} as item_key_sk,
       item_key, log_item_id, ts as valid_from,
       coalesce(lead(ts) over (partition by item_key order by ts, log_item_id), timestamp '9999-12-31 23:59:59') as valid_to,
       lead(ts) over (partition by item_key order by ts, log_item_id) is null as is_current,
       {STATE}, src
from c
"""
CTES["lines"] = """
select 'P' || l_orderkey as purchase_key, 'I' || l_partkey as item_key, sum(cast(l_quantity as bigint))::bigint as units
from lineitem where cast(l_quantity as bigint) > 0 group by all
"""
CTES["raw_buys"] = """
select 'P' || o_orderkey as purchase_key, 'C' || o_custkey as customer_key,
       case when o_orderkey % 997 <> 0 then o_orderdate + to_seconds(o_orderkey * 7919 % 86400) end as ts,
       100 + o_orderkey * 31 % 9000 as distance, cast((o_orderkey % 5) * 0.50 as decimal(18,4)) as service,
       cast(2 + (o_orderkey % 7) * 0.25 as decimal(18,4)) as courier,
       case when o_orderkey % 1499 <> 0 then cast(cast(o_totalprice as decimal(18,2)) as decimal(18,4)) end as total
from orders
"""
CTES["buys"] = f"""
select *, cast(ts as date) as day_utc, cast({berlin("ts")} as date) as day_local from raw_buys where ts is not null
"""
CTES["stg_promo"] = """
with p as (select p_partkey k, 'I' || p_partkey as item_key, date '1996-01-01' + cast(p_partkey % 300 as int) as d from part)
select item_key, d as s, d + 180 as e, 'discount' as kind, 10 + (k % 4) * 10 as pct from p where k % 5 = 0
union all select item_key, d, d + 180, 'discount', 10 + (k % 4) * 10 from p where k % 500 = 0
union all select item_key, d + 90, d + 270, 'bundle', 10 + (k % 3) * 10 from p where k % 10 = 0
union all select item_key, date '1999-03-10', date '2001-06-20', 'loyalty', 5 from p where k % 97 = 0
union all select item_key, date '1998-02-01', date '1998-02-15', 'clearance', 95 from p where k % 250 = 0
union all select 'U' || k, date '1997-01-01', date '1997-01-31', 'discount', case when k % 400 = 0 then 120 else 92 end
          from p where k % 200 = 0
union all select item_key, null, date '1997-05-01', 'discount', 15 from p where k % 600 = 1
"""
CTES["promo_dim"] = f"""
select distinct {sk("item_key", "s", "e", "kind", "pct")} as promo_sk, {sk("item_key")} as item_key_sk, item_key,
       kind, cast(pct as bigint) as pct, s, e
from stg_promo
"""
CTES["priced"] = f"""
select {sk("l.purchase_key", "l.item_key")} as order_item_sk, {sk("l.purchase_key")} as order_sk,
       {sk("w.customer_key")} as customer_sk, l.purchase_key, w.customer_key, w.ts, w.day_utc, w.day_local, l.item_key,
       l.units, h.item_key_sk, h.item_scd_sk, h.item_name_en, h.item_name_de, h.item_name_preferred, h.item_category,
       h.brand_name, h.price as unit_price, h.vat_rate_pct, h.valid_from, h.valid_to
from lines l join buys w using (purchase_key)
left join scd h on h.item_key = l.item_key and w.ts >= h.valid_from and w.ts < h.valid_to
"""
CTES["promoted"] = """
with m as (
  select a.*, p.promo_sk, p.kind as promo_type, p.pct
  from priced a left join promo_dim p on p.item_key = a.item_key and a.day_local >= p.s and a.day_local < p.e
  qualify row_number() over (partition by a.order_item_sk
    order by p.pct desc nulls last, p.s desc nulls last, p.promo_sk desc nulls last) = 1
), q as (
  select *, coalesce(pct, 0) as disc, coalesce(unit_price, cast(0 as decimal(18,4))) as up,
         cast(coalesce(pct, 0) as decimal(9,0)) * cast(0.01 as decimal(3,2)) as f
  from m
), z as (
  select *, cast(up * cast(units as decimal(9,0)) as decimal(18,4)) as base, cast(up * f as decimal(18,4)) as unit_disc
  from q
)
select *, cast(base * f as decimal(18,4)) as row_disc, cast(base - base * f as decimal(18,4)) as final,
       cast(up - unit_disc as decimal(18,4)) as unit_final, disc > 0 as is_promo
from z
"""
CTES["items"] = """
select *, day_local as order_date, date_trunc('month', day_local)::date as mon,
       coalesce(item_name_preferred, item_name_en, item_name_de) as product,
       case when is_promo then units else 0 end as promo_units
from promoted
"""
CTES["ords"] = f"""
with g as (
  select order_sk, count(*) as n_rows, sum(units) as n_units, count(*) filter (where is_promo) as p_rows, sum(promo_units) as p_units,
         sum(base) as base, sum(row_disc) as disc, sum(final) as final
  from items group by all
)
select {sk("w.purchase_key")} as order_sk, {sk("w.customer_key")} as customer_sk, w.purchase_key, w.customer_key, w.ts,
       {berlin("w.ts")} as ts_local, w.day_utc, w.day_local as order_date, date_trunc('month', w.day_local)::date as mon,
       w.distance, w.total, w.service, w.courier, w.total + w.service as with_service,
       w.total + w.service + w.courier as paid, coalesce(g.n_units, 0) as n_units, coalesce(g.n_rows, 0) as n_rows,
       coalesce(g.p_rows, 0) as p_rows, coalesce(g.p_units, 0) as p_units, coalesce(g.base, 0) as base,
       coalesce(g.disc, 0) as disc, coalesce(g.final, 0) as final,
       row_number() over (partition by w.customer_key order by w.ts, w.purchase_key) as seq,
       row_number() over (partition by w.customer_key order by w.ts, w.purchase_key) = 1 as is_first,
       coalesce(g.p_units, 0) > 0 as has_promo
from buys w left join g on g.order_sk = {sk("w.purchase_key")}
"""
CTES["cust"] = """
select customer_sk, min(customer_key) as customer_key, min(ts) as first_ts, max(ts) as last_ts, count(*) as n,
       sum(total) as value, count(*) filter (where has_promo) as promo_n, bool_or(is_first and has_promo) as first_promo
from ords group by all
"""
CTES["cat_rows"] = """
select mon, coalesce(item_category, 'Unknown') as cat, order_sk, customer_sk, units, final, base, row_disc, promo_units,
       coalesce(product, 'Unknown Item') as prod
from items
"""
CTES["cat_month"] = f"""
with c as (
  select mon, cat, sum(final) as rev, sum(base) as base, sum(row_disc) as disc, sum(units) as units,
         sum(promo_units) as p_units, count(distinct order_sk) as n_ord, count(distinct customer_sk) as n_cust,
         count(distinct prod) as skus
  from cat_rows group by all
), tot as (
  select mon, sum(final) as t_rev, count(distinct order_sk) as t_ord, count(distinct customer_sk) as t_cust
  from cat_rows group by all
), rep as (
  select mon, cat, count(*) filter (where k > 1) as rep_n, count(*) as all_n
  from (select mon, cat, customer_sk, count(distinct order_sk) as k from cat_rows group by all) group by all
), pr as (
  select *, row_number() over (partition by mon, cat order by prev desc, prod) as rk
  from (select mon, cat, prod, sum(final) as prev from cat_rows group by all)
), con as (
  select mon, cat, {div("sum(case when rk = 1 then prev else 0 end)", "sum(prev)")} as top1,
         {div("sum(case when rk <= 3 then prev else 0 end)", "sum(prev)")} as top3
  from pr group by all
), oc as (select distinct mon, order_sk, cat from cat_rows),
pairs as (
  select x.mon, x.cat, y.cat as other, count(*) as k from oc x join oc y on x.order_sk = y.order_sk and x.mon = y.mon and x.cat <> y.cat
  group by all
), att as (
  select mon, cat, other, {div("k", "n_ord")} as rate from pairs join c using (mon, cat)
  qualify row_number() over (partition by mon, cat order by {div("k", "n_ord")} desc, k desc, other) = 1
), ctx as (
  select o.mon, m.cat, count(distinct case when is_first then o.customer_sk end) as first_n,
         count(distinct case when not is_first then o.customer_sk end) as rep_cust, avg(distance) as dist, avg(n_units) as ou
  from ords o join (select distinct order_sk, cat from oc) m using (order_sk) group by all
)
select c.*, t_rev, t_ord, t_cust, {div("rep_n", "all_n")} as rep_rate, coalesce(top1, 0) as top1, coalesce(top3, 0) as top3,
       con.top1 as top1_or_null, con.top3 as top3_or_null,
       other, coalesce(rate, 0) as rate, coalesce(first_n, 0) as first_n, coalesce(rep_cust, 0) as rep_cust, ou, dist
from c join tot using (mon) left join rep using (mon, cat) left join con using (mon, cat)
left join att using (mon, cat) left join ctx using (mon, cat)
"""
KPI = {
    "Revenue EUR": "rev", "Base Revenue EUR": "base", "Discount EUR": "disc", "Discount Rate": div("disc", "base"),
    "Units": "units", "Orders": "n_ord", "Customers": "n_cust", "Revenue Share": div("rev", "t_rev"),
    "Order Penetration": div("n_ord", "t_ord"), "Customer Penetration": div("n_cust", "t_cust"),
    "ASP EUR": div("rev", "units"), "Revenue Per Order EUR": div("rev", "n_ord"), "Units Per Order": div("units", "n_ord"),
    "Orders Per Customer": div("n_ord", "n_cust"), "Repeat Customer Rate": "rep_rate", "SKU Count": "skus",
    "Top SKU Share": "top1", "Top 3 Share": "top3", "Cross-sell Attach Rate": "rate",
}
CTES["kpi"] = " union all ".join(
    f"select mon, cat, '{k}' as metric, cast({v} as double) as val from cat_month" for k, v in KPI.items()
)
CTES["kpi_mom"] = f"""
select *, val - prev as delta, {div("val - prev", "prev")} as pct
from (select *, lag(val) over (partition by cat, metric order by mon) as prev from kpi)
"""
CTES["cust_promo"] = """
with o as (
  select customer_sk, order_sk, sum(promo_units) as pu, sum(units - promo_units) as nu,
         sum(case when is_promo then final else 0 end) as pv, sum(case when is_promo then 0 else final end) as nv
  from items group by all
)
select o.customer_sk, min(d.customer_key) as customer_key, min(d.ts) as first_ts, min(d.ts_local) as first_local,
       bool_or(is_first and pu > 0) as f_any, bool_or(is_first and pu > 0 and nu = 0) as f_only, count(*) filter (where pu > 0) as with_p,
       count(*) filter (where pu = 0) as no_p, sum(pu) as pu, sum(nu) as nu, sum(pv) as pv, sum(nv) as nv,
       sum(pu) > 0 and sum(nu) = 0 as only_p, count(*) as n
from o join ords d using (order_sk) group by o.customer_sk
"""


def affinity(pairs: str, singles: str, total: str) -> str:
    """Scored pairs from (a, b, k), (a, k) and a one-row total."""
    return f"""
with s0 as (
  select p.a, p.b, p.k, x.k as ka, y.k as kb, t.k as tot,
         p.k::double / t.k as support, (x.k::double / t.k) * (y.k::double / t.k) as exp_s,
         p.k::double / x.k as conf_ab, p.k::double / y.k as conf_ba
  from ({pairs}) p join ({singles}) x on x.a = p.a join ({singles}) y on y.a = p.b, ({total}) t
), s1 as (select *, exp_s * tot as exp_n, support / exp_s as lift from s0)
select *, k - exp_n as delta, (k - exp_n) / nullif(exp_n, 0) as delta_pct,
       case when lift >= 1.3 and support >= 0.02 then 1 when lift >= 1.3 then 2
            when support >= 0.02 and lift between 0.9 and 1.1 then 3 when lift < 0.9 then 5 else 4 end as rk
from s1
"""


BUCKET = """case rk when 1 then 'Strong Affinity (Bundle Candidate)' when 2 then 'Niche Affinity'
  when 3 then 'Popularity Effect (Lift ~ 1)' when 5 then 'Substitution / Avoidance' else 'Monitor' end"""
_OC = "(select distinct order_sk, item_category as c from items where item_category is not null)"
CTES["cat_pairs"] = affinity(
    f"select x.c as a, y.c as b, count(*) as k from {_OC} x join {_OC} y on x.order_sk = y.order_sk and x.c < y.c group by all",
    f"select c as a, count(*) as k from {_OC} group by all",
    "select count(distinct order_sk) as k from items where item_category is not null",
)
CTES["top30"] = """
select product from items where product is not null group by product order by sum(final) desc, product limit 30
"""
_OP = "(select distinct order_sk, product as c from items where product in (select product from top30))"
CTES["prod_pairs0"] = affinity(
    f"select x.c as a, y.c as b, count(*) as k from {_OP} x join {_OP} y on x.order_sk = y.order_sk and x.c < y.c "
    "group by all having count(*) >= 50",
    f"select c as a, count(*) as k from {_OP} group by all",
    "select count(distinct order_sk) as k from items",
)
CTES["prod_pairs"] = """
with m as (
  select product, item_category as cat from items where product is not null and item_category is not null
  group by product, item_category qualify row_number() over (partition by product order by sum(final) desc, item_category) = 1
)
select p.*, x.cat as cat_a, y.cat as cat_b from prod_pairs0 p left join m x on x.product = p.a left join m y on y.product = p.b
"""
CTES["ev"] = """
select 'E' || lpad(cast(event_id // 2 as varchar), 12, '0') as log_item_id, 'U' || user_id as item_key,
       date_trunc('hour', ts) as ts, event_type as item_category,
       case when event_id % 7 = 0 then null when event_id % 11 = 0 then -cast(value as decimal(18,2))
            else cast(value as decimal(18,2)) end::decimal(18,4) as price,
       ts as src, lpad(cast(event_id as varchar), 12, '0') as raw
from events
"""
CTES["ev_best"] = """
select * from ev qualify row_number() over (partition by log_item_id order by coalesce(price > 0, false) desc, ts desc, raw desc) = 1
"""
CTES["ev_slot"] = """
select * from ev_best qualify row_number() over (partition by item_key, ts
  order by coalesce(price > 0, false) desc, src desc nulls last, log_item_id desc, raw desc) = 1
"""
CTES["ev_cur"] = "select * from ev_slot where price > 0"
CTES["ev_state"] = f"""
select *, {sk("null", "null", "null", "item_category", "null", "null", "null", "price", "null")} as st from ev_cur
"""
CTES["ev_scd"] = f"""
with c as (
  select * from ev_state
  qualify lag(st) over (partition by item_key order by ts, log_item_id) is distinct from st
)
select {sk("item_key", "cast(ts as varchar) || '+00'", "log_item_id")} as item_scd_sk, item_key, log_item_id, ts as valid_from,
       coalesce(lead(ts) over w, timestamp '9999-12-31 23:59:59') as valid_to, lead(ts) over w is null as is_current,
       item_category, price, st
from c window w as (partition by item_key order by ts, log_item_id)
"""
CTES["cur_audit"] = """
select s.log_item_id, n as raw_n, n, no_time, n - no_time as timed, good, n - good as bad, x.ts as c_ts, x.price as c_price,
       case when n = no_time then 'excluded_all_rows_invalid_time'
            when x.log_item_id is null then 'excluded_by_item_timestamp_conflict_resolution'
            when not coalesce(x.price > 0, false) then 'excluded_best_candidate_invalid_price'
            else 'included_best_candidate_positive_price' end as why,
       c.log_item_id is not null as there, c.ts as k_ts, c.price as k_price
from (select log_item_id, count(*) as n, count(*) filter (where ts is null) as no_time, count(*) filter (where coalesce(price > 0, false)) as good
      from stg_logs group by all) s
left join logs_slot x using (log_item_id) left join logs_cur c using (log_item_id)
"""
CTES["price_anom"] = f"""
with st as (
  select item_key, count(*) as obs, quantile_disc(price, 0.25) as p25, quantile_disc(price, 0.5) as p50,
         quantile_disc(price, 0.75) as p75, quantile_disc(price, 0.95) as p95
  from logs_cur group by all
), w as (
  select log_item_id, item_key, ts, price, lag(price) over (partition by item_key order by ts, log_item_id) as prev from logs_cur
), x as (
  select w.*, obs, p25, p50, p75, p95, p75 - p25 as iqr, {div("price", "prev")} as ratio
  from w join st using (item_key)
), f as (
  select *, coalesce(ratio >= 5 or ratio <= 0.2, false) as extreme, coalesce(ratio >= 3 or ratio <= 0.33, false) as large,
         obs >= 8 and (price::double > p95::double + greatest(0.5, 1.5 * iqr::double)
                       or price::double < greatest(0.0, p25::double - 1.5 * iqr::double)) as stat
  from x
)
select *, case when extreme then 'critical' when large or stat then 'warning' else 'ok' end as sev,
       case when extreme then 'extreme_price_jump_vs_previous_log' when large then 'large_price_jump_vs_previous_log'
            when stat then 'price_statistical_outlier' else 'normal_price_pattern' end as why
from f
"""
CTES["promo_anom"] = """
with i as (
  select item_key, count(*) as obs, quantile_disc(pct, 0.25) as p25, quantile_disc(pct, 0.5) as p50,
         quantile_disc(pct, 0.75) as p75, quantile_disc(pct, 0.95) as p95 from promo_dim group by all
), g as (
  select count(*) as g_obs, quantile_disc(pct, 0.25) as g25, quantile_disc(pct, 0.5) as g50,
         quantile_disc(pct, 0.75) as g75, quantile_disc(pct, 0.95) as g95 from promo_dim
), f as (
  select d.*, i.obs, i.p50, i.p95, i.p75 - i.p25 as iqr, g_obs, g50, g95, g75 - g25 as g_iqr, pct < 0 or pct > 100 as hard,
         pct >= 90 as extreme,
         pct > case when i.obs >= 5 then i.p95 + greatest(5.0, 1.5 * (i.p75 - i.p25))
                    else g95 + greatest(5.0, 1.5 * (g75 - g25)) end as stat
  from promo_dim d join i using (item_key), g
)
select *, case when hard or extreme then 'critical' when stat then 'warning' else 'ok' end as sev,
       case when hard then 'discount_outside_0_100' when extreme then 'discount_at_or_above_90'
            when stat then 'discount_statistical_outlier' else 'normal_discount_range' end as why
from f
"""
CTES["recon"] = """
with d as (select o.purchase_key, coalesce(sum(i.final), 0) as derived from ords o left join items i using (order_sk) group by all)
select purchase_key, derived, b.total as raw, abs(derived - coalesce(b.total, 0)) as gap,
       case when b.total is null then 'raw_total_basket_value_unparsable'
            when abs(derived - b.total) > 0.001 then 'derived_vs_raw_value_mismatch' end as why
from d join raw_buys b using (purchase_key) where b.total is null or abs(derived - b.total) > 0.001
"""
CTES["coverage"] = """
select d.*, exists (select 1 from scd s where s.item_key = d.item_key) as found from promo_dim d
"""
CTES["dd"] = """
select order_date, mon, order_sk, customer_sk, item_key, coalesce(product, 'Unknown Item') as prod,
       coalesce(item_category, 'Unknown') as cat,
       case when lower(coalesce(product, 'Unknown Item')) like '%red%' then 'RED GOODS' else coalesce(item_category, 'Unknown') end as adj,
       units, final, base, row_disc
from items
"""
