"""Physical plans that matter at scale."""

from pyspark.sql import functions as F

from basketry.operators import curation, pairs, temporal
from basketry.operators.joins import with_totals
from basketry.operators.ranking import sizes
from basketry.plans import dashboards, quality, reporting
from basketry.sources import write_table_layout
from tests.helpers import partition_filters, plan
from verify import fixtures
from verify.registry import warehouse

SF = "/root/testdata/sf0.001"


def test_dedupe_limits_groups_before_the_shuffle(spark):
    text = plan(curation.best_per_log(fixtures.event_item_logs(spark, SF)))
    assert text.count("WindowGroupLimit") == 2


def test_small_history_needs_no_shuffle_of_facts(spark):
    w = warehouse(spark, SF)
    facts = w["fct_order_item"].select("order_item_sk", "item_key", F.col("order_ts_utc").alias("time_order_received_utc"))
    text = plan(temporal.time_valid_join(facts, w["int_item_scd2"], attributes=("item_scd_sk",)))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_totals_are_a_subquery_not_a_join(spark):
    w = warehouse(spark, SF)
    items = w["fct_order_item"]
    df = with_totals(items.groupBy("item_key").count(), items.agg(F.count(F.lit(1)).alias("n")))
    assert "Join" not in plan(df) and "CartesianProduct" not in plan(df)


def test_marts_have_no_nested_loop_joins(spark):
    w = warehouse(spark, SF)
    items, orders = w["fct_order_item"], w["fct_order"]
    for df in (
        reporting.category_monthly(items, orders), reporting.category_scorecard(items), reporting.category_pairs(items),
        reporting.product_pairs(items), reporting.star_products(items), reporting.customer_promo_behavior(items, orders),
    ):
        assert "NestedLoop" not in plan(df) and "CartesianProduct" not in plan(df)


def test_pairs_do_not_join_orders_to_themselves(spark):
    items = warehouse(spark, SF)["fct_order_item"]
    assert "Join" not in plan(pairs.basket_pairs(items, "order_sk", "item_category"))


def test_scan_reads_only_needed_columns_and_pushes_filters(spark):
    orders = fixtures.table(spark, SF, "orders")
    df = orders.where(F.col("o_totalprice") > 1000).groupBy("o_custkey").count()
    text = plan(df)
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in text


def scans_of(df, column: str) -> list[str]:
    """Scans that read a column in the plan as it ran; what adaptive execution reused appears once."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().executedPlan().toString()
    return [line for line in ran.splitlines() if "FileScan" in line and column in line]


def test_reports_by_category_read_the_item_fact_once_beside_the_stored_fold(spark, scratch):
    w = warehouse(spark, SF)
    w["fct_order_item"].write.parquet(f"{scratch}/items")
    items = spark.read.parquet(f"{scratch}/items")
    stored = w["int_order_categories"]
    for report in (reporting.category_monthly(items, w["fct_order"], stored), reporting.category_scorecard(items, stored)):
        assert "Expand" not in plan(report)
        assert len(scans_of(report, reporting.REVENUE)) == 1
    assert len(scans_of(reporting.order_categories(items, w["fct_order"]), reporting.REVENUE)) == 1


def test_distinct_counts_repeat_no_row_and_scan_once(spark, scratch):
    spark.range(5000).selectExpr("id % 70 as a", "if(id % 11 = 0, null, id % 13) as b", "id % 3 = 0 as f").write.parquet(f"{scratch}/t")
    rows = spark.read.parquet(f"{scratch}/t")
    got = sizes(rows, "n", {"a_n": "a", "b_n": "b", "again": "a"}, {"flagged": F.col("f")})
    want = rows.agg(F.count("*"), F.count_distinct("a"), F.count_distinct("b"), F.count_if("f")).first()
    row = got.first()
    assert (row["n"], row["a_n"], row["b_n"], row["flagged"]) == tuple(want) and row["again"] == row["a_n"]
    assert "Expand" not in plan(got)
    print(scans_of(got, "a#"), got._jdf.queryExecution().executedPlan().executedPlan().toString())
    assert len(scans_of(got, "a#")) == 1
    empty = sizes(rows.where("false"), "n", {"a_n": "a", "b_n": "b"}).first()
    assert tuple(empty) == (0, 0, 0)


def test_insights_read_the_latest_month_by_partition(spark, scratch):
    w = warehouse(spark, SF)
    orders = write_table_layout(w["fct_order"], f"{scratch}/orders", "fct_order")
    items = write_table_layout(w["fct_order_item"], f"{scratch}/items", "fct_order_item")
    for insight in (
        dashboards.service_area_insight(orders), dashboards.items_prices_insight(items), dashboards.promo_uptake_insight(items),
        dashboards.repeat_orders_insight(orders), dashboards.fees_insight(orders), dashboards.revenue_insight(orders),
        dashboards.courier_insight(orders),
    ):
        assert "order_date" in partition_filters(insight)
        assert insight.count() == 1


def test_contracts_of_a_table_are_one_scan(spark, scratch):
    spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (None, None), (None, "c")], "k long, v string").write.parquet(f"{scratch}/c")
    checks = [quality.Check("c", "k", "not_null"), quality.Check("c", "v", "not_null", "warn"), quality.Check("c", "k", "unique")]
    report = quality.contract_report({"c": spark.read.parquet(f"{scratch}/c")}, checks)
    assert plan(report).count("FileScan") == 1
    assert {(r.column_name, r.check_kind): (r.failing_rows, r.status) for r in report.collect()} == {
        ("k", "not_null"): (2, "fail"), ("v", "not_null"): (2, "warn"), ("k", "unique"): (1, "fail"),
    }


def test_the_control_board_reconciles_nothing_again(spark):
    w = warehouse(spark, SF)
    assert "total_basket_value" not in plan(w["aud_control_status"])
