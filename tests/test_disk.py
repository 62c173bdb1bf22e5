"""What statements leave on disk, and how wide the rows are that move or are stored."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.functions import pack_key, unpack_key
from basketry.operators import temporal
from basketry.operators.ranking import measure_rollup
from basketry.operators.timeline import as_of, busy_spots, hot_keys
from basketry.plans import core, reporting
from basketry.plans.build import RAW, Warehouse
from basketry.session import materialize
from tests.helpers import at, plan, rows, timeline
from verify import fixtures

SF = "/root/testdata/sf0.001"


def files_kept(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_shuffle_files_go_when_their_statement_ends(spark):
    import time

    held = materialize(spark.range(1000).repartition(3, "id"), "first")
    time.sleep(1)
    before = files_kept(spark)
    frames = [materialize(held.repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "second") for _ in range(4)]
    again = held.groupBy((F.col("id") % 7).alias("k")).count()
    assert [rows(again, "k"), rows(again, "k")] == [rows(f, "k") for f in frames[:2]]
    # a frame that runs again after its files are gone shuffles again
    assert len(again.collect()) == len(again.collect()) == 7
    for _ in range(20):
        if files_kept(spark) <= before:
            break
        time.sleep(0.5)
    assert files_kept(spark) <= before


def facts_and_versions(spark, seed):
    rnd = random.Random(seed)
    facts = [(k, ts, i) for k, ts, i, _ in timeline(seed, 300)] + [(None, at("2023-01-02"), f"n{k}") for k in range(60)]
    versions = [(k, ts, i) for k, ts, i, _ in timeline(seed + 100, 80)]
    rnd.shuffle(versions)
    expected = []
    for key, ts, fid in facts:
        earlier = [(vts, vid) for vkey, vts, vid in versions if vkey == key and vts <= ts]
        expected.append((fid, max(earlier)[1] if earlier else None))
    f = spark.createDataFrame(facts, "key string, ts timestamp, fid string")
    return f, spark.createDataFrame(versions, "owner string, vfrom timestamp, vid string"), sorted(expected)


@pytest.mark.parametrize("seed", [21, 22])
def test_as_of_with_no_some_and_all_keys_cut(spark, seed):
    f, v, expected = facts_and_versions(spark, seed)
    some = hot_keys(f, ["key"], 50)
    assert {r[0] for r in some.collect()} == {"hot", None} and hot_keys(f, ["key"], 1000) is None
    for hot in (None, some, "all"):
        for busy in (None, busy_spots(f, ["key"], "ts", "hour", 3)):
            got = as_of(f, v, "key", "ts", "vfrom", [F.col("vid")], ["vid"], version_key="owner", busy=busy, hot=hot)
            assert rows(got.select("fid", "__version.vid"), "fid") == expected


@pytest.mark.parametrize("limit", [20, 1_000_000])
def test_promotions_of_hot_and_other_items(spark, limit):
    day = dt.date(2023, 1, 1)
    rnd = random.Random(5)
    segments, windows = [], {}
    for key in ("hot", "a", "b"):
        for k in range(8):
            start = day + dt.timedelta(days=30 * k)
            windows.setdefault(key, []).append((start, start + dt.timedelta(days=rnd.choice([3, 20, 30])), f"{key}{k}"))
        segments += [(key, s, e, p, "x", 10) for s, e, p in windows[key]]
    facts = [(str(k), rnd.choice(["hot", "hot", "hot", "a", "b", "none", None]), day + dt.timedelta(days=rnd.randrange(260))) for k in range(120)]
    got = temporal.apply_promo_segments(
        spark.createDataFrame(facts, "id string, item_key string, order_date_berlin date"),
        spark.createDataFrame(segments, "item_key string, segment_from date, segment_to date, promo_sk string, promo_type string, discount_pct long"),
        cfg=Settings(rows_per_task=limit), strategy="asof",
    )
    expected = [(i, key, d, next((p for s, e, p in windows.get(key, []) if s <= d < e), None)) for i, key, d in facts]
    assert rows(got.select("id", "item_key", "order_date_berlin", "promo_sk"), "id") == sorted(expected)


def test_a_lookup_by_merge_moves_the_facts_once(spark):
    f, v, _ = facts_and_versions(spark, 23)
    windows = v.select("owner", "vfrom", F.lit("2024-01-01").cast("timestamp").alias("vto"), "vid").withColumnRenamed("owner", "key")
    got = temporal.interval_lookup(f, windows, "key", "ts", "vfrom", "vto", ["vid"], strategy="asof")
    assert plan(got).count("Exchange hashpartitioning") == 1
    days, periods = f.withColumn("day", F.col("ts").cast("date")), windows.selectExpr("key", "date(vfrom) a", "date(vto) b", "vid")
    assert plan(temporal.day_lookup(days, periods, "key", "day", "a", "b", ["vid"])).count("Exchange hashpartitioning") == 1


def test_stored_order_items_hold_no_column_that_others_give(spark):
    w = Warehouse({n: getattr(fixtures, n)(spark, SF) for n in RAW})
    got = w["int_promoted"]
    want = core.order_items_with_promo(w["int_priced"], w["int_promo_segments"])
    assert got.schema == want.schema
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    scan = plan(got.select("*")).split("ReadSchema:")[1]
    for column in ("order_item_sk", "order_sk", "customer_sk", "item_key_sk", "item_scd_sk", "order_item_row"):
        assert column not in scan


def test_packed_keys_are_short_and_come_back(spark):
    hexed = "0123456789abcdef" * 2
    texts = [hexed, hexed.upper(), hexed + "\n", hexed[:31], hexed[:16], hexed[:15], "", "\0" * 15, "\0" * 16, "\0" * 17, "ä" * 8, "_dbt_null_", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pack_key("t").alias("p"))
    got = df.select("t", "p", unpack_key("p").alias("back")).collect()
    assert [r["back"] for r in got] == texts and len({bytes(r["p"]) for r in got if r["p"] is not None}) == len(texts) - 1
    assert len(got[0]["p"]) == 16


def test_orders_and_customers_are_counted_by_packed_keys(spark):
    w = Warehouse({n: getattr(fixtures, n)(spark, SF) for n in RAW})
    kept = reporting.order_category_rows(w["fct_order_item"], w["fct_order"])
    assert dict(kept.dtypes)["order_sk"] == dict(kept.dtypes)["customer_sk"] == "binary"
    whole = reporting.order_categories(w["fct_order_item"], w["fct_order"])
    assert w["int_order_categories"].schema == whole.schema and dict(whole.dtypes)["order_sk"] == "string"
    assert whole.exceptAll(w["int_order_categories"]).count() == 0
    want = w["fct_order_item"].select("order_sk", "customer_sk").distinct()
    assert whole.select("order_sk", "customer_sk").distinct().exceptAll(want).count() == 0
    assert "unhex" in plan(measure_rollup(w["fct_order_item"], ["item_category"], {}))
