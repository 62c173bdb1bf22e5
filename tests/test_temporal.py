import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.operators import temporal
from basketry.plans.core import with_promo_key
from tests.helpers import at, plan, rows

HISTORY = (
    "item_key string, item_key_sk string, item_scd_sk string, log_item_id string, valid_from_utc timestamp, "
    "valid_to_utc timestamp, product_base_price_gross_eur decimal(18,4)"
)
ATTRS = ("item_scd_sk", "valid_from_utc")
PROMO = "item_key string, promo_start_date date, promo_end_date date, promo_type string, discount_pct long"


@pytest.mark.parametrize("strategy", ["broadcast", "asof", "auto"])
def test_version_boundaries(spark, strategy):
    h = spark.createDataFrame(
        [
            ("i", "k", "v1", "1", at("2023-01-01"), at("2023-02-01"), None),
            ("i", "k", "zero", "2", at("2023-02-01"), at("2023-02-01"), None),
            ("i", "k", "v2", "3", at("2023-02-01"), at("2023-03-01"), None),
        ],
        HISTORY,
    )
    facts = spark.createDataFrame(
        [("a", "i", at("2022-12-31 23:59:59")), ("b", "i", at("2023-01-01")), ("c", "i", at("2023-02-01")),
         ("d", "i", at("2023-02-28 23:00:00")), ("e", "i", at("2023-03-01")), ("f", "other", at("2023-02-01")),
         ("g", None, at("2023-02-01"))],
        "id string, item_key string, time_order_received_utc timestamp",
    )
    got = temporal.time_valid_join(facts, h, attributes=ATTRS, strategy=strategy)
    assert [(r[0], r[1]) for r in rows(got.select("id", "item_scd_sk"), "id")] == [
        ("a", None), ("b", "v1"), ("c", "v2"), ("d", "v2"), ("e", None), ("f", None), ("g", None)
    ]


@pytest.mark.parametrize("strategy", ["broadcast", "asof", "auto"])
def test_overlapping_nested_and_empty_versions(spark, strategy):
    rnd = random.Random(9)
    base = at("2023-01-01")
    data = []
    for k in range(60):
        s = base + dt.timedelta(hours=rnd.randrange(0, 400, 8))
        data.append((rnd.choice(["hot", "hot", "b"]), "k", f"v{k:02d}", str(rnd.randrange(5)), s, s + dt.timedelta(hours=rnd.choice([0, 1, 8, 50, 300])), None))
    data += [("c", "k", "outer", "1", at("2023-01-01"), at("2023-12-31"), None), ("c", "k", "inner", "2", at("2023-02-01"), at("2023-03-01"), None)]
    facts = [(f"{k:03d}", rnd.choice(["hot", "b"]), base + dt.timedelta(hours=rnd.randrange(-5, 800))) for k in range(200)]
    facts += [("x1", "c", at("2023-02-10")), ("x2", "c", at("2023-05-01")), ("x3", None, at("2023-05-01"))]
    got = temporal.time_valid_join(
        spark.createDataFrame(facts, "id string, item_key string, time_order_received_utc timestamp"),
        spark.createDataFrame(data, HISTORY), attributes=ATTRS, strategy=strategy,
    )
    expected = []
    for i, item, t in facts:
        hits = [(v[4], v[5], v[3], v[2]) for v in data if v[0] == item and v[4] <= t < v[5]]
        expected.append((i, max(hits)[3] if hits else None))
    assert [(r[0], r[1]) for r in rows(got.select("id", "item_scd_sk"), "id")] == sorted(expected)


def test_a_broadcast_is_checked_by_bytes(spark):
    h = spark.createDataFrame([("i", "k", "v1", "1", at("2023-01-01"), at("2024-01-01"), None)], HISTORY)
    assert not temporal.small_history(h, "item_key", Settings(broadcast_bytes=10))


def test_auto_uses_merge_when_history_is_large(spark):
    h = spark.createDataFrame([("i", "k", "v1", "1", at("2023-01-01"), at("2024-01-01"), None)], HISTORY)
    assert temporal.small_history(h, "item_key", Settings())
    assert not temporal.small_history(h, "item_key", Settings(broadcast_rows=0))
    assert not temporal.small_history(h, "item_key", Settings(broadcast_rows_per_key=0))


def test_promo_start_is_inclusive_and_end_exclusive(spark):
    promos = with_promo_key(
        spark.createDataFrame(
            [("i", dt.date(2023, 5, 8), dt.date(2023, 5, 14), "discount", 10),
             ("i", dt.date(2023, 5, 10), dt.date(2023, 5, 11), "bundle", 30),
             ("i", None, dt.date(2023, 5, 14), "discount", 99),
             ("j", dt.date(2023, 5, 8), dt.date(9999, 12, 31), "discount", None)],
            PROMO,
        )
    )
    facts = spark.createDataFrame(
        [(f"{d:02d}{k}", k, dt.date(2023, 5, d)) for d in (7, 8, 9, 10, 11, 13, 14) for k in "ij"],
        "id string, item_key string, order_date_berlin date",
    )
    for strategy in ("broadcast", "asof"):
        got = {r[0]: (r[1], r[2]) for r in rows(temporal.apply_promos(facts, promos, strategy=strategy).select("id", "discount_pct", "promo_type"))}
        assert [got[f"{d:02d}i"][0] for d in (7, 8, 9, 10, 11, 13, 14)] == [None, 10, 10, 30, 10, 10, None]
        assert got["07j"] == (None, None) and got["14j"] == (None, "discount")


@pytest.mark.parametrize("seed,strategy", [(1, "broadcast"), (2, "asof"), (3, "asof")])
def test_best_promo_equals_brute_force(spark, seed, strategy):
    rnd = random.Random(seed)
    day = lambda n: dt.date(2023, 1, 1) + dt.timedelta(days=n)
    data = []
    for _ in range(60):
        s = rnd.randrange(120)
        data.append((rnd.choice(["hot", "hot", "b"]), day(s), day(s + rnd.randrange(-2, 90)), rnd.choice("xy"), rnd.randrange(1, 50)))
    promos = with_promo_key(spark.createDataFrame(data, PROMO))
    keyed = promos.collect()
    facts = [(str(i), rnd.choice(["hot", "b", "c"]), day(rnd.randrange(220))) for i in range(300)]
    df = spark.createDataFrame(facts, "id string, item_key string, order_date_berlin date")
    got = rows(temporal.apply_promos(df, promos, strategy=strategy).select("id", "promo_sk"), "id")
    expected = []
    for i, item, d in facts:
        hits = [(p.discount_pct, p.promo_start_date, p.promo_sk) for p in keyed
                if p.item_key == item and p.promo_start_date <= d < p.promo_end_date]
        expected.append((i, max(hits)[2] if hits else None))
    assert got == sorted(expected)


@pytest.mark.parametrize("seed", [4, 5])
def test_overlaps_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    day = lambda n: dt.date(2023, 1, 1) + dt.timedelta(days=n)
    data = []
    for _ in range(50):
        s = rnd.randrange(0, 200, 5)
        data.append((rnd.choice("ab"), day(s), day(s + rnd.choice([0, 3, 40, 100])), rnd.choice("xy"), rnd.choice([5, 10])))
    data += data[:3]
    got = temporal.overlapping_windows(
        spark.createDataFrame(data, PROMO), "item_key", "promo_start_date", "promo_end_date", ["promo_type", "discount_pct"]
    )
    valid = [r for r in data if r[1] < r[2]]
    expected = {}
    for k, a in enumerate(valid):
        met = sum(1 for j, b in enumerate(valid) if j != k and a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
        if met:
            expected[a] = (valid.count(a), met)
    assert {tuple(r)[:5]: tuple(r)[5:] for r in got.collect()} == expected


def test_many_equal_windows_stay_one_row(spark):
    row = ("a", dt.date(2023, 1, 1), dt.date(2023, 2, 1), "x", 5)
    df = spark.range(100_000).selectExpr("'a' as item_key", "date'2023-01-01' as promo_start_date", "date'2023-02-01' as promo_end_date", "'x' as promo_type", "5L as discount_pct")
    got = temporal.overlapping_windows(df, "item_key", "promo_start_date", "promo_end_date", ["promo_type", "discount_pct"])
    assert [tuple(r) for r in got.collect()] == [(*row, 100_000, 99_999)]


def test_a_hot_item_and_day_is_dealt_to_several_tasks(spark):
    cfg = Settings(rows_per_task=50)
    segments = spark.createDataFrame(
        [("hot", dt.date(2023, 5, 1), dt.date(2023, 6, 1), "p", "x", 10), ("b", dt.date(2023, 5, 1), dt.date(2023, 5, 2), "q", "y", 20)],
        "item_key string, segment_from date, segment_to date, promo_sk string, promo_type string, discount_pct long",
    )
    facts = spark.range(1200).selectExpr(
        "cast(id as string) as id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'b' end as item_key",
        "case when id % 3 = 0 then date'2023-05-10' else date_add(date'2023-05-01', cast(id % 40 as int)) end as order_date_berlin",
    ).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = temporal.apply_promo_segments(facts, segments, cfg=cfg, strategy="asof")
        tasks = got.where("item_key = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1
        broadcast = temporal.apply_promo_segments(facts, segments, cfg=cfg)
        assert "BroadcastNestedLoopJoin" not in plan(got) and "CartesianProduct" not in plan(got)
        assert rows(got, "id") == rows(broadcast, "id") and got.count() == 1200
        assert got.where("promo_sk = 'p'").count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_history_known_to_be_disjoint_is_not_checked(spark):
    h = spark.createDataFrame([("i", "k", "v1", "1", at("2023-01-01"), at("2024-01-01"), None)], HISTORY)
    facts = spark.createDataFrame([("a", "i", at("2023-02-01"))], "id string, item_key string, time_order_received_utc timestamp")
    for strategy in ("asof", "counted"):
        got = temporal.time_valid_join(facts, h, attributes=ATTRS, strategy=strategy, disjoint=True)
        assert [r["item_scd_sk"] for r in got.collect()] == ["v1"]
