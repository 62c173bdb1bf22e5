import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketry.operators import curation, history
from basketry.plans import quality
from tests.helpers import at

LOGS = (
    "log_item_id string, item_key string, time_log_created_utc timestamp, item_name_en string, item_name_de string, "
    "item_name_preferred string, brand_name string, item_category string, number_of_units long, weight_in_grams long, "
    "product_base_price_gross_eur decimal(18,4), vat_rate_pct decimal(18,4), "
    "time_item_created_in_source_utc timestamp, payload_raw string"
)


def log(log_id, item, ts, price, src=None, raw="", category="c"):
    money = None if price is None else Decimal(str(price))
    return (log_id, item, at(ts) if ts else None, None, None, None, None, category, None, None, money, None,
            at(src) if src else None, raw)


def test_dedupe_prefers_positive_price_then_time_then_payload(spark):
    df = spark.createDataFrame(
        [
            log("1", "i", "2023-01-03", None), log("1", "i", "2023-01-01", 5), log("1", "i", "2023-01-02", -1),
            log("2", "i", "2023-01-01", 1, raw="a"), log("2", "i", "2023-01-01", 2, raw="b"),
            log("3", "i", "2023-01-01", -3), log("3", "i", "2023-01-02", None),
        ],
        LOGS,
    )
    got = {r.log_item_id: (r.time_log_created_utc, r.product_base_price_gross_eur) for r in curation.best_per_log(df).collect()}
    assert got == {"1": (at("2023-01-01"), 5), "2": (at("2023-01-01"), 2), "3": (at("2023-01-02"), None)}


def test_conflict_resolution_and_price_guard(spark):
    df = spark.createDataFrame(
        [
            log("1", "i", "2023-01-01", 5, src="2022-01-01"), log("2", "i", "2023-01-01", 6, src="2022-06-01"),
            log("3", "i", "2023-01-01", 7), log("4", "j", "2023-01-01", 8), log("5", "j", "2023-01-01", 9),
            log("6", "k", "2023-01-01", 0), log("7", "k", None, 3),
        ],
        LOGS,
    )
    assert sorted(r.log_item_id for r in curation.curate_item_logs(df).collect()) == ["2", "5"]


def test_no_op_versions_collapse_and_windows_tile(spark):
    df = spark.createDataFrame(
        [log("1", "i", "2023-01-01", 5), log("2", "i", "2023-02-01", 5), log("3", "i", "2023-03-01", 6),
         log("4", "i", "2023-04-01", 5), log("5", "j", "2023-01-05", 1)],
        LOGS,
    )
    versions = history.item_scd2(df).orderBy("item_key", "valid_from_utc").collect()
    assert [r.log_item_id for r in versions] == ["1", "3", "4", "5"]
    assert [r.valid_to_utc for r in versions[:2]] == [at("2023-03-01"), at("2023-04-01")]
    assert [r.is_current for r in versions] == [False, False, True, True]
    assert versions[-1].valid_to_utc == dt.datetime(9999, 12, 31, 23, 59, 59)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_histories_tile_without_repeats(spark, seed):
    rnd = random.Random(seed)
    data = [
        log(str(i), rnd.choice(["hot", "hot", "a", "b"]), f"2023-01-{rnd.randrange(1, 29):02d} {rnd.randrange(24):02d}:00:00",
            rnd.choice([1, 2, 3]))
        for i in range(300)
    ]
    curated = curation.curate_item_logs(spark.createDataFrame(data, LOGS))
    versions = history.item_scd2(curated).cache()
    assert quality.overlapping_versions(versions).count() == 0
    assert quality.repeated_states(versions).count() == 0
    by_item = versions.groupBy("item_key").agg(F.count_if("is_current").alias("n")).collect()
    assert all(r.n == 1 for r in by_item)
    # windows meet end to end
    rows = versions.orderBy("item_key", "valid_from_utc", "log_item_id").collect()
    for a, b in zip(rows, rows[1:]):
        if a.item_key == b.item_key:
            assert a.valid_to_utc == b.valid_from_utc
