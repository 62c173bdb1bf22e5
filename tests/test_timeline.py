"""The split window functions must equal the plain ones, whatever the skew."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.operators.timeline import BUCKET, as_of, busy_spots, split_neighbours, split_row_number
from tests.helpers import rows, timeline

SCHEMA = "key string, ts timestamp, id string, value string"


@pytest.mark.parametrize("seed,unit", [(1, "hour"), (2, "day"), (3, "month"), (4, "year")])
def test_row_number_equals_plain_window(spark, seed, unit):
    df = spark.createDataFrame(timeline(seed), SCHEMA)
    plain = df.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("ts", "id")).cast("long"))
    split = split_row_number(df, ["key"], "ts", ["id"], "n", unit)
    assert rows(split.select("id", "n"), "id") == rows(plain.select("id", "n"), "id")


@pytest.mark.parametrize("seed,unit", [(5, "hour"), (6, "day"), (7, "year")])
def test_lag_and_lead_equal_plain_window(spark, seed, unit):
    df = spark.createDataFrame(timeline(seed), SCHEMA)
    w = W.partitionBy("key").orderBy("ts", "id")
    plain = df.select("id", F.lag("value").over(w), F.lead("ts").over(w), F.lead("value").over(w))
    split = split_neighbours(
        df, ["key"], "ts", ["id"], lags={"before": "value"}, leads={"next_ts": "ts", "after": "value"}, unit=unit
    ).select("id", "before", "next_ts", "after")
    assert rows(split, "id") == rows(plain, "id")


@pytest.mark.parametrize("seed", [8, 9, 10])
def test_as_of_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    facts = [(k, ts, i) for k, ts, i, _ in timeline(seed, 300)] + [(None, timeline(seed, 1)[0][1], "nokey")]
    versions = [(k, ts, i) for k, ts, i, _ in timeline(seed + 100, 80)]
    rnd.shuffle(versions)
    f = spark.createDataFrame(facts, "key string, ts timestamp, fid string")
    v = spark.createDataFrame(versions, "key string, vfrom timestamp, vid string")
    got = as_of(f, v, "key", "ts", "vfrom", [F.col("vid")], ["vid"]).select("fid", "__version.vid")
    expected = []
    for key, ts, fid in facts:
        earlier = [(vts, vid) for vkey, vts, vid in versions if vkey == key and vts <= ts]
        expected.append((fid, max(earlier)[1] if earlier else None))
    assert rows(got, "fid") == sorted(expected)


def burst(spark):
    """A third of all rows belong to one key and one hour; other keys have rows in that hour, too."""
    hour = dt.datetime(2023, 5, 1, 12)
    rows_ = timeline(11, 400) + [("hot", hour + dt.timedelta(seconds=7 * (k // 2)), f"x{k:04d}", "abc"[k % 3]) for k in range(400)]
    rows_ += [(f"k{k % 3}", hour + dt.timedelta(minutes=k), f"y{k}", "a") for k in range(20)]
    return spark.createDataFrame(rows_, SCHEMA)


def test_a_hot_hour_of_a_key_is_cut_into_seconds(spark):
    df = burst(spark)
    assert busy_spots(df, ["key"], "ts", "hour", 1000) is None
    busy = busy_spots(df, ["key"], "ts", "hour", 50)
    assert rows(busy.select("key", BUCKET)) == [("hot", dt.datetime(2023, 5, 1, 12))]
    w = W.partitionBy("key").orderBy("ts", "id")
    plain = df.select("id", F.row_number().over(w).cast("long"), F.lag("value").over(w), F.lead("ts").over(w))
    split = split_neighbours(df, ["key"], "ts", ["id"], lags={"before": "value"}, leads={"after": "ts"}, number="n", busy=busy)
    assert rows(split.select("id", "n", "before", "after"), "id") == rows(plain, "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = split_row_number(df, ["key"], "ts", ["id"], "n", "hour", busy)
        assert rows(numbered.select("id", "n"), "id") == rows(plain.select(plain[0], plain[1]), "id")
        tasks = numbered.where("key = 'hot' and ts >= timestamp'2023-05-01 12:00:00'").select(F.spark_partition_id().alias("p")).distinct()
        assert tasks.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_as_of_in_a_hot_hour(spark):
    f = burst(spark).select("key", "ts", F.col("id").alias("fid"))
    at = dt.datetime(2023, 5, 1, 11, 59)
    versions = [(k, at + dt.timedelta(seconds=s), f"{k}{s}") for k in ("hot", "k0", "k1") for s in (0, 61, 300, 301, 2000, 4000)]
    v = spark.createDataFrame(versions, "owner string, vfrom timestamp, vid string")
    got = as_of(f, v, "key", "ts", "vfrom", [F.col("vid")], ["vid"], version_key="owner", busy=busy_spots(f, ["key"], "ts", "hour", 50))
    expected = []
    for key, ts, fid in f.collect():
        earlier = [(vts, vid) for vkey, vts, vid in versions if vkey == key and vts <= ts]
        expected.append((fid, max(earlier)[1] if earlier else None))
    assert rows(got.select("fid", "__version.vid"), "fid") == sorted(expected)
