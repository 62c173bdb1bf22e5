import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.operators.curation import curate_item_logs
from basketry.operators import upsert as upsert_module
from basketry.operators.upsert import RunLog, WatermarkStore, upsert, upsert_table
from basketry.plans import core
from basketry.streaming import curate_stream, curated_view
from basketry.streaming.curate import EVENT_DAY, DayIndex, known_rows, merge_batch
from tests.helpers import at, partition_filters, rows
from tests.test_history import LOGS, log
from verify.registry import warehouse

NOW = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def test_upsert_inserts_replaces_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    source = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    once = upsert(target, source, ["k"])
    assert rows(once, "k") == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(upsert(once, source, ["k"]), "k") == rows(once, "k")


def test_upsert_follows_source_columns(spark):
    target = spark.createDataFrame([(1, "a")], "k long, old string")
    source = spark.createDataFrame([(2, 5)], "k long, fresh long")
    assert rows(upsert(target, source, ["k"]), "k") == [(1, None), (2, 5)]


def test_partitioned_upsert_moves_rows_and_drops_emptied_partitions(spark, scratch):
    path = f"{scratch}/t"
    schema = "k long, v string, day date"
    d = lambda n: dt.date(2023, 1, n)
    upsert_table(spark, path, spark.createDataFrame([(1, "a", d(1)), (2, "b", d(2)), (3, "c", d(3))], schema), ["k"], "day")
    untouched = os.path.getmtime(f"{path}/day=2023-01-02")
    got = upsert_table(spark, path, spark.createDataFrame([(1, "A", d(3)), (4, "D", d(4))], schema), ["k"], "day")
    assert rows(got.select("k", "v", "day"), "k") == [(1, "A", d(3)), (2, "b", d(2)), (3, "c", d(3)), (4, "D", d(4))]
    assert not os.path.exists(f"{path}/day=2023-01-01")
    assert os.path.getmtime(f"{path}/day=2023-01-02") == untouched


def test_partitioned_upsert_keeps_rows_without_a_partition(spark, scratch):
    path, schema = f"{scratch}/n", "k long, v string, day date"
    d = dt.date(2023, 1, 1)
    upsert_table(spark, path, spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", d)], schema), ["k"], "day")
    got = upsert_table(spark, path, spark.createDataFrame([(4, "d", None)], schema), ["k"], "day")
    assert rows(got.select("k", "v", "day"), "k") == [(1, "a", None), (2, "b", None), (3, "c", d), (4, "d", None)]
    moved = [(1, "A", d), (2, "B", d), (4, "D", d), (3, "C", None)]
    got = upsert_table(spark, path, spark.createDataFrame(moved, schema), ["k"], "day")
    assert rows(got.select("k", "v", "day"), "k") == sorted(moved)
    back = [(3, "c", d)]
    got = upsert_table(spark, path, spark.createDataFrame(back, schema), ["k"], "day")
    assert rows(got.select("k", "v", "day"), "k") == [(1, "A", d), (2, "B", d), (3, "c", d), (4, "D", d)]
    assert not os.path.exists(f"{path}/day=__HIVE_DEFAULT_PARTITION__")


def test_a_replacement_that_stops_half_way_loses_nothing(spark, scratch):
    path = f"{scratch}/r"
    upsert_table(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), ["k"])
    # stopped while the new version was written, then between the two renames
    os.makedirs(f"{path}__next")
    fresh = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert rows(upsert_table(spark, path, fresh, ["k"]), "k") == [(1, "a"), (2, "B"), (3, "C")]
    os.rename(path, f"{path}__old")
    assert rows(upsert_table(spark, path, fresh, ["k"]), "k") == [(1, "a"), (2, "B"), (3, "C")]
    spark.createDataFrame([(9, "new")], "k long, v string").write.parquet(f"{path}__next")
    os.rename(path, f"{path}__old")
    assert rows(upsert_table(spark, path, fresh, ["k"]), "k") == [(2, "B"), (3, "C"), (9, "new")]
    assert not os.path.exists(f"{path}__old") and not os.path.exists(f"{path}__next")


def partitioned(spark, path):
    """A table of four dates and an upsert that fills one, empties one, changes one and leaves one."""
    d = lambda n: dt.date(2023, 1, n)
    schema = "k long, v string, day date"
    upsert_table(spark, path, spark.createDataFrame([(1, "a", d(1)), (2, "b", d(2)), (3, "c", d(3)), (5, "e", d(3)), (6, "f", d(6))], schema), ["k"], "day")
    fresh = spark.createDataFrame([(1, "A", d(4)), (3, "C", d(3))], schema)
    return fresh, [(1, "A", d(4)), (2, "b", d(2)), (3, "C", d(3)), (5, "e", d(3)), (6, "f", d(6))]


@pytest.mark.parametrize("moves", [0, 1, 2])
def test_a_partition_switch_that_stops_is_finished(spark, scratch, monkeypatch, moves):
    path = f"{scratch}/s"
    fresh, want = partitioned(spark, path)
    done, plain = [], upsert_module.move_partition

    def stopping(fs, staged, here):
        if len(done) == moves:
            fs.delete(here, True)  # after the delete, before the rename
            raise RuntimeError("stopped")
        done.append(here)
        plain(fs, staged, here)

    monkeypatch.setattr(upsert_module, "move_partition", stopping)
    if moves < 2:
        with pytest.raises(Exception, match="stopped"):
            upsert_table(spark, path, fresh, ["k"], "day")
    else:
        upsert_table(spark, path, fresh, ["k"], "day")
    monkeypatch.setattr(upsert_module, "move_partition", plain)
    # nothing is lost whether the run is repeated or the table only read
    assert upsert_module.table_exists(spark, path)
    assert rows(spark.read.parquet(path).select("k", "v", "day"), "k") == want
    assert rows(upsert_table(spark, path, fresh, ["k"], "day").select("k", "v", "day"), "k") == want
    assert sorted(os.listdir(scratch)) == ["s"] and not os.path.exists(f"{path}/day=2023-01-01")


def test_a_partition_switch_without_its_marker_is_undone(spark, scratch):
    path = f"{scratch}/u"
    fresh, want = partitioned(spark, path)
    before = rows(spark.read.parquet(path).select("k", "v", "day"), "k")
    upsert_module.stage_switch(spark, path, fresh, "day", [dt.date(2023, 1, 1)])
    os.remove(f"{path}__switch/_READY")
    assert upsert_module.table_exists(spark, path)
    assert rows(spark.read.parquet(path).select("k", "v", "day"), "k") == before
    assert rows(upsert_table(spark, path, fresh, ["k"], "day").select("k", "v", "day"), "k") == want


def test_an_upsert_reads_only_the_partitions_it_is_told(spark, scratch):
    path = f"{scratch}/p"
    fresh, want = partitioned(spark, path)
    stored = spark.read.parquet(path).where(upsert_module.in_partitions("day", [dt.date(2023, 1, 3), None]))
    assert "day" in partition_filters(stored)
    for name in os.listdir(f"{path}/day=2023-01-06"):
        if name.endswith(".parquet"):
            with open(f"{path}/day=2023-01-06/{name}", "wb") as f:
                f.write(b"not parquet")  # would fail if it were read
            crc = f"{path}/day=2023-01-06/.{name}.crc"
            if os.path.exists(crc):
                os.remove(crc)
    schema = spark.createDataFrame([], "k long, v string, day date").schema
    upsert_table(spark, path, fresh, ["k"], "day", stored_in=[dt.date(2023, 1, 1)])
    got = spark.read.schema(schema).parquet(path).where("day < date'2023-01-06'")
    assert rows(got.select("k", "v", "day"), "k") == want[:-1]


def test_watermarks(spark, scratch):
    cfg = Settings()
    store = WatermarkStore(spark, f"{scratch}/w", cfg)
    store.ensure()
    store.ensure()
    assert store.get("m") == cfg.watermark_floor and not store.known("m")
    df = spark.createDataFrame([(at("2023-05-01"),), (at("2023-06-01"),)], "ts timestamp")
    store.put("m", df, "ts", NOW)
    store.put("m", df.where("false"), "ts", NOW)
    assert store.get("m") == at("2023-06-01")
    assert store.cutoff("m") == at("2023-05-25")
    assert store.cutoff("m", lookback_days=31) == at("2023-05-01")
    off = WatermarkStore(spark, f"{scratch}/w", Settings(lookback_enabled=False))
    assert off.cutoff("m") == cfg.watermark_floor
    by_target = WatermarkStore(spark, f"{scratch}/w", Settings(watermarks_enabled=False))
    assert by_target.cutoff("m", df, "ts") == at("2023-05-25")


def test_run_log_keeps_creation_time(spark, scratch):
    runs = RunLog(spark, f"{scratch}/r")
    runs.ensure()
    runs.put("r1", "m", NOW, NOW)
    runs.put("r1", "m", NOW, NOW + dt.timedelta(hours=1))
    row = runs.table().collect()
    assert len(row) == 1 and (row[0].created_at, row[0].updated_at) == (NOW, NOW + dt.timedelta(hours=1))


@pytest.mark.parametrize("cut", ["1998-06-01", "2001-01-01"])
def test_refresh_equals_full_build(spark, cut):
    w = warehouse(spark, SF)
    rollups, full = w["int_order_rollups"], w["fct_order"]
    early = F.col("time_order_received_utc") < F.lit(cut).cast("timestamp")
    # rows known before the cut; later ones arrive with the refresh
    target = core.fct_order(rollups.where(early))
    fresh = core.refresh_fct_order(target, w["int_purchases"], w["int_promoted"], at(cut))
    assert fresh.exceptAll(full.select(*fresh.columns)).count() == 0 and fresh.count() == full.count()
    items = core.refresh_fct_order_item(core.fct_order_item(w["int_promoted"].where(early)), w["int_promoted"], at(cut))
    assert items.exceptAll(w["fct_order_item"]).count() == 0 and items.count() == w["fct_order_item"].count()
    customers = core.refresh_dim_customer(core.dim_customer(target), full, at(cut))
    assert customers.exceptAll(w["dim_customer"].select(*customers.columns)).count() == 0


def test_stream_equals_batch_when_a_rival_moves_later(spark, scratch):
    first = [log("1", "i", "2023-01-01", 5, src="2022-06-01"), log("2", "i", "2023-01-01", 6, src="2022-01-01"),
             log("3", "j", "2023-01-01", None)]
    # log 1 moves away, so log 2 gets its slot back; log 3 gets a price
    second = [log("1", "i", "2023-02-01", 5), log("3", "j", "2022-12-01", 4), log("4", "k", "2023-01-01", -1)]
    feed, state, check = f"{scratch}/feed", f"{scratch}/state", f"{scratch}/check"
    for part in (first, second, second):
        spark.createDataFrame(part, LOGS).coalesce(1).write.mode("append").parquet(feed)
        curate_stream(spark.readStream.schema(spark.createDataFrame([], LOGS).schema).parquet(feed), state, check).awaitTermination()
        seen = first + (second if part is second else [])
        batch = curate_item_logs(spark.createDataFrame(seen, LOGS))
        columns = ["log_item_id", "time_log_created_utc", "product_base_price_gross_eur"]
        assert rows(curated_view(spark, state).select(*columns), "log_item_id") == rows(batch.select(*columns), "log_item_id")


def test_a_batch_reads_only_the_days_it_names(spark, scratch):
    state = f"{scratch}/state"
    merge_batch(spark, spark.createDataFrame([log(str(k), "i", f"2023-01-{k:02d}", 5) for k in range(1, 21)], LOGS), state)
    index = DayIndex(spark, state)
    ids = spark.createDataFrame([("3",), ("unknown",)], "log_item_id string")
    assert index.days_of(ids) == [dt.date(2023, 1, 3)]
    known = known_rows(spark.read.parquet(state), index.days_of(ids), ids)
    assert EVENT_DAY in partition_filters(known) and known.count() == 1
    # days that are not named may not even be readable
    for day in ("2023-01-07", "2023-01-15"):
        for name in os.listdir(f"{state}/{EVENT_DAY}={day}"):
            if name.endswith(".parquet"):
                os.replace(f"{state}/{EVENT_DAY}={day}/{name}", f"{scratch}/{day}-{name}")
    merge_batch(spark, spark.createDataFrame([log("3", "i", "2023-01-09", 6), log("99", "j", "2023-01-10", 1)], LOGS), state, journal=f"{scratch}/journal")
    got = spark.read.parquet(state)
    assert {(r.log_item_id, str(r[EVENT_DAY])) for r in got.where("log_item_id in ('3', '99', '9')").collect()} == {("3", "2023-01-09"), ("99", "2023-01-10"), ("9", "2023-01-09")}
    assert rows(spark.read.parquet(f"{scratch}/journal"), "item_key") == [("i",), ("j",)]
    before = os.path.getmtime(f"{state}/{EVENT_DAY}=2023-01-10")
    merge_batch(spark, spark.createDataFrame([log("99", "j", "2023-01-10", 1)], LOGS), state, journal=f"{scratch}/journal")
    assert os.path.getmtime(f"{state}/{EVENT_DAY}=2023-01-10") == before


def test_index_is_folded_and_may_name_old_days(spark, scratch, monkeypatch):
    from basketry.streaming import curate

    monkeypatch.setattr(curate, "INDEX_FILES", 1)
    state = f"{scratch}/state"
    for day in (1, 2, 3):
        merge_batch(spark, spark.createDataFrame([log("a", "i", f"2023-01-0{day}", 5), log("b", "j", "2023-02-01", 5)], LOGS), state)
    index = DayIndex(spark, state)
    assert sorted(index.days_of(spark.createDataFrame([("a",)], "log_item_id string"))) == [dt.date(2023, 1, d) for d in (1, 2, 3)]
    assert rows(spark.read.parquet(state).select("log_item_id", EVENT_DAY), "log_item_id") == [("a", dt.date(2023, 1, 3)), ("b", dt.date(2023, 2, 1))]
    assert spark.read.parquet(index.path).count() == 4


def test_incremental_runs_equal_full_refresh(spark, scratch):
    from basketry.plans.incremental import CoreTables
    from basketry.functions import parse_event_time

    w = warehouse(spark, SF)
    cut = F.lit("1999-03-01").cast("timestamp")
    feeds = {n: w[n] for n in ("raw_item_logs", "raw_promos", "raw_purchases", "raw_baskets")}
    early = {
        **feeds,
        # some old logs and promotions come late, and some baskets are corrected by the second run
        "raw_item_logs": w["raw_item_logs"].where((parse_event_time("time_log_created_utc") < cut) & (F.crc32(F.col("log_item_id").cast("string").cast("binary")) % 3 != 0)),
        "raw_promos": w["raw_promos"].where(F.crc32(F.concat_ws("|", *w["raw_promos"].columns).cast("binary")) % 3 != 0),
        "raw_purchases": w["raw_purchases"].where(parse_event_time("time_order_received_utc") < cut),
    }
    tables = CoreTables(spark, f"{scratch}/core", grain="month")
    tables.run(early, "r1", NOW)
    tables.run(feeds, "r2", NOW)
    for name in ("fct_order", "dim_customer", "dim_item_current", "dim_promo", "rpt_category_monthly", "rpt_customer_promo"):
        got, want = tables.table(name), w[name]
        assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0, name
    lines = tables.fct_order_item()
    assert lines.count() == w["fct_order_item"].count() and lines.exceptAll(w["fct_order_item"].select(*lines.columns)).count() == 0
    assert tables.watermarks.get("fct_order") == w["fct_order"].agg(F.max("order_ts_utc")).first()[0]
    assert tables.runs.table().where("run_id = 'r2'").count() == 9
    tables.run(early, "r3", NOW, full_refresh=True)
    assert tables.table("fct_order").count() == w["fct_order"].where(F.col("order_ts_utc") < cut).count()
