"""Continuous curation of the item-log feed.

The kept state is the best row per log id over everything seen so far, partitioned by event day. Conflicts between log ids at one
item and time, and the price guard, are applied when the state is read: a log that lost a conflict earlier
can win it later when its rival moves, so the result always equals one batch over all input.

An index beside the state names the days a log id has been stored under. A batch looks its ids up there and reads and
rewrites the days it finds and its own, nothing else. The index is only appended to, before the state is written, so it may name a
day that no longer holds the log but never misses one; a run that stops in between can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.operators.curation import (
    PRICE,
    best_per_log,
    drop_null_event_time,
    require_positive,
    resolve_conflicts,
)
from basketry.operators.upsert import drop_table, in_partitions, replace_table, table_exists, upsert_table
from basketry.session import materialize

EVENT_DAY = "event_day"
BUCKET, BUCKETS = "id_bucket", 16
# the index is rewritten without repeats when it has more files than this
INDEX_FILES = 2000


def event_day(grain: str) -> Column:
    """Partition of a log: its event day, or the first day of the event month with grain "month"."""
    day = F.col("time_log_created_utc").cast("date")
    return F.trunc(day, "month") if grain == "month" else day


def with_bucket(ids: DataFrame) -> DataFrame:
    return ids.withColumn(BUCKET, F.pmod(F.xxhash64("log_item_id"), F.lit(BUCKETS)).cast("int"))


class DayIndex:
    """Days by log id, in buckets of the id: an append-only table."""

    def __init__(self, spark: SparkSession, state_path: str):
        self.spark, self.path = spark, f"{state_path}__index"

    def days_of(self, ids: DataFrame) -> list:
        """Days that may hold any of the ids; an entry per day at most."""
        if not table_exists(self.spark, self.path):
            return []
        wanted = with_bucket(ids)
        buckets = [r[0] for r in wanted.select(BUCKET).distinct().collect()]
        index = self.spark.read.parquet(self.path).where(in_partitions(BUCKET, buckets))
        found = index.join(wanted, ["log_item_id", BUCKET], "left_semi").select(EVENT_DAY).distinct()
        return [r[0] for r in found.collect()]

    def add(self, rows: DataFrame) -> None:
        """Append the days of the rows, and fold the table when it has become many files."""
        entries = with_bucket(rows.select("log_item_id", EVENT_DAY))
        entries.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(self.path)
        index = self.spark.read.parquet(self.path)
        if len(index.inputFiles()) > INDEX_FILES:
            replace_table(self.spark, self.path, index.distinct(), BUCKET)


def known_rows(state: DataFrame, days: list, ids: DataFrame) -> DataFrame:
    """Rows of the state under these days that carry one of the ids."""
    return state.where(in_partitions(EVENT_DAY, days)).join(ids, "log_item_id", "left_semi")


def merge_batch(spark: SparkSession, batch: DataFrame, state_path: str, grain: str = "day", journal: str | None = None) -> None:
    """Fold one batch of staged item logs into the state; repeating a batch changes nothing.

    With a `journal` the items (`item_key`) of which a row is added, replaced or moved away are appended to that table before
    the state is written, so a reader that keeps up with the state misses none, wherever a run stops.
    """

    def note(items: DataFrame) -> None:
        if journal:
            items.distinct().write.mode("append").parquet(journal)

    index = DayIndex(spark, state_path)
    # the batch is parsed once and read several times
    fresh = materialize(best_per_log(drop_null_event_time(batch, "time_log_created_utc")), "batch")
    if not table_exists(spark, state_path):
        drop_table(spark, index.path)
        dated = fresh.withColumn(EVENT_DAY, event_day(grain))
        index.add(dated)
        note(fresh.select("item_key"))
        upsert_table(spark, state_path, dated, ["log_item_id"], partition=EVENT_DAY)
        return
    columns = fresh.columns
    ids = fresh.select("log_item_id")
    known = known_rows(spark.read.parquet(state_path), index.days_of(ids), ids).select(*columns)
    before = known.select("log_item_id", F.struct(*columns).alias("before"))
    best = best_per_log(fresh.unionByName(known)).select("log_item_id", F.struct(*columns).alias("now"))
    compared = best.join(before, "log_item_id", "left").where(~F.col("now").eqNullSafe(F.col("before")))
    changed = materialize(compared, "changed-logs")
    dated = changed.select("now.*").withColumn(EVENT_DAY, event_day(grain))
    old = changed.where("before is not null").select("before.*").withColumn(EVENT_DAY, event_day(grain))
    index.add(dated)
    note(dated.select("item_key").unionByName(old.select("item_key")))
    stored_in = [r[0] for r in old.select(EVENT_DAY).distinct().collect()]
    upsert_table(spark, state_path, dated, ["log_item_id"], partition=EVENT_DAY, stored_in=stored_in)


def curated_rows(state: DataFrame) -> DataFrame:
    """The trusted stream out of rows of the state; all rows of an item must be there."""
    return require_positive(resolve_conflicts(state), PRICE)


def curated_view(spark: SparkSession, state_path: str) -> DataFrame:
    return curated_rows(spark.read.parquet(state_path).drop(EVENT_DAY))


def curate_stream(staged: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Start a run over everything that has arrived; it stops when the feed is drained."""

    def fold(batch: DataFrame, _: int) -> None:
        merge_batch(batch.sparkSession, batch, state_path)

    return (
        staged.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
