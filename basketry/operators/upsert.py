"""Upserts into Parquet tables, watermarks and the run log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.session import scratch_path


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], sync_columns: bool = True, gone: DataFrame | None = None
) -> DataFrame:
    """`target` with the rows of `source` inserted or replacing rows of equal key, and without the keys in `gone`.

    With `sync_columns` the result has the columns of the source: new ones are added (null in rows that are
    kept), vanished ones are removed. Source keys must be unique and not null.
    """
    named = source.select(*keys) if gone is None else source.select(*keys).unionByName(gone.select(*keys))
    kept = target.join(named, list(keys), "left_anti")
    columns = source.columns if sync_columns else target.columns
    return kept.unionByName(source, allowMissingColumns=True).select(*columns)


def _hadoop_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


# a new version of a table, or of some of its partitions, is complete beside the table before it takes its place
NEXT, OLD, SWITCH = "__next", "__old", "__switch"
# folder and file names below a staged switch; Spark does not read names that begin with an underscore
EMPTIED, READY = "_emptied", "_READY"
DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def recover(spark: SparkSession, path: str) -> None:
    """Finish what a stopped run left: a whole replacement between its two renames, or a switch of partitions.

    What was complete beside the table takes its place; what was not is dropped and the table stays as it was.
    """
    fs, here = _hadoop_path(spark, path)
    if not fs.exists(here):
        _, new = _hadoop_path(spark, path + NEXT)
        _, old = _hadoop_path(spark, path + OLD)
        if fs.exists(old):
            _, done = _hadoop_path(spark, f"{path}{NEXT}/_SUCCESS")
            fs.rename(new if fs.exists(done) else old, here)
    _, staged = _hadoop_path(spark, path + SWITCH)
    if fs.exists(staged):
        _, ready = _hadoop_path(spark, f"{path}{SWITCH}/{READY}")
        if fs.exists(ready):
            switch_partitions(spark, path)
        else:
            fs.delete(staged, True)


def table_exists(spark: SparkSession, path: str) -> bool:
    recover(spark, path)
    fs, jpath = _hadoop_path(spark, path)
    return fs.exists(jpath)


def drop_table(spark: SparkSession, path: str) -> None:
    for name in (path + SWITCH, path + OLD, path + NEXT, path):
        fs, jpath = _hadoop_path(spark, name)
        fs.delete(jpath, True)


def replace_table(spark: SparkSession, path: str, df: DataFrame, partition: str | None = None) -> None:
    """Write a new version next to the table, then switch by renaming; a stop at any point leaves one complete version."""
    writer = df.hint("rebalance", partition).write.partitionBy(partition) if partition else df.write
    writer.mode("overwrite").parquet(path + NEXT)
    take_place(spark, path)


def drop_staged(spark: SparkSession, path: str) -> None:
    """Remove an incomplete version that a stopped write left beside a table."""
    fs, new = _hadoop_path(spark, path + NEXT)
    fs.delete(new, True)


def take_place(spark: SparkSession, path: str) -> None:
    """The version written beside a table becomes the table, whether there was one before or not."""
    fs, here = _hadoop_path(spark, path)
    _, new = _hadoop_path(spark, path + NEXT)
    _, old = _hadoop_path(spark, path + OLD)
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(new, here)
    fs.delete(old, True)


def partition_folder(partition: str, value) -> str:
    return f"{partition}={DEFAULT_PARTITION if value is None else value}"


def in_partitions(partition: str, values: Sequence) -> Column:
    """Literal partition predicate, so that the scan lists only these folders; null is a partition."""
    named = F.col(partition).isin([v for v in values if v is not None])
    return named | F.col(partition).isNull() if None in values else named


def stage_switch(spark: SparkSession, path: str, rows: DataFrame, partition: str, touched: Sequence) -> None:
    """Write the new content of the touched partitions beside the table; the marker comes last."""
    staged = path + SWITCH
    rows.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(staged)
    for value in touched:
        folder = partition_folder(partition, value)
        fs, written = _hadoop_path(spark, f"{staged}/{folder}")
        if not fs.exists(written):
            fs.mkdirs(_hadoop_path(spark, f"{staged}/{EMPTIED}/{folder}")[1])
    fs, ready = _hadoop_path(spark, f"{staged}/{READY}")
    fs.create(ready, True).close()


def switch_partitions(spark: SparkSession, path: str) -> None:
    """Move staged partitions into the table, one rename each; can be repeated from any point.

    A partition that is still staged replaces the table's, one that is not was moved before. So a partition missing
    from the table is always whole in the staging folder.
    """
    staged = path + SWITCH
    fs, folder = _hadoop_path(spark, staged)
    _, emptied = _hadoop_path(spark, f"{staged}/{EMPTIED}")
    if fs.exists(emptied):
        for entry in fs.listStatus(emptied):
            fs.delete(_hadoop_path(spark, f"{path}/{entry.getPath().getName()}")[1], True)
    for entry in fs.listStatus(folder):
        name = entry.getPath().getName()
        if entry.isDirectory() and not name.startswith("_"):
            move_partition(fs, entry.getPath(), _hadoop_path(spark, f"{path}/{name}")[1])
    fs.delete(folder, True)


def move_partition(fs, staged, here) -> None:
    fs.delete(here, True)
    if not fs.rename(staged, here):
        raise RuntimeError(f"could not move {staged.toString()}; the next run finishes the switch")


def upsert_table(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    partition: str | None = None,
    sync_columns: bool = True,
    gone: DataFrame | None = None,
    stored_in: Sequence | None = None,
) -> DataFrame:
    """Upsert into a Parquet table in place and return it; rows whose keys are in `gone` are deleted as well.

    Without a `partition` column the new version is written beside the table and takes its place by renaming. With one, only
    partitions that receive or lose rows (null counts as a partition) are read and rewritten: their new content is written beside
    the table, marked as complete, and moved in partition by partition. A run that stopped anywhere is finished or undone by the
    next access, and can be repeated: equal keys replace what it left.

    `stored_in` names the partitions that hold rows of the keys now, where the caller knows them; else the keys are looked for
    in the whole table. The lists of partition values have an entry per date, or what the partitions are, at most.
    """
    if not table_exists(spark, path):
        writer = source.write.mode("error")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        return spark.read.parquet(path)
    target = spark.read.parquet(path)
    if partition is None:
        replace_table(spark, path, upsert(target, source, keys, sync_columns, gone))
        return spark.read.parquet(path)
    incoming = scratch_path(spark, "upsert-source")
    source.write.parquet(incoming)
    source = spark.read.schema(source.schema).parquet(incoming)
    touched = {r[0] for r in source.select(partition).distinct().collect()}
    if stored_in is None:
        named = source.select(*keys) if gone is None else source.select(*keys).unionByName(gone.select(*keys))
        stored_in = [r[0] for r in target.join(named, list(keys), "left_semi").select(partition).distinct().collect()]
    touched |= set(stored_in)
    if touched:
        merged = upsert(target.where(in_partitions(partition, list(touched))), source, keys, sync_columns, gone)
        stage_switch(spark, path, merged, partition, list(touched))
        switch_partitions(spark, path)
    drop_table(spark, incoming)
    return spark.read.parquet(path)


WATERMARK_SCHEMA = "model_name string, watermark_ts timestamp, updated_at timestamp"
RUN_SCHEMA = (
    "run_id string, model_name string, as_of_run_ts timestamp, as_of_run_date date, target_name string, "
    "publish_tag string, incremental_lookback_days long, enable_watermark_checks boolean, "
    "enable_dev_sampling boolean, created_at timestamp, updated_at timestamp"
)


class WatermarkStore:
    """Highest event time per model, kept in a table of one row per model."""

    def __init__(self, spark: SparkSession, path: str, cfg: Settings = Settings()):
        self.spark, self.path, self.cfg = spark, path, cfg

    def ensure(self) -> None:
        if not table_exists(self.spark, self.path):
            self.spark.createDataFrame([], WATERMARK_SCHEMA).write.parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(WATERMARK_SCHEMA).parquet(self.path)

    def get(self, model: str) -> dt.datetime:
        row = self.table().where(F.col("model_name") == model).select("watermark_ts").first()
        return row[0] if row and row[0] is not None else self.cfg.watermark_floor

    def known(self, model: str) -> bool:
        """Whether the model has a watermark; without one an incremental run has to read everything."""
        return bool(self.table().where((F.col("model_name") == model) & F.col("watermark_ts").isNotNull()).limit(1).count())

    def put(self, model: str, df: DataFrame, column: str, now: dt.datetime) -> None:
        """Set the watermark to max(column); a table without any value leaves it alone."""
        self.put_all({model: (df, column)}, now)

    def put_all(self, models: Mapping[str, tuple[DataFrame, str]], now: dt.datetime, raise_only: bool = False) -> None:
        """The watermarks of several models in one write; with `raise_only` none falls, so the rows of one run are enough."""
        rows = [
            df.agg(F.max(column).cast("timestamp").alias("watermark_ts"))
            .where(F.col("watermark_ts").isNotNull())
            .select(F.lit(model).alias("model_name"), "watermark_ts", F.lit(now).cast("timestamp").alias("updated_at"))
            for model, (df, column) in models.items()
        ]
        marks = reduce(DataFrame.unionByName, rows)
        if raise_only:
            stored = self.table().select("model_name", F.col("watermark_ts").alias("__stored"))
            higher = F.greatest("watermark_ts", "__stored").alias("watermark_ts")
            marks = marks.join(stored, "model_name", "left").select("model_name", higher, "updated_at")
        upsert_table(self.spark, self.path, marks, ["model_name"])

    def cutoff(
        self, model: str, target: DataFrame | None = None, column: str | None = None, lookback_days: int | None = None
    ) -> dt.datetime:
        """First event time an incremental run has to read again, as a literal the scan can prune with.

        Watermark minus the lookback window; with watermarks off the target's own maximum; with the
        lookback off the floor. A deeper backfill is a larger `lookback_days`; a full refresh uses no cutoff.
        """
        cfg = self.cfg
        if not cfg.lookback_enabled:
            return cfg.watermark_floor
        if cfg.watermarks_enabled:
            top = self.get(model)
        else:
            row = target.agg(F.max(column)).first() if target is not None and column else None
            top = row[0] if row and row[0] is not None else cfg.watermark_floor
        return top - dt.timedelta(days=cfg.lookback_days if lookback_days is None else lookback_days)


class RunLog:
    """One row per run and model with the settings the run used."""

    def __init__(self, spark: SparkSession, path: str, cfg: Settings = Settings()):
        self.spark, self.path, self.cfg = spark, path, cfg

    def ensure(self) -> None:
        if not table_exists(self.spark, self.path):
            self.spark.createDataFrame([], RUN_SCHEMA).write.parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(self.path)

    def put(self, run_id: str, model: str, as_of: dt.datetime, now: dt.datetime) -> None:
        self.put_all(run_id, [model], as_of, now)

    def put_all(self, run_id: str, models: Sequence[str], as_of: dt.datetime, now: dt.datetime) -> None:
        """Record several models of a run in one write; a repeated entry keeps its creation time."""
        cfg = self.cfg
        created = {r[0]: r[1] for r in self.table().where(F.col("run_id") == run_id).select("model_name", "created_at").collect()}
        rows = [
            (run_id, model, as_of, as_of.date(), cfg.target_name, cfg.publish_tag, cfg.lookback_days,
             cfg.watermarks_enabled, cfg.dev_sampling, created.get(model, now), now)
            for model in models
        ]
        upsert_table(self.spark, self.path, self.spark.createDataFrame(rows, RUN_SCHEMA), ["run_id", "model_name"])


def freshness(watermarks: DataFrame, runs: DataFrame, models: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Watermarks by model, and run count with latest run time for the chosen models."""
    latest = (
        runs.where(F.col("model_name").isin(*models))
        .groupBy("model_name")
        .agg(F.count(F.lit(1)).alias("run_rows"), F.max("as_of_run_ts").alias("latest_run_ts"))
        .orderBy("model_name")
    )
    return watermarks.select("model_name", "watermark_ts", "updated_at").orderBy("model_name"), latest
