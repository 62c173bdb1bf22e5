"""Session settings and shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # basket sets are small objects: keep hash aggregation a little longer than 128 orders; sketches still fit
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
    # a build is many statements: what one has shuffled goes when it ends, not when the driver next collects its garbage
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

# stored tables hold many hex keys, whose letters take half as much with this codec
STORED_CODEC = "zstd"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every function of the library relies on."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "basketry") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    return tune(builder.getOrCreate())


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for written tables: the cluster's `spark.checkpoint.dir`, or one of our own if unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/basketry/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="basketry-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table to shared storage and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("error").option("compression", STORED_CODEC)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

