"""Global positions of sorted rows without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Stored


def numbered(df: DataFrame, order: list[str], name: str, column: str = "_pos", partitions: int | None = None) -> DataFrame:
    """The rows with their position in the order; rows that tie get different positions.

    Rows are dealt by range and sorted inside partitions; the written order is kept, so a repeated task cannot renumber. Only one
    count per partition is gathered.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = Stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), name).df
    part = F.shiftrightunsigned("_id", 33)
    counts = sorted((r["p"], r["c"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    starts, total = [], 0
    for p, c in counts:
        starts.append((p, total))
        total += c
    offsets = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))  # a row per partition
    return rows.withColumn("_part", part).join(offsets, "_part").withColumn(column, F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_id")
