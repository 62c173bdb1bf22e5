"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(base: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents, drawn by hash of the id.

    `base` is the output of `texts`. The ids are bounded by `rows`, so they are broadcast and the documents are not shuffled. A document with several labels counts by the
    largest. Ids of equal hash rank are cut by id, so the draw is the same in every run.
    """
    given = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(train)
    given = given.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return base.join(F.broadcast(given), "doc_id").select("doc_id", "text", "y")
