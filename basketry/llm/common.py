"""Helpers shared by the training-data operators: stored tables, Arrow batches, word hashes.

Conventions that hold for every operator of this subpackage:

* Only the named input columns are read; further columns, whatever their names, are ignored (filters keep them).
* A row without an id cannot be named in a result and takes no part. A null text counts as empty.
* Rows that repeat an id are separate documents with the same name, unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import scratch_path

CACHE_ENTRIES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def rows_where(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows a task-side test keeps, with all their columns; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, df.schema)


class Stored:
    """A table written to the shared folder: cuts lineage, survives lost executors, can be removed early."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, th): rows with an id, null text as empty, th the hash that tells rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply `fn` to each Arrow batch; it returns one column (array or list) per name of the schema."""
    empty = df.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield record_batch(fn(batch), arrow)

    return df.mapInArrow(run, schema)


def record_batch(cols: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in arrow], schema=arrow)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def ragged(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column out of one numpy array per row."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, np.uint64).view(np.int64)


class WordHash(dict):
    """Word to 64-bit hash, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hash(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of every m consecutive values."""
    out = np.zeros(max(len(h) - m + 1, 0), np.uint64)
    for j in range(m):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - m + 1 + j]
    return mix(out)


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in linear time (running minima of blocks from both ends)."""
    n = len(h)
    if n < w:
        return h[:0]
    top = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    top[:n] = h
    blocks = top.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def unions(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals covered by half-open intervals."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable"):
        s, e = int(starts[k]), int(ends[k])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        elif e > s:
            out.append((s, e))
    return out


def parts(spark: SparkSession, total: float, each: float) -> int:
    """Number of partitions that keeps each at about `each` units."""
    return max(int(-(-total // each)), int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 1)
