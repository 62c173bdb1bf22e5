"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments; a segment is described by its mean and its deviation. By Cauchy and Schwarz the
squared distance of two vectors is at least the sum over segments of length * ((difference of means)^2 + (difference of
deviations)^2), so with the norms known the inner product is at most the sum of length * (product of means + product of
deviations). Pairs are ruled out coarse to fine where that bound is under the k-th best score known so far; what is left is
scored exactly, in integers.

Vectors travel in packed blocks; each block of queries meets each block of candidates in one row of work, whatever the number of
either. A first look at one block gives every query a k-th best score, so later blocks return few rows.

Defined results: a vector that is null, or holds a null or a non-finite component, takes no part; vectors of different lengths are
not compared; rows equal in id and vector count once; a row with the query's id is no candidate of it; rows without an id are
left out; fewer than k candidates give as many ranks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import Stored, arrow_map, arrow_schema, parts, record_batch

LEVELS = (1, 4, 16)
BLOCK = 4096
QUERY_BLOCK = 1024
SLICE = 64
PACKED = "dim int, n int, ids binary, vectors binary, bounds binary"


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): components as floor(256 * x)."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()


def packed(vectors: DataFrame, block: int, partitions: int, threshold: bool = False) -> DataFrame:
    """Blocks of vectors of one length: ids, matrix and (for queries) the score each has to beat."""
    schema = arrow_schema(vectors.sparkSession, PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, rows, bound = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            return record_batch({"dim": [dim], "n": [len(ids)], "ids": [ids.tobytes()], "vectors": [rows.tobytes()], "bounds": [bound.tobytes()]}, schema)

        for batch in batches:
            v = batch.column("v")
            lengths = np.diff(v.offsets.to_numpy())
            ids = batch.column("vec_id").to_numpy()
            bound = batch.column("bound").to_numpy() if threshold else np.full(len(ids), np.iinfo(np.int64).min)
            flat, begin = v.values.to_numpy(), v.offsets.to_numpy()[:-1]
            for dim in np.unique(lengths).tolist():
                on = np.flatnonzero(lengths == dim)
                for s in range(0, len(on), block):
                    some = on[s : s + block]
                    rows = flat[begin[some][:, None] + np.arange(dim)] if dim else np.zeros((len(some), 0), np.int64)
                    held.setdefault(dim, []).append((ids[some], rows, bound[some]))
                    if sum(len(x[0]) for x in held[dim]) >= block:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return vectors.repartition(partitions, "vec_id").mapInArrow(run, PACKED)


def statistics(rows: np.ndarray) -> list[np.ndarray]:
    """Per level, means and deviations of the segments, weighted so that a product of rows is the bound."""
    out = []
    for level in LEVELS:
        cols = []
        for part in np.array_split(rows.astype(np.float64), min(level, max(rows.shape[1], 1)), axis=1):
            weight = np.sqrt(part.shape[1])
            mean = part.mean(axis=1) if part.shape[1] else np.zeros(len(rows))
            cols += [weight * mean, weight * part.std(axis=1) if part.shape[1] else mean]
        out.append(np.stack(cols, axis=1))
    return out


def best(q_ids, q_rows, bound, c_ids, c_rows, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of the k best per query that reach its bound."""
    q_stats, c_stats = statistics(q_rows), statistics(c_rows)
    found: list[tuple] = []
    for s in range(0, len(q_ids), SLICE):
        e = min(s + SLICE, len(q_ids))
        upper = q_stats[0][s:e] @ c_stats[0].T
        other = q_ids[s:e, None] != c_ids[None, :]
        upper[~other] = -np.inf
        # exact scores of the most promising give a first k-th best
        some = min(4 * k, len(c_ids))
        top = np.argpartition(-(q_stats[-1][s:e] @ c_stats[-1].T + np.where(other, 0, -np.inf)), some - 1, axis=1)[:, :some]
        score = np.einsum("qd,qcd->qc", q_rows[s:e], c_rows[top])
        score[~np.take_along_axis(other, top, 1)] = np.iinfo(np.int64).min
        kth = np.sort(score, axis=1)[:, -k] if some >= k else np.full(e - s, np.iinfo(np.int64).min)
        floor = np.maximum(kth, bound[s:e])
        a, b = np.nonzero(other & (upper * (1 + 1e-9) + 1e-3 >= floor[:, None]))
        for level in range(1, len(LEVELS)):
            keep = np.einsum("pd,pd->p", q_stats[level][s + a], c_stats[level][b])
            keep = keep + 1e-9 * np.abs(keep) + 1e-3 >= floor[a]
            a, b = a[keep], b[keep]
        exact = np.einsum("pd,pd->p", q_rows[s + a], c_rows[b])
        keep = exact >= floor[a]
        a, b, exact = a[keep], b[keep], exact[keep]
        order = np.lexsort((c_ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        found.append((s + a[rank < k], b[rank < k], exact[rank < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def scored(blocks: DataFrame, k: int) -> DataFrame:
    def per_batch(batch: pa.RecordBatch) -> dict:
        out: dict = {"query_id": [], "vec_id": [], "score": []}
        for r in batch.to_pylist():
            q_ids, c_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
            q_rows = np.frombuffer(r["q_vectors"], np.int64).reshape(len(q_ids), -1)
            c_rows = np.frombuffer(r["vectors"], np.int64).reshape(len(c_ids), -1)
            q, c, s = best(q_ids, q_rows, np.frombuffer(r["q_bounds"], np.int64), c_ids, c_rows, k)
            out["query_id"].append(q_ids[q])
            out["vec_id"].append(c_ids[c])
            out["score"].append(s)
        return {n: np.concatenate(v) for n, v in out.items()}

    return arrow_map(blocks, per_batch, "query_id long, vec_id long, score long")


def nearest(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query row; ties go to the smaller id."""
    spark = vectors.sparkSession
    rows = Stored(scaled(vectors), "vectors").df
    n = rows.count()
    blocks = Stored(packed(rows, BLOCK, parts(spark, n, BLOCK)), "blocks").df.withColumn("block", F.monotonically_increasing_id())
    queries = rows.where(is_query(F.col("vec_id")))
    # a first block per length, at random, gives each query a score to beat
    n_query = max(1, -(-queries.count() // QUERY_BLOCK))
    plain = Stored(packed(queries, QUERY_BLOCK, n_query), "query_blocks").df
    rename = lambda df: df.select(F.monotonically_increasing_id().alias("qb"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("bounds").alias("q_bounds"))
    first = blocks.groupBy("dim").agg(F.min("block").alias("block"))
    seed = blocks.join(first, ["dim", "block"])
    start = scored(rename(plain).join(seed, "dim"), k)
    enough = start.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("bound"), F.count("*").alias("c")).where(F.col("c") >= k).drop("c")
    # an id with several vectors has no single bound
    single = queries.groupBy("vec_id").agg(F.count("*").alias("same")).where("same = 1").drop("same")
    bounds = queries.join(enough.join(single, "vec_id"), "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(-(2**63)).cast("long")))
    asked = Stored(rename(packed(bounds, QUERY_BLOCK, n_query, threshold=True)), "asked").df
    numbers = [(r["qb"], r["dim"]) for r in asked.select("qb", "dim").collect()]  # one pair of numbers per block of queries
    if not numbers:
        numbers = [(-1, -1)]
    grid = F.array(*[F.struct(F.lit(a).cast("long").alias("qb"), F.lit(b).alias("dim")) for a, b in numbers])
    pairs = blocks.select("dim", "ids", "vectors", F.explode(F.transform(F.filter(grid, lambda x: x["dim"] == F.col("dim")), lambda x: x["qb"])).alias("qb"))
    work = pairs.join(asked.drop("dim"), "qb").repartition(max(1, min(10_000, len(numbers) * parts(spark, n, BLOCK))), "qb", F.xxhash64("ids"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = scored(work, k).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
