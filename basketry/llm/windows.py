"""Super-windows: consecutive windows that share their minimiser travel as one packed string.

Every window of `k` units (words or bytes) has a minimiser, the smallest hash among its `m`-unit grams. Equal windows have
equal minimisers, so a bucket per minimiser brings all copies of a window together. Runs of consecutive windows with the
same minimiser are one string of k + n - 1 units, about twice as long as the step it covers, instead of n windows of k.

Only strings that can matter travel:

1. runs are written as (minimiser, string hash, place), without text;
2. a minimiser met in one run only cannot hold a repeated window: its run ends here;
3. equal strings are folded to one class (partial aggregation before the shuffle), so a hot copied passage is one row;
4. only minimisers with two or more different strings need their text; it is cut from the documents and sent once per class.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Stored, arrow_map, ragged, signed

RUNS = "doc_id long, th long, mh array<long>, sh array<long>, start array<int>, n array<int>"


def runs_of(minima: np.ndarray, edge: np.ndarray, cut: Callable[[int, int], bytes], k: int) -> tuple[np.ndarray, ...]:
    """Runs of one document: minimiser, hash of the packed string, first window, number of windows."""
    n = np.diff(np.append(edge, len(minima)))
    strings = np.fromiter((xxhash.xxh3_64_intdigest(cut(s, s + c + k - 1)) for s, c in zip(edge.tolist(), n.tolist(), strict=True)), np.uint64, len(edge))
    return signed(minima[edge]), signed(strings), edge, n


def run_edges(minima: np.ndarray) -> np.ndarray:
    """First windows of the runs of equal minima."""
    return np.flatnonzero(np.concatenate(([True], minima[1:] != minima[:-1]))) if len(minima) else np.zeros(0, np.int64)


def super_windows(docs: DataFrame, minima: Callable, k: int) -> Stored:
    """Runs of every document of `texts` as written arrays. `minima(text bytes)` gives (window minima, first windows of runs, cutter)."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        found = []
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            found.append(runs_of(*minima(text), k))
        cols = list(zip(*found, strict=True))
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "mh": ragged(cols[0], pa.int64()), "sh": ragged(cols[1], pa.int64()), "start": ragged(cols[2], pa.int32()), "n": ragged(cols[3], pa.int32())}

    return Stored(arrow_map(docs, per_batch, RUNS).where(F.size("mh") > 0), "runs")


def repeated_windows(docs: DataFrame, runs: DataFrame, solve: Callable, cut_strings: Callable, shard_bytes: int, lone: Callable, needed: Callable) -> DataFrame:
    """(doc_id, th, spans): intervals of first windows [from, to) in document order that are repeated.

    `solve(batches) -> batches` gets all strings of a shard (mh, sh, copies, first_doc, last_doc, string) and returns
    (mh, sh, spans) with spans of (at, n, mark). `lone()` gives the spans of a class that is alone at its minimiser,
    `needed()` whether a span s counts for the document of a row.
    """
    spark = docs.sparkSession
    long = runs.select("doc_id", "th", F.explode(F.arrays_zip("mh", "sh", "start", "n")).alias("r")).select("doc_id", "th", "r.mh", "r.sh", "r.start", "r.n")
    shared = long.groupBy("mh").agg(F.count("*").alias("c")).where("c > 1").select("mh")
    kept = Stored(long.join(shared, "mh"), "shared_runs")
    classes = kept.df.groupBy("mh", "sh").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.min(F.struct("doc_id", "th", "start", "n")).alias("at"))
    classes = Stored(classes, "classes")
    several = classes.df.groupBy("mh").agg(F.count("*").alias("c")).where("c > 1").select("mh")
    marked = classes.df.join(several.withColumn("_several", F.lit(True)), "mh", "left")
    alone = marked.where("_several is null").withColumn("spans", lone()).where("spans is not null").select("mh", "sh", "spans")
    wanted = marked.where("_several").groupBy("at.doc_id", "at.th").agg(F.collect_list(F.struct("mh", "sh", "copies", "first_doc", "last_doc", F.col("at.start").alias("start"), F.col("at.n").alias("n"))).alias("want"))
    strings = Stored(cut_strings(docs.join(wanted, ["doc_id", "th"])).dropDuplicates(["mh", "sh"]), "strings")
    size = strings.df.agg(F.sum(F.octet_length("string"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    solved = strings.df.repartition(int(shards), "mh").mapInArrow(solve, SOLVED)
    spans = alone.unionByName(solved.select("mh", "sh", "spans"))
    spans = Stored(spans, "class_spans")
    hits = kept.df.join(spans.df, ["mh", "sh"]).select("doc_id", "th", "start", F.explode("spans").alias("s")).where(needed())
    return hits.groupBy("doc_id", "th").agg(F.collect_list(F.struct((F.col("start") + F.col("s.at")).alias("from"), (F.col("start") + F.col("s.at") + F.col("s.n")).alias("to"))).alias("spans"))


SOLVED = "mh long, sh long, spans array<struct<at: int, n: int, mark: long>>"
STRINGS = "mh long, sh long, copies long, first_doc long, last_doc long, string binary"
