"""Substring dedup over words: super-k-mer partitioning with an exact count of the windows of each bucket.

A window is `k` consecutive words of one document. A word goes when a window that covers it has a word sequence which also
starts in a document with a smaller id. Windows are judged on the input.

Inside a shard the words get dense numbers and the ranks of their 1, 2, 4, … word sequences follow by sorting pairs of ranks,
so windows are compared word by word, never by a hash of the whole window.

Defined results: null or empty text: no words, nothing removed; fewer than k words: nothing removed; rows with one id do not
remove each other's words; rows without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import windows as W
from basketry.llm.common import WordHash, arrow_map, arrow_schema, gram_hash, record_batch, texts, unions, window_min

SHARD_BYTES = 6_000_000


def word_minima(k: int, m: int):
    hashes = WordHash()

    def minima(text: bytes):
        words = text.split()
        if len(words) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        least = window_min(gram_hash(hashes.of(words), m), k - m + 1)
        return least, W.run_edges(least), lambda s, e: b" ".join(words[s:e])

    return minima


def cut_words(k: int):
    def cut(df: DataFrame) -> DataFrame:
        def per_batch(batch: pa.RecordBatch) -> dict:
            out: dict = {name: [] for name in ("mh", "sh", "copies", "first_doc", "last_doc", "string")}
            for text, want in zip(batch.column("text").to_pylist(), batch.column("want").to_pylist(), strict=True):
                words = text.encode().split()
                for w in want:
                    out["string"].append(b" ".join(words[w["start"] : w["start"] + w["n"] + k - 1]))
                    for name in ("mh", "sh", "copies", "first_doc", "last_doc"):
                        out[name].append(w[name])
            return out

        return arrow_map(df, per_batch, W.STRINGS)

    return cut


def window_ranks(ids: np.ndarray, k: int) -> np.ndarray:
    """Number of the class of every k consecutive values, by rank doubling; compares values, not hashes."""
    rank, depth = ids.astype(np.int64), 1
    while depth * 2 <= k:
        rank, depth = pair_rank(rank[:-depth], rank[depth:]), depth * 2
    if depth < k:
        rest = k - depth
        rank = pair_rank(rank[:-rest], rank[rest:])
    return rank


def pair_rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1]


def smallest_doc(k: int, schema: pa.Schema):
    """Per string of a shard: runs of windows with the smallest document any equal window starts in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        number: dict[bytes, int] = {}
        ids, lengths = [], []
        for string in t.column("string").to_pylist():
            words = string.split()
            ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
            lengths.append(len(words))
        firsts = t.column("first_doc").to_numpy()
        lasts = t.column("last_doc").to_numpy()
        rank = window_ranks(np.concatenate(ids), k)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        n = np.asarray(lengths) - k + 1
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        rank = rank[begins[owner] + at]
        order = np.argsort(rank, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], rank[order][1:] != rank[order][:-1])))
        least = np.minimum.reduceat(firsts[owner[order]], edge)
        mark = np.empty(len(owner), np.int64)
        mark[order] = np.repeat(least, np.diff(np.append(edge, len(order))))
        yield record_batch(spans_by_owner(t, owner, at, mark, mark < lasts[owner]), schema)

    return run


def spans_by_owner(t: pa.Table, owner: np.ndarray, at: np.ndarray, mark: np.ndarray, on: np.ndarray) -> dict:
    """Fold marked windows to (at, n, mark) spans of their string."""
    owner, at, mark = owner[on], at[on], mark[on]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1) | (mark[1:] != mark[:-1])
    edge = np.flatnonzero(fresh)
    n = np.diff(np.append(edge, len(owner)))
    spans: dict[int, list] = {}
    for o, a, c, d in zip(owner[edge].tolist(), at[edge].tolist(), n.tolist(), mark[edge].tolist(), strict=True):
        spans.setdefault(o, []).append({"at": a, "n": c, "mark": d})
    rows = list(spans)
    return {"mh": t.column("mh").to_numpy()[rows] if rows else [], "sh": t.column("sh").to_numpy()[rows] if rows else [], "spans": [spans[o] for o in rows]}


def repeated_passages(docs: DataFrame, k: int = 50, m: int = 10) -> DataFrame:
    """(doc_id, text, removed): the maximal word intervals each document loses; removed is null for most."""
    base = texts(docs)
    runs = W.super_windows(base, word_minima(k, m), k)
    solve = smallest_doc(k, arrow_schema(docs.sparkSession, W.SOLVED))
    lone = lambda: F.when(F.col("last_doc") > F.col("first_doc"), F.array(F.struct(F.lit(0).alias("at"), F.col("at.n").alias("n"), F.col("first_doc").alias("mark"))))
    spans = W.repeated_windows(base, runs.df, solve, cut_words(k), SHARD_BYTES, lone, lambda: F.col("doc_id") > F.col("s.mark"))
    return base.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", F.transform("spans", lambda s: F.struct(s["from"].alias("from"), (s["to"] + k - 1).alias("to"))).alias("removed"))


def kept_words(passages: DataFrame) -> DataFrame:
    """Digest of `repeated_passages`: doc_id, n_words, n_removed, kept_sha256."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, digest = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("removed").to_pylist(), strict=True):
            words = text.encode().split()
            total = len(words)
            if spans:
                for s, e in reversed(unions(np.array([x["from"] for x in spans]), np.array([x["to"] for x in spans]))):
                    del words[s:e]
            n_words.append(total)
            n_removed.append(total - len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed, "kept_sha256": digest}

    return arrow_map(passages, per_batch, "doc_id long, n_words long, n_removed long, kept_sha256 string")
