"""Exact byte dedup: shards of repeated strings go through external induced sorting (`induced`).

A byte goes when a `k`-byte string that covers it also starts anywhere else, in the same document or another. Strings are
judged on the input, matches never cross documents.

Bytes that cannot be in a repeated string are ruled out first (`windows`): each k-byte string has a smallest m-byte gram, and
a gram met once in all data cannot belong to a repeat. What is left is dealt by that gram, so all copies of a string meet in
one shard. A shard is one text of distinct strings with separators; its suffix and common-prefix arrays show the
repeats: neighbours in suffix order that agree over k bytes.

Defined results: a null or empty text has no bytes and loses none; texts under k bytes are kept; repeated rows, also of one id,
are copies of each other and both lose their bytes; rows without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import windows as W
from basketry.llm.common import arrow_map, arrow_schema, mix, record_batch, texts, unions, window_min
from basketry.llm.induced import suffix_order
from basketry.llm.substring import spans_by_owner

SHARD_BYTES = 1_500_000
GRAM = 32


def byte_grams(text: bytes) -> np.ndarray:
    """Hash of every 32 consecutive bytes, from four 8-byte words."""
    words = np.ndarray((len(text) - 7,), np.uint64, text, strides=(1,))
    n = len(text) - GRAM + 1
    out = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for j, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
        out += words[j : j + n] * np.uint64(odd)
    return mix(out)


def byte_minima(k: int):
    width = k - GRAM + 1

    def minima(text: bytes):
        if len(text) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        grams = byte_grams(text)
        least = window_min(grams, width)
        edge = W.run_edges(least)
        # a minimiser that occurs twice in a run (periodic text) starts a new run behind each occurrence
        ends = np.append(edge[1:], len(least)).tolist()
        extra = []
        for s, e in zip(edge.tolist(), ends, strict=True):
            places = np.flatnonzero(grams[s : e + width - 1] == least[s])
            if len(places) > 1:
                extra.extend(p for p in (places + s + 1).tolist() if p < e)
        if extra:
            edge = np.unique(np.concatenate((edge, np.array(extra, np.int64))))
        return least, edge, lambda s, e: text[s:e]

    return minima


def cut_bytes(k: int):
    def cut(df: DataFrame) -> DataFrame:
        def per_batch(batch: pa.RecordBatch) -> dict:
            out: dict = {name: [] for name in ("mh", "sh", "copies", "first_doc", "last_doc", "string")}
            for text, want in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("want").to_pylist(), strict=True):
                for w in want:
                    out["string"].append(text[w["start"] : w["start"] + w["n"] + k - 1])
                    for name in ("mh", "sh", "copies", "first_doc", "last_doc"):
                        out[name].append(w[name])
            return out

        return arrow_map(df, per_batch, W.STRINGS)

    return cut


def repeated(k: int, schema: pa.Schema):
    """Per string of a shard: the windows that occur more than once, counting the copies of each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        strings = t.column("string").to_pylist()
        copies = t.column("copies").to_numpy()
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(lengths + 1)
        begins = ends - lengths - 1
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.uint16) + np.uint16(1)
        text[ends - 1] = 0
        place, lcp = suffix_order(text, k)
        group = np.cumsum(lcp < k)
        owner = np.searchsorted(ends, place, side="right")
        at = place - begins[owner]
        whole = at + k <= lengths[owner]
        group, owner, at = group[whole], owner[whole], at[whole]
        total = np.bincount(group, weights=copies[owner])
        on = total[group] > 1
        owner, at = owner[on], at[on]
        order = np.lexsort((at, owner))
        yield record_batch(spans_by_owner(t, owner[order], at[order], np.zeros(len(order), np.int64), np.ones(len(order), bool)), schema)

    return run


def repeated_bytes(docs: DataFrame, k: int = 400) -> DataFrame:
    """(doc_id, text, removed): byte intervals each document loses; removed is null for most. k is at least 64."""
    base = texts(docs)
    runs = W.super_windows(base, byte_minima(k), k)
    solve = repeated(k, arrow_schema(docs.sparkSession, W.SOLVED))
    lone = lambda: F.when(F.col("copies") > 1, F.array(F.struct(F.lit(0).alias("at"), F.col("at.n").alias("n"), F.lit(0).cast("long").alias("mark"))))
    spans = W.repeated_windows(base, runs.df, solve, cut_bytes(k), SHARD_BYTES, lone, lambda: F.lit(True))
    return base.join(spans, ["doc_id", "th"], "left").select("doc_id", "text", F.transform("spans", lambda s: F.struct(s["from"].alias("from"), (s["to"] + k - 1).alias("to"))).alias("removed"))


def kept_bytes(found: DataFrame) -> DataFrame:
    """Digest of `repeated_bytes`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column("doc_id"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("removed").to_pylist(), strict=True):
            gone = unions(np.array([x["from"] for x in spans]), np.array([x["to"] for x in spans])) if spans else []
            digest, at = hashlib.sha256(), 0
            for s, e in gone:
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(sum(e - s for s, e in gone))
            out["n_spans"].append(len(gone))
            out["kept_sha256"].append(digest.hexdigest())
        return out

    return arrow_map(found, per_batch, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
