"""Ranked lexical search: accumulator-limited term-at-a-time scoring of every document for each query item.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A term's weight falls with the number of
documents that hold it; its impact on a document grows with its occurrences there and falls with the document's length.

* Items are taken in blocks of at most about `ITEM_BYTES` of text (a whole benchmark is one block). Their terms, numbered, go to all
  tasks; a pass over the texts stores for each document its number of terms and its occurrences of the items' terms.
* Corpus counts are sums over that table: documents with a term, all terms, documents per term.
* Each task inverts the documents it reads, up to `POSTINGS` postings at a time, into lists of (document, impact). An item's terms are taken
  rarest first. While a document not met yet could still come among the k best, it gets an accumulator; once the largest impacts
  of the terms left add up to less than the k-th best partial score, no accumulator is made any more and the terms left
  only update the documents that have one. Scores are exact, so the k best of all tasks hold the k best of the corpus.
* What leaves a task is k rows per item at most; the last ranking is a window with a group limit before its shuffle.

Defined results: a null or empty text, or one without terms, has no term and is no result; an item without terms has no result; rows of
one item id are one item with the terms of all of them; rows of one document id are documents of their own and
may both be ranked; rows without an id are left out; ties go to the smaller document id; fewer than k documents with a score above 0 give as
many ranks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import Stored, arrow_map, arrow_schema, record_batch, texts

TOP = 50
ITEM_BYTES = 8 << 20
POSTINGS = 8_000_000
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in their order."""
    return text.translate(FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each pair once."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        each = [set(terms(t)) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        ids = np.repeat(batch.column("item_id").to_numpy(), [len(x) for x in each])
        return {"item_id": ids, "term": [t for x in each for t in x]}

    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, per_batch, "item_id long, term binary").distinct()


def occurrences(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, times): a document's number of terms, and which of the vocabulary it holds how often."""
    number = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def per_batch(batch: pa.RecordBatch) -> dict:
        known = number.value
        out: dict = {"doc_id": batch.column("doc_id"), "n": [], "terms": [], "times": []}
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            words = terms(text)
            held = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
            term, times = np.unique(held[held >= 0], return_counts=True)
            out["n"].append(len(words))
            out["terms"].append(term.astype("<i4").tobytes())
            out["times"].append(times.astype("<i4").tobytes())
        return out

    return arrow_map(docs, per_batch, "doc_id long, n long, terms binary, times binary")


def document_frequencies(held: DataFrame) -> DataFrame:
    """(term, df): the documents that hold each term; every task adds up first."""
    schema = arrow_schema(held.sparkSession, "term int, df long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            here = np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"))
            longer, shorter = (total, here) if len(total) >= len(here) else (here, total)
            longer[: len(shorter)] += shorter
            total = longer
        some = np.flatnonzero(total)
        yield record_batch({"term": some, "df": total[some]}, schema)

    return held.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Weight per term, in thousandths."""
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def length_factor(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """How long documents are against the mean, 100 at the mean: half of it is fixed."""
    return 100 - 50 + (50 * n * n_docs) // total


class Postings:
    """Lists of (document, impact) per term for the documents of one task."""

    def __init__(self, lengths: np.ndarray, terms: np.ndarray, times: np.ndarray, weight: np.ndarray):
        doc = np.repeat(np.arange(len(lengths[0]), dtype=np.int32), lengths[1])
        impact = weight[terms] * (1_000_000_000 * times // (1000 * times + 20 * lengths[0][doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.at = np.searchsorted(terms[order], np.arange(len(weight) + 1))
        self.size = len(lengths[0])
        self.most = np.zeros(len(weight), np.int64)
        some = np.flatnonzero(np.diff(self.at))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impact, self.at[some])
        self.made = 0

    def best(self, query: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best; `query` holds the terms, rarest first."""
        query = query[self.most[query] > 0]
        left = np.cumsum(self.most[query][::-1])[::-1]
        score = np.zeros(self.size, np.int64)
        open_ = True
        for term, bound in zip(query, left, strict=True):
            doc, impact = self.doc[self.at[term] : self.at[term + 1]], self.impact[self.at[term] : self.at[term + 1]]
            if open_ and score.max() > bound:
                partial = score[score > 0]
                open_ = len(partial) < k or np.partition(partial, -k)[-k] <= bound
            if open_:
                score[doc] += impact
            else:
                on = score[doc] > 0
                score[doc[on]] += impact[on]
        found = np.flatnonzero(score)
        self.made += len(found)
        if len(found) > k:
            # all that reach the k-th score, so that ties are cut by id
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        found = found[np.lexsort((ids[found], -score[found]))][:k]
        return found, score[found]


def search(held: DataFrame, queries: dict[int, np.ndarray], weight: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best documents of every task for each item."""
    out = "item_id long, doc_id long, score long"
    schema = arrow_schema(held.sparkSession, out)
    shared = held.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, heavy = shared.value
        rows: list[tuple] = []
        size = 0

        def answer() -> pa.RecordBatch:
            ids, n = (np.concatenate(x) for x in zip(*((r[0], r[1]) for r in rows), strict=True))
            each = np.concatenate([r[2] for r in rows])
            term, times = (np.frombuffer(b"".join(x), "<i4") for x in zip(*((r[3], r[4]) for r in rows), strict=True))
            index = Postings((length_factor(n, n_docs, total), each), term, times.astype(np.int64), heavy)
            found = [(item, *index.best(query, k, ids)) for item, query in asked.items()]
            return record_batch({"item_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]), "doc_id": ids[np.concatenate([f[1] for f in found])], "score": np.concatenate([f[2] for f in found])}, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            term = batch.column("terms").to_pylist()
            rows.append((batch.column("doc_id").to_numpy(), batch.column("n").to_numpy(), np.array([len(x) // 4 for x in term]), b"".join(term), b"".join(batch.column("times").to_pylist())))
            size += len(rows[-1][3]) // 4
            if size >= POSTINGS:
                yield answer()
                rows, size = [], 0
        if rows:
            yield answer()

    return held.where("n > 0").mapInArrow(run, out)


def ranked_block(docs: DataFrame, pairs: list[tuple[int, bytes]], k: int) -> DataFrame | None:
    """(item_id, doc_id, score) with the k best and more for one block of items."""
    vocabulary = sorted({t for _, t in pairs})
    number = {t: i for i, t in enumerate(vocabulary)}
    held = Stored(occurrences(docs, vocabulary), "occurrences")
    n_docs, total = held.df.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in document_frequencies(held.df).collect():  # a row per term of the block
        df[r["term"]] = r["df"]
    queries: dict[int, list[int]] = {}
    for item, term in pairs:
        queries.setdefault(item, []).append(number[term])
    rarest = {item: np.array(sorted((x for x in some if df[x]), key=lambda x: (df[x], x)), np.int64) for item, some in queries.items()}
    return search(held.df, rarest, weights(df, n_docs), n_docs, total, k)


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = docs.sparkSession
    asked = Stored(item_terms(items), "item_terms").df
    size = asked.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    base = texts(docs).select("doc_id", "text")
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        pairs = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]  # about ITEM_BYTES
        some = ranked_block(base, pairs, k) if pairs else None
        if some is not None:
            found = found.unionByName(Stored(some, "found").df if blocks > 1 else some)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
