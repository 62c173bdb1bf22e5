"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

* A document is a sparse vector of hashed words (log frequency times inverse document frequency) and of hashed word shapes
  (runs of upper-case, lower-case, digits; other characters as they are; whether a word repeats the one before it), each part
  scaled to length one. Document frequencies are counted over all documents; the hashed space bounds their number.
* The latent space has the leading right singular vectors of a sample of labelled rows, found by subspace iteration: each
  product with the sparse matrix is a Spark job whose tasks return one matrix of fixed size.
* The labelled latent vectors (at most `SAMPLE` x `RANK` numbers) are broadcast. Every document gets its exact cosines with all of
  them, in blocks, and the `NEIGHBOURS` nearest vote with weight cosine cubed.

Defined results: a null, empty or blank text has no vector and gets the share of label 1 in the sample; without labelled rows the
score is 0.5; ties among neighbours go to the lower sample number; rows that repeat an id are scored one by one; rows without an id are left out;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import CACHE_ENTRIES, Stored, arrow_map, arrow_schema, ragged, record_batch, texts
from basketry.llm.labelled import remainder, sample

SAMPLE = 8192
RANK = 48
NEIGHBOURS = 25
WORDS, SHAPES = 1 << 14, 1 << 11
SPACE = WORDS + SHAPES
ITERATIONS = 3
BLOCK = 512


class Features(dict):
    """Word to (word number, shape number), remembered up to a bound."""

    upper, digits = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{N}+")
    lower = regex.compile(r"(?V1)[[\p{L}\p{M}]--\p{Lu}]+")

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        shape = self.digits.sub("0", self.upper.sub("A", self.lower.sub("a", word)))
        a = xxhash.xxh3_64_intdigest(word.lower()) % WORDS
        b = xxhash.xxh3_64_intdigest(shape) % (SHAPES - 1) + 1
        both = self[word] = a * SHAPES + b
        return both

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Features of a document with their frequencies; shape 0 counts repeated words."""
        words = text.split()
        code = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if not len(code):
            return code, code
        repeats = int((code[1:] == code[:-1]).sum())
        word, n_word = np.unique(code // SHAPES, return_counts=True)
        shape, n_shape = np.unique(code % SHAPES, return_counts=True)
        if repeats:
            shape, n_shape = np.append(0, shape), np.append(repeats, n_shape)
        return np.concatenate((word, WORDS + shape)), np.concatenate((n_word, n_shape))


def frequencies(base: DataFrame) -> DataFrame:
    """(feature, df) over all documents; each task adds up before the shuffle."""
    schema = arrow_schema(base.sparkSession, "feature long, df long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros(SPACE, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[features.of(text)[0]] += 1
        some = np.flatnonzero(total)
        yield record_batch({"feature": some, "df": total[some]}, schema)

    return base.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df"))


def weigh(feature: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of a document's features; words and shapes each have length one."""
    words = feature < WORDS
    value = np.where(words, np.log1p(n) * idf[feature], np.sqrt(n / max(n[words].sum(), 1)))
    for part in (words, ~words):
        value[part] /= max(np.sqrt((value[part] ** 2).sum()), 1e-12)
    return value.astype(np.float32)


def products(rows: pa.RecordBatch, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    feature, value = rows.column("feature"), rows.column("value")
    at = feature.offsets.to_numpy()
    return sparse_times(feature.values.to_numpy(), value.values.to_numpy(), at, matrix)


def sparse_times(feature: np.ndarray, value: np.ndarray, at: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    out = np.zeros((len(at) - 1, matrix.shape[1]), np.float32)
    for k in range(len(out)):
        s, e = at[k], at[k + 1]
        if e > s:
            out[k] = value[s:e] @ matrix[feature[s:e]]
    return out


def gathered(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices that the tasks return; their number is bounded by the sample."""
    total = np.zeros(shape, np.float64)
    for r in parts.toLocalIterator():
        total += np.frombuffer(r["m"], np.float32).reshape(shape)
    return total


def latent_space(rows: DataFrame, rank: int, iterations: int) -> np.ndarray:
    """Leading right singular vectors of the sparse rows, by subspace iteration with a fixed start."""
    schema = arrow_schema(rows.sparkSession, "m binary")
    width = rank + 8
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((SPACE, width)))[0].astype(np.float32)
    for _ in range(iterations):

        def run(batches: Iterator[pa.RecordBatch], basis: np.ndarray = basis) -> Iterator[pa.RecordBatch]:
            total = np.zeros(basis.shape, np.float32)
            for batch in batches:
                image = products(batch, basis)
                at = batch.column("feature").offsets.to_numpy()
                feature, value = batch.column("feature").values.to_numpy(), batch.column("value").values.to_numpy()
                for k in range(len(image)):
                    s, e = at[k], at[k + 1]
                    total[feature[s:e]] += value[s:e, None] * image[k]
            yield record_batch({"m": [total.tobytes()]}, schema)

        basis = np.linalg.qr(gathered(rows.mapInArrow(run, "m binary"), basis.shape))[0].astype(np.float32)
    return basis[:, :rank]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def vote(latent: np.ndarray, known: np.ndarray, y: np.ndarray, neighbours: int) -> np.ndarray:
    """Share of label 1 among the nearest known vectors, weighted by cosine cubed; exact, block by block."""
    out = np.empty(len(latent))
    k = min(neighbours, len(known))
    for s in range(0, len(latent), BLOCK):
        cosine = latent[s : s + BLOCK] @ known.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(known) else np.tile(np.arange(k), (len(cosine), 1))
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 3
        out[s : s + BLOCK] = (weight * y[near]).sum(1) / weight.sum(1)
    return np.clip(out, 0, 1)


def score(docs: DataFrame, labels: DataFrame, train, label: str = "quality", rows: int = SAMPLE, rank: int = RANK, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score) per row; `train(doc_id)` tells which labelled rows may be learnt from, `rows` bounds their number."""
    spark = docs.sparkSession
    base = texts(docs)
    df = np.zeros(SPACE, np.int64)
    for r in frequencies(base).collect():  # at most SPACE rows
        df[r["feature"]] = r["df"]
    idf = np.log((1 + df.max(initial=0)) / (1 + df)) + 1

    def sparse(batch: pa.RecordBatch) -> dict:
        features = Features()
        found = [features.of(t) for t in batch.column("text").to_pylist()]
        return {"y": batch.column("y"), "doc_id": batch.column("doc_id"), "feature": ragged([f for f, _ in found], pa.int32()), "value": ragged([weigh(f, n, idf) for f, n in found], pa.float32())}

    drawn = arrow_map(sample(base, labels, label, train(F.col("doc_id")), rows), sparse, "doc_id long, y int, feature array<int>, value array<float>")
    drawn = Stored(drawn.where(F.size("feature") > 0).coalesce(8), "labelled_vectors").df
    n = drawn.count()
    if not n:
        return base.select("doc_id", F.lit(0.5).alias("score"))
    space = latent_space(drawn, min(rank, n), ITERATIONS)
    latent = arrow_map(drawn, lambda b: {"doc_id": b.column("doc_id"), "y": b.column("y"), "v": [v.tobytes() for v in products(b, space)]}, "doc_id long, y int, v binary")
    known_rows = sorted(latent.collect(), key=lambda r: (r["doc_id"], bytes(r["v"])))  # at most `rows` rows
    known = unit(np.stack([np.frombuffer(r["v"], np.float32) for r in known_rows]))
    y = np.array([r["y"] for r in known_rows], np.float64)
    share = float(y.mean())
    shared = spark.sparkContext.broadcast((idf, space, known, y))
    features = Features()

    def per_batch(batch: pa.RecordBatch) -> dict:
        idf, space, known, y = shared.value
        found = [features.of(t) for t in batch.column("text").to_pylist()]
        some = [k for k, (f, _) in enumerate(found) if len(f)]
        out = np.full(len(found), share)
        if some:
            latent = np.stack([weigh(*found[k], idf) @ space[found[k][0]] for k in some])
            out[some] = vote(unit(latent), known, y, neighbours)
        return {"doc_id": batch.column("doc_id"), "score": out}

    return arrow_map(base.select("doc_id", "text"), per_batch, "doc_id long, score double")


def predictions(scores: DataFrame, folds: int, held: int) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    return scores.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
