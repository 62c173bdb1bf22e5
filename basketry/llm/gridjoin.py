"""Embedding near-duplicates by an epsilon grid order join.

Vectors are linked if their labels are equal and their cosine is at least `COSINE`. Scaled to length one, that is a distance of at
most epsilon, the square root of 2 - 2 * COSINE.

* Equal vectors of one label are folded to one that counts as many times, so a hot vector is one row.
* Leading principal directions are fitted on at most `SAMPLE` vectors (they only decide the order, never a link). A vector's leading
  coordinates and the length of what they leave out are `LEADING` + 1 numbers whose distance is never more than the full one.
* Vectors are sorted by label and by the grid cells, epsilon wide, of the leading coordinates, and cut into sequences of at most
  `BLOCK`. Of each sequence the box of its coordinates is known. Pairs of sequences are found by joining on the cells of the first
  coordinate that a sequence covers or touches; those with boxes more than epsilon apart are provably distant and
  are skipped before any vector moves.
* A pair of sequences is joined in one task by halving: intervals with boxes too far apart are skipped, intervals so tight and close that
  all their pairs must link are counted as a whole, the rest is compared in small products of doubles. So a large tight
  group costs its intervals, not its pairs.
* What leaves a task is a row per linked vector: its number of links there and one vector it hangs together with. Counts are added up,
  components are found over those edges, whose number is linear in the vectors of a task.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, and a vector without a label, link with
nothing and have a row; vectors of different lengths are not linked; every row is a vector of its own, so rows equal in label and
vector link whatever their ids, and rows of one id are not linked by the id; rows without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Stored, arrow_map, arrow_schema, record_batch
from basketry.llm.components import components

COSINE = 0.93
LEADING = 8
SAMPLE = 2048
BLOCK = 1024
LEAF = 64
SLACK = 1e-7
SEQUENCE = "label long, dim int, n int, nodes binary, times binary, vectors binary, low array<double>, high array<double>"


def folded(vectors: DataFrame) -> tuple[DataFrame, Stored]:
    """The rows (vec_id, label, a, b) with the hash of their vector, null where it takes no part, and the distinct vectors."""
    e = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    v = F.col("v")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & fine, F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("v"))
    rows = rows.select("vec_id", "label", "v", F.when(usable, F.xxhash64("v")).alias("a"), F.when(usable, F.xxhash64(F.lit(1), "v")).alias("b"))
    one = rows.where("a is not null").groupBy("label", "a", "b").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = Stored(one.withColumn("node", F.monotonically_increasing_id()), "vector_classes")
    return rows.drop("v"), classes


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; the largest component goes first, so that no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def directions(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions per vector length, from a bounded sample; other lengths use their first components."""
    held: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("a"), "node").limit(SAMPLE).select("v").toArrow().column("v").to_pylist():
        held.setdefault(len(r), []).append(r)
    out = {}
    for dim, some in held.items():
        rows = unit(np.array(some, np.float64))
        out[dim] = np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)[2][:LEADING].T
    return out


def coordinates(rows: np.ndarray, fitted: dict[int, np.ndarray]) -> np.ndarray:
    """Leading coordinates of unit rows, and the length of the rest."""
    dim = rows.shape[1]
    axes = fitted.get(dim)
    lead = rows @ axes if axes is not None else rows[:, :LEADING]
    rest = np.sqrt(np.maximum(1 - (lead * lead).sum(axis=1), 0))
    out = np.zeros((len(rows), LEADING + 1))
    out[:, : lead.shape[1]] = lead
    out[:, LEADING] = rest
    return out


def epsilon(cosine: float) -> float:
    return float(np.sqrt(max(2 - 2 * cosine, 1e-12)))


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their vectors as a matrix) for each length."""
    v = batch.column(column)
    flat, begin = v.values.to_numpy(), v.offsets.to_numpy()
    lengths = np.diff(begin)
    for dim in np.unique(lengths).tolist():
        on = np.flatnonzero(lengths == dim)
        yield on, flat[begin[on][:, None] + np.arange(dim)]


def in_grid_order(classes: DataFrame, fitted: dict, cosine: float) -> DataFrame:
    """The distinct vectors dealt by range and sorted by label, length and cells."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        cells = np.zeros((batch.num_rows, LEADING), np.int32)
        for on, rows in matrices(batch, "v"):
            cells[on] = np.floor(coordinates(unit(rows), fitted)[:, :LEADING] / epsilon(cosine))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, LEADING, dtype=np.int32)), pa.array(cells.ravel()))
        return {"label": batch.column("label"), "node": batch.column("node"), "times": batch.column("times"), "v": batch.column("v"), "dim": np.diff(batch.column("v").offsets.to_numpy()), "cells": lists}

    cells = arrow_map(classes.select("label", "node", "times", "v"), per_batch, "label long, dim int, cells array<int>, node long, times long, v array<double>")
    order = ["label", "dim", "cells", "node"]
    return cells.repartitionByRange(*order).sortWithinPartitions(*order)


def sequences(ordered: DataFrame, fitted: dict, kind: str) -> DataFrame:
    """Sequences of neighbours in grid order with one label and length, and the box of their coordinates."""
    schema = arrow_schema(ordered.sparkSession, SEQUENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key, size = None, 0

        def flush() -> pa.RecordBatch:
            nodes, times, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            place = coordinates(unit(rows), fitted)
            return record_batch({"label": [key[0]], "dim": [key[1]], "n": [len(nodes)], "nodes": [nodes.tobytes()], "times": [times.tobytes()], "vectors": [rows.astype(kind).tobytes()], "low": [place.min(axis=0)], "high": [place.max(axis=0)]}, schema)

        for batch in batches:
            label, dim = batch.column("label").to_numpy(), batch.column("dim").to_numpy()
            node, times, v = batch.column("node").to_numpy(), batch.column("times").to_numpy(), batch.column("v")
            flat, begin = v.values.to_numpy(), v.offsets.to_numpy()
            turns = np.flatnonzero((label[1:] != label[:-1]) | (dim[1:] != dim[:-1])) + 1
            for s, e in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                if key != (label[s], dim[s]):
                    if held:
                        yield flush()
                    held, size, key = [], 0, (label[s], dim[s])
                while s < e:
                    cut = min(e, s + BLOCK - size)
                    held.append((node[s:cut], times[s:cut], flat[begin[s] : begin[cut]].reshape(cut - s, dim[s])))
                    size += cut - s
                    s = cut
                    if size == BLOCK:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return ordered.select("label", "dim", "node", "times", "v").mapInArrow(run, SEQUENCE)


def apart(a: str, b: str) -> Column:
    """Squared distance of two boxes."""
    gap = F.zip_with(F.zip_with(f"{a}.low", f"{b}.high", lambda x, y: x - y), F.zip_with(f"{b}.low", f"{a}.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return F.aggregate(gap, F.lit(0.0), lambda total, g: total + F.greatest(g, F.lit(0.0)) * F.greatest(g, F.lit(0.0)))


def close_pairs(blocks: DataFrame, cosine: float) -> DataFrame:
    """(x, y): numbers of sequences that are not provably distant, x <= y."""
    eps = epsilon(cosine) + SLACK
    boxes = blocks.select("block", "label", "dim", "low", "high", F.floor(F.col("low")[0] / eps).alias("first"), F.floor(F.col("high")[0] / eps).alias("last"))
    mine = boxes.select("*", F.explode(F.sequence("first", "last")).alias("cell")).alias("x")
    other = boxes.select("*", F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("cell")).alias("y")
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.cell") == F.col("y.cell"))
    # a pair is taken in the first cell it shares
    once = F.col("x.cell") == F.greatest(F.col("x.first"), F.col("y.first") - 1)
    near = mine.join(other, same & (F.col("x.block") <= F.col("y.block")) & once & (apart("x", "y") <= eps * eps))
    return near.select(F.col("x.block").alias("x"), F.col("y.block").alias("y"))


class Pair:
    """Joins two sequences (or one with itself) by halving intervals."""

    def __init__(self, sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]], fitted: dict, cosine: float):
        self.cosine, self.eps = cosine, epsilon(cosine)
        self.own = len(sides) == 1
        self.nodes, self.times, rows = (np.concatenate(x) for x in zip(*sides, strict=True))
        self.rows = rows
        scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
        self.norm = np.linalg.norm(scaled, axis=1)
        self.scaled, self.unit = scaled, scaled / self.norm[:, None]
        self.place = coordinates(self.unit, fitted)
        self.first = len(sides[0][0])
        self.links = np.zeros(len(rows), np.int64)
        self.root = np.arange(len(rows))
        self.compared = self.skipped = self.whole = 0
        self.shape: dict[tuple[int, int], tuple] = {}

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def interval(self, s: int, e: int) -> tuple:
        """Box, centre and radius of an interval."""
        if (s, e) not in self.shape:
            centre = self.unit[s:e].mean(axis=0)
            radius = np.sqrt(((self.unit[s:e] - centre) ** 2).sum(axis=1).max())
            self.shape[s, e] = self.place[s:e].min(axis=0), self.place[s:e].max(axis=0), centre, radius
        return self.shape[s, e]

    def join(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        low, high, centre, radius = self.interval(*a)
        low2, high2, centre2, radius2 = self.interval(*b)
        gap = np.maximum(np.maximum(low - high2, low2 - high), 0)
        if gap @ gap > (self.eps + SLACK) ** 2:
            self.skipped += 1
            return
        d = centre - centre2
        if np.sqrt(d @ d) + radius + radius2 <= self.eps - SLACK:
            self.whole += 1
            self.all_linked(a, b)
            return
        n, m = a[1] - a[0], b[1] - b[0]
        if max(n, m) <= LEAF:
            self.compare(a, b)
        elif a == b:
            half = (a[0] + a[1]) // 2
            self.join((a[0], half), (a[0], half))
            self.join((a[0], half), (half, a[1]))
            self.join((half, a[1]), (half, a[1]))
        elif n >= m:
            half = (a[0] + a[1]) // 2
            self.join((a[0], half), b)
            self.join((half, a[1]), b)
        else:
            half = (b[0] + b[1]) // 2
            self.join(a, (b[0], half))
            self.join(a, (half, b[1]))

    def all_linked(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        if a == b:
            self.links[a[0] : a[1]] += self.times[a[0] : a[1]].sum() - self.times[a[0] : a[1]]
        else:
            self.links[a[0] : a[1]] += self.times[b[0] : b[1]].sum()
            self.links[b[0] : b[1]] += self.times[a[0] : a[1]].sum()
        if a != b or a[1] - a[0] > 1:
            for k in (*range(*a), *range(*b)):
                self.union(a[0], k)

    def compare(self, a: tuple[int, int], b: tuple[int, int]) -> None:
        self.compared += (a[1] - a[0]) * (b[1] - b[0])
        near = (self.scaled[a[0] : a[1]] @ self.scaled[b[0] : b[1]].T) / (self.norm[a[0] : a[1], None] * self.norm[None, b[0] : b[1]]) >= self.cosine
        if a == b:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.links[a[0] : a[1]] += near @ self.times[b[0] : b[1]]
        if a != b:
            self.links[b[0] : b[1]] += near.T @ self.times[a[0] : a[1]]
        # smallest row that hangs together with each row and column of the product
        top = np.arange(len(near))
        while True:
            column = np.where(near, top[:, None], len(near)).min(axis=0)
            then = np.minimum(top, np.where(near, column[None, :], len(near)).min(axis=1))
            if (then == top).all():
                break
            top = then
        for k in np.flatnonzero(near.any(axis=1)):
            self.union(a[0] + k, a[0] + top[k])
        for k in np.flatnonzero(near.any(axis=0)):
            self.union(b[0] + k, a[0] + column[k])

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, root) of all vectors that have a link here."""
        x = (0, self.first)
        self.join(x, x if self.own else (self.first, len(self.rows)))
        some = np.flatnonzero(self.links)
        return self.nodes[some], self.links[some], self.nodes[[self.find(k) for k in some]]


def joined(pairs: DataFrame, blocks: DataFrame, fitted: dict, kind: str, cosine: float) -> DataFrame:
    """(node, links, root) per pair of sequences and linked vector."""
    side = lambda p: blocks.select(F.col("block").alias(p), *[F.col(c).alias(p + c) for c in ("dim", "nodes", "times", "vectors")])
    work = pairs.join(side("x"), "x").join(side("y"), "y")

    def per_batch(batch: pa.RecordBatch) -> dict:
        out: list = []
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r].as_py() for c in ("x", "y", "xdim")}
            sides = []
            for p in ("x", "y")[: 1 if row["x"] == row["y"] else 2]:
                nodes, times = (np.frombuffer(batch.column(p + c)[r].as_py(), np.int64) for c in ("nodes", "times"))
                vectors = np.frombuffer(batch.column(p + "vectors")[r].as_py(), kind).astype(np.float64)
                sides.append((nodes, times, vectors.reshape(len(nodes), row["xdim"])))
            out.append(Pair(sides, fitted, cosine).run())
        return dict(zip(("node", "links", "root"), (np.concatenate(x) for x in zip(*out, strict=True)), strict=True))

    return arrow_map(work, per_batch, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; component_id is the smallest id reachable over links."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows, classes = folded(vectors)
    fitted = directions(classes.df)
    blocks = Stored(sequences(in_grid_order(classes.df, fitted, cosine), fitted, kind).withColumn("block", F.monotonically_increasing_id()), "sequences")
    pairs = Stored(close_pairs(blocks.df, cosine), "sequence_pairs")
    linked = Stored(joined(pairs.df.repartition("x", "y"), blocks.df, fitted, kind, cosine), "linked")
    blocks.drop()
    counts = linked.df.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(linked.df.select(F.col("node").alias("u"), F.col("root").alias("v")).distinct()).df
    named = classes.df.select("label", "a", "b", "node", "times", "least").join(counts, "node", "left").join(groups, "node", "left")
    component = F.coalesce("component", "node")
    smallest = named.groupBy(component.alias("component")).agg(F.min("least").alias("component_id"))
    links = F.coalesce("links", F.lit(0)) + F.col("times") - 1
    found = named.select("label", "a", "b", links.alias("links"), component.alias("component")).join(smallest, "component").drop("component")
    out = rows.join(found, ["label", "a", "b"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (component_id == F.col("vec_id")).alias("kept"))
