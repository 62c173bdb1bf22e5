"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document is contaminated by an item if some passage of it is within `rate` times the item's length in edits (insertions, deletions,
changes of a byte), both lower-cased with white space folded to one blank.

1. Items come in blocks of bounded size; a block is broadcast, every document is read against it whole.
2. Places that cannot match are ruled out without loss: e edits destroy at most q * e of the n - q + 1 q-grams of an item, so a
   matching passage keeps n - q + 1 - q * e of them. Only stretches with that many grams of the block's items go on.
3. At each byte of such a stretch an item-sized window is embedded: the CGK random walk copies a byte and moves on, or
   stays, by a random bit for (step, byte). Strings at a small edit distance walk together again after each edit, so their
   embeddings are at a small Hamming distance with good probability.
4. Bit sampling: `TABLES` tables for each of `WALKS` walks compare 8 sampled places of the embeddings. An item is walked
   from its four quarters, each over a quarter of the shortest item of its length class: walks that have drifted apart
   after many edits start anew. Windows and items that agree in a table are candidates. The first walk of an item never leaves it, so
   a verbatim copy agrees in all its tables, wherever it stands; blanks play no part.
5. Candidates are confirmed exactly by a bit-parallel edit distance of the item against all passages of the stretch.

Recall: with edits spread evenly at the limit, a quarter has its share of them and one of 4 x 36 tables agrees with probability
over 0.95; the tests measure it against brute force. Items under
`SHORT` bytes are cut in one piece more than their edits instead, and compared wherever a piece stands unchanged.

Defined results: a null, empty or blank text holds nothing; empty or null items match nothing; items of equal text each get a row; rows of one id
are documents of one name: the id is reported once with the smallest distance; rows without an id are left out; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import arrow_map, mix, rows_where, texts
from basketry.llm.positions import numbered

RATE = 0.06
BLOCK_ITEMS = 2000
SHORT = 24
WALKS, TABLES, SAMPLED = 3, 12, 8
RESTARTS = 4
STRETCH = 1.25
BITS = 22
KEY_BITS = 16
WINDOWS = 200_000
LONG_ITEM = 100
GRAM = {False: 5, True: 8}  # gram length of items under and from LONG_ITEM bytes on


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def edits_allowed(n: int, rate: float) -> int:
    return int(n * rate)


def grams(text: bytes, q: int) -> np.ndarray:
    """Every q consecutive bytes as a number, q up to 8."""
    padded = text + b"\0" * 8
    words = np.ndarray((len(padded) - 7,), np.uint64, padded, strides=(1,))[: max(len(text) - q + 1, 0)]
    return words & np.uint64(2 ** (8 * q) - 1) if q < 8 else words


def slot(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


class Walk:
    """One random walk of the CGK embedding, the same for items and windows."""

    def __init__(self, number: int, steps: int):
        bits = mix(np.arange(256 * steps, dtype=np.uint64) + np.uint64((number + 1) << 40))
        self.moves = (bits & np.uint64(1)).astype(np.int32).reshape(steps, 256)

    def embed(self, text: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Bytes of the embeddings at the wanted steps, for the strings that begin at `starts`."""
        out = np.zeros((len(starts), len(wanted)), np.uint8)
        at = starts.astype(np.int64).copy()
        column = {int(s): k for k, s in enumerate(wanted)}
        last = len(text) - 1
        for step in range(int(wanted.max()) + 1):
            byte = text[np.minimum(at, last)]
            if step in column:
                out[:, column[step]] = byte
            at += self.moves[step][byte]
        return out


def distance_within(pattern: bytes, text: bytes, most: int) -> int | None:
    """Smallest edit distance of the pattern to any passage of the text, if at most `most`; bit-parallel, a big number per column."""
    n = len(pattern)
    where: dict[int, int] = {}
    for k, byte in enumerate(pattern):
        where[byte] = where.get(byte, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for byte in text:
        eq = where.get(byte, 0)
        diagonal = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & full, down << 1 & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
        if score < best:
            best = score
    return best if best <= most else None


class Items:
    """A block of items: gram tables, length classes and their embedded keys."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items, self.rate = items, rate
        self.short = [k for k, (_, t) in enumerate(items) if 0 < len(t) < SHORT]
        self.tables, self.classes = {}, []
        self.own: dict[int, np.ndarray] = {}
        rest = sorted((k for k, (_, t) in enumerate(items) if len(t) >= SHORT), key=lambda k: len(items[k][1]))
        while rest:
            low = len(items[rest[0]][1])
            long = low >= LONG_ITEM
            same = [k for k in rest if len(items[k][1]) <= low * STRETCH and (len(items[k][1]) >= LONG_ITEM) == long]
            rest = rest[len(same) :]
            self.classes.append(self.length_class(same, long))
        for long in (False, True):
            held = [grams(items[c_k][1], GRAM[long]) for c in self.classes if c["long"] == long for c_k in c["members"]]
            if held:
                self.tables[long] = np.zeros(1 << BITS, bool)
                self.tables[long][slot(np.concatenate(held))] = True

    def length_class(self, members: list[int], long: bool) -> dict:
        sizes = [len(self.items[k][1]) for k in members]
        q = GRAM[long]
        need = min(n - q + 1 - q * edits_allowed(n, self.rate) for n in sizes)
        # the walk moves on by half a step per step: these steps stay inside a quarter of the shortest item
        steps = max(24, int(min(sizes) * 1.6 / RESTARTS))
        text = np.frombuffer(b"".join(self.items[k][1] + b"\0" * steps for k in members), np.uint8)
        starts, owner, at = [], [], 0
        for k in members:
            item = self.items[k][1]
            for part in range(RESTARTS):
                starts.append(at + len(item) * part // RESTARTS)
                owner.append(k)
            at += len(item) + steps
        found, members_of = [], np.asarray(owner)
        for w in range(WALKS):
            keys = self.walked(w, steps, text, np.asarray(starts))
            for table in range(TABLES):
                order = np.argsort(keys[:, table], kind="stable")
                held = np.zeros(1 << KEY_BITS, bool)
                held[slot(keys[:, table], KEY_BITS)] = True
                found.append((keys[order, table], members_of[order], held))
        return {"members": members, "long": long, "need": max(need, 1), "reach": max(n + edits_allowed(n, self.rate) for n in sizes), "steps": steps, "tables": found}

    @staticmethod
    def walked(number: int, steps: int, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys of the strings that begin at `starts`: per table its sampled bytes of the embedding."""
        draws = mix(np.arange(TABLES * steps, dtype=np.uint64) + np.uint64((number + 1) << 30)).reshape(TABLES, steps)
        places = np.argsort(draws, axis=1)[:, :SAMPLED]
        wanted, column = np.unique(places, return_inverse=True)
        embedded = Walk(number, steps).embed(text, starts, wanted)
        out = np.zeros((len(starts), TABLES, 8), np.uint8)
        out[:, :, :SAMPLED] = embedded[:, column.reshape(TABLES, SAMPLED)]
        return out.reshape(len(starts), -1).view(np.uint64)

    def candidates(self, docs: list[bytes]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(document, item) to stretches of the document that may hold the item."""
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        windows: list[list] = [[] for _ in self.classes]
        for d, text in enumerate(docs):
            hits = {long: np.flatnonzero(table[slot(grams(text, GRAM[long]))]) for long, table in self.tables.items()}
            for c, kind in enumerate(self.classes):
                p = hits[kind["long"]]
                need, reach = kind["need"], kind["reach"]
                if len(p) < need:
                    continue
                near = np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] < reach)
                if len(near):
                    # stretches of places within reach of such a crowd of grams
                    low, high = p[near] - reach, p[near + need - 1] + 1
                    fresh = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1] + reach)))
                    ends = np.append(fresh[1:] - 1, len(low) - 1)
                    for s, e in zip(np.maximum(low[fresh], 0).tolist(), high[ends].tolist(), strict=True):
                        windows[c].append((d, s, e))
        for c, kind in enumerate(self.classes):
            self.compare(kind, windows[c], docs, out)
        for d, text in enumerate(docs):
            for k in self.short:
                if near := self.around_pieces(self.items[k][1], text):
                    out[d, k] = near
        return out

    def around_pieces(self, item: bytes, text: bytes) -> list[tuple[int, int]]:
        """Stretches where a short item may begin: cut in one piece more than edits are allowed, one piece stands there unchanged."""
        most = edits_allowed(len(item), self.rate)
        cuts = [len(item) * part // (most + 1) for part in range(most + 2)]
        out = set()
        for low, high in zip(cuts, cuts[1:], strict=False):
            at = text.find(item[low:high])
            while at >= 0:
                out.add((max(0, at - low - most), max(0, at - low) + most + 1))
                at = text.find(item[low:high], at + 1)
        return sorted(out)

    def compare(self, kind: dict, stretches: list, docs: list[bytes], out: dict) -> None:
        """Embed windows at every byte of the stretches and look their keys up."""
        at = 0
        while at < len(stretches):
            pieces, starts, owner, size, windows = [], [], [], 0, 0
            while at < len(stretches) and windows < WINDOWS:
                d, s, e = stretches[at]
                text = np.frombuffer(docs[d][s : e + kind["reach"]], np.uint8)
                begins = np.arange(min(e - s, len(text)))
                pieces += [text, np.zeros(kind["steps"], np.uint8)]
                starts.append(begins + size)
                owner.append((at, len(begins)))
                size += len(text) + kind["steps"]
                windows += len(begins)
                at += 1
            text, begins = np.concatenate(pieces), np.concatenate(starts)
            which = np.repeat([o for o, _ in owner], [n for _, n in owner])
            # one stretch may hold more windows than are embedded at once
            for low in range(0, len(begins), WINDOWS):
                self.look_up(kind, text, begins[low : low + WINDOWS], which[low : low + WINDOWS], stretches, out)

    def look_up(self, kind: dict, text: np.ndarray, begins: np.ndarray, which: np.ndarray, stretches: list, out: dict) -> None:
        for w in range(WALKS):
            keys = self.walked(w, kind["steps"], text, begins)
            for t in range(TABLES):
                values, members, held = kind["tables"][w * TABLES + t]
                maybe = np.flatnonzero(held[slot(keys[:, t], KEY_BITS)])
                low = np.searchsorted(values, keys[maybe, t], side="left")
                high = np.searchsorted(values, keys[maybe, t], side="right")
                hit = np.flatnonzero(high > low)
                # each (stretch, run of equal keys) once
                for o, b, e_ in sorted(set(zip(which[maybe[hit]].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True))):
                    d, s, e = stretches[o]
                    for k in members[b:e_].tolist():
                        found = out.setdefault((d, k), [])
                        if (s, e) not in found[-1:]:
                            found.append((s, e))

    def enough(self, k: int, passage: bytes, most: int) -> bool:
        """Whether the passage keeps as many grams of this item as that many edits must leave."""
        item = self.items[k][1]
        if len(item) < SHORT:
            return True
        q = GRAM[len(item) >= LONG_ITEM]
        if k not in self.own:
            self.own[k] = np.unique(grams(item, q))
        mine, there = self.own[k], grams(passage, q)
        place = np.minimum(np.searchsorted(mine, there), len(mine) - 1)
        return int((mine[place] == there).sum()) >= len(item) - q + 1 - q * most

    def leaks(self, docs: list[bytes]) -> dict[tuple[int, int], int]:
        """(document, item) to the number of edits, confirmed."""
        out = {}
        for (d, k), stretches in self.candidates(docs).items():
            item = self.items[k][1]
            most = edits_allowed(len(item), self.rate)
            for s, e in dict.fromkeys(stretches):
                passage = docs[d][max(0, s - most) : e + len(item) + most]
                edits = 0 if item in passage else distance_within(item, passage, most) if self.enough(k, passage, most) else None
                if edits is not None:
                    out[d, k] = min(edits, out.get((d, k), edits))
        return out


def blocks(benchmark: DataFrame, rate: float, size: int):
    """Per block of items a function that gives the block's `Items` inside a task."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = numbered(items, ["item_id", "text"], "items")
    for at in range(0, items.count(), size):
        rows = items.where((F.col("_pos") >= at) & (F.col("_pos") < at + size)).collect()  # a block
        held = benchmark.sparkSession.sparkContext.broadcast(sorted((r["item_id"], normal(r["text"])) for r in rows))
        made: list[Items] = []

        def block(held=held, made=made) -> Items:
            if not made:
                made.append(Items(held.value, rate))
            return made[0]

        yield block


def found_in(batch: pa.RecordBatch, items: Items):
    """(row, item number, edits) of a batch."""
    text = batch.column("text")
    for s in range(0, batch.num_rows, 500):
        for (d, k), edits in items.leaks([normal(t) for t in text.slice(s, 500).to_pylist()]).items():
            yield s + d, k, edits


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold a passage within `rate` of an item."""
    base = texts(docs).select("doc_id", "text")
    schema = "doc_id long, item_id long, edits long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, rate, block):

        def per_batch(batch: pa.RecordBatch, items=items) -> dict:
            hits = list(found_in(batch, items()))
            ids = batch.column("doc_id").to_pylist()
            return {"doc_id": [ids[d] for d, _, _ in hits], "item_id": [items().items[k][0] for _, k, _ in hits], "edits": [e for _, _, e in hits]}

        found = found.unionByName(arrow_map(base, per_batch, schema))
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK_ITEMS) -> DataFrame:
    """The rows that hold no item, with all their columns; rows without an id are judged like others."""
    for items in blocks(benchmark, rate, block):

        def keep(batch: pa.RecordBatch, items=items) -> list[bool]:
            leaking = {d for d, _, _ in found_in(batch, items())}
            return [d not in leaking for d in range(batch.num_rows)]

        docs = rows_where(docs, keep)
    return docs
