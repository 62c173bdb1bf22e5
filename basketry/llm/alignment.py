"""Alignment of two tokenizers over the same text: groups of tokens that cover the same bytes, and links of tokens that overlap.

A encodes a blank and the text with a byte-level BPE, B the text with sentencepiece, which adds the blank itself.

* Token spans: the character offsets that the first library reports and the spans of sentencepiece's proto are coarse cuts. A run of
  tokens that the coarse cuts give no byte of their own (parts of one character, byte fallback) is refined with the lengths of the
  decoded bytes, within the run.
* Both tokenizers always cut before a single blank between two characters that are not white space: the split pattern of A begins a piece there, and B has no
  piece with a blank behind another sign (this is tested when the model is loaded; otherwise whole texts are encoded). So a text
  is a sequence of chunks. A chunk is encoded and aligned once, together with other new ones, and remembered, up to a bound.
* Pass one stores per document its counts, the checksum of its groups, and its distinct linked id pairs with how often. Documents per
  pair are counted in each task before they are added up.
* Pass two needs a count for every pair of every document. A pair that one document holds counts 1 and needs no look-up. The highest
  count of each A id (one number per entry of the vocabulary) and the most frequent pairs, `HEAD` at most, go to all tasks; pairs
  below that, if there are any, are joined by a shuffle on the pair. Both ways are exact; frequent pairs, which would be hot keys, never travel.

Defined results: a null or empty text, or one whose token bytes do not add up to blank and text, has no tokens: zeros and an empty
string; rows of one id are documents of their own; rows without an id are left out and not counted; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm.common import Stored, arrow_map, arrow_schema, record_batch, texts
from basketry.llm.packing import byte_letters

HEAD = 1_000_000
CHARS_KEPT = 4_000_000
DOCUMENTS, TOGETHER = 64, 2000
PAIRS_HELD = 2_000_000
BLANK = "▁"
CUT = re.compile(r" (?<=\S )(?=\S)")
CODED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def refined(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens from coarse byte spans and the sizes of their decoded bytes, which add up to the text.

    A token whose span begins where the bytes before it end and is as long as its own ends where the span does. Others, such as parts
    of one character, end after their bytes, so that a run of them ends where the next sound span begins.
    """
    after = np.cumsum(sizes)
    sound = (begins == after - sizes) & (ends - begins == sizes)
    return np.where(sound, ends, after)


class Chunks:
    """Alignments of chunks, numbered: their counts, groups and links in arrays that grow."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str] = []
        # tokens of A and of B, groups, first link, links; minus one where the bytes differ
        self.counts = np.zeros((1024, 5), np.int64)
        self.links = np.zeros(4096, np.int64)
        self.used = 0

    def add(self, chunks: list[str], counts: np.ndarray, groups: list[str], links: np.ndarray) -> None:
        """`counts` holds a row (tokens of A, of B, groups, links) per chunk."""
        first = len(self.groups)
        while first + len(chunks) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        while self.used + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        place = self.counts[first : first + len(chunks)]
        place[:, :3], place[:, 4] = counts[:, :3], counts[:, 3]
        place[:, 3] = self.used + np.cumsum(counts[:, 3]) - counts[:, 3]
        self.links[self.used : self.used + len(links)] = links
        self.used += len(links)
        self.groups += groups
        self.number.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.chars += sum(map(len, chunks))

    def add_broken(self, chunk: str) -> None:
        self.add([chunk], np.array([[-1, 0, 0, 0]]), [""], np.zeros(0, np.int64))


class Aligner:
    """Ids, groups and links of texts."""

    held: dict[tuple[str, str], Aligner] = {}  # per process: later tasks of a worker go on with what it has learnt

    @classmethod
    def of(cls, a: str, b: str) -> Aligner:
        if (a, b) not in cls.held:
            cls.held[a, b] = cls(a, b)
        return cls.held[a, b]

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is its own
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        letters = {chr(c): k for k, c in byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token, i in vocabulary.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.width = len(pieces)
        self.names = list(map(str, range(max(len(pieces), max(vocabulary.values(), default=0) + 1))))
        self.local = not any(BLANK in p.lstrip(BLANK) for p in pieces) and plain_byte_level(a)
        self.chunks = Chunks()

    def spans_a(self, text: str) -> tuple[list[int], np.ndarray] | None:
        """(ids, byte ends) of A's tokens of a blank and a text."""
        encoding = self.a.encode(" " + text, add_special_tokens=False)
        ids = encoding.ids
        raw = [self.a_bytes.get(i, b"") for i in ids]
        if b"".join(raw) != b" " + text.encode():
            return None
        spans = np.fromiter(chain.from_iterable(encoding.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        if not text.isascii():
            code = np.frombuffer((" " + text).encode("utf-32-le"), "<u4")
            spans = np.concatenate(([0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))[spans]
        return ids, refined(spans[:, 0], spans[:, 1], np.fromiter(map(len, raw), np.int64, len(raw)))

    def spans_b(self, text: str) -> tuple[list[int], np.ndarray] | None:
        """(ids, byte ends) of B's tokens; spans count from the text, the blank before it is the first byte."""
        pieces = self.b.encode(text, return_type="proto").pieces
        each = [(p.id, p.begin, p.end) for p in pieces]
        ids = [i for i, _, _ in each]
        raw = [self.b_bytes[i] for i in ids]
        if b"".join(raw) != b" " + text.encode():
            return None
        spans = np.fromiter(chain.from_iterable(each), np.int64, 3 * len(each)).reshape(-1, 3)[:, 1:] + 1
        spans[:1, 0] = 0
        return ids, refined(spans[:, 0], spans[:, 1], np.fromiter(map(len, raw), np.int64, len(raw)))

    def align(self, chunks: list[str]) -> tuple[np.ndarray, list[str], np.ndarray] | None:
        """(counts, groups as text, links as codes) of chunks encoded together; None if bytes differ or a token spans two."""
        text = " ".join(chunks)
        one, two = self.spans_a(text), self.spans_b(text)
        if one is None or two is None:
            return None
        (a, a_end), (b, b_end) = one, two
        ends = np.cumsum([1 + len(c.encode()) for c in chunks])
        common = a_end[np.isin(a_end, b_end, assume_unique=True)]
        if not np.isin(ends, common, assume_unique=True).all():
            return None
        # every byte range between two cuts of either side is the overlap of one token of A and one of B
        cuts = np.union1d(a_end, b_end)
        links = np.array(a, np.int64)[np.searchsorted(a_end, cuts)] * self.width + np.array(b, np.int64)[np.searchsorted(b_end, cuts)]
        a_name, b_name = [self.names[i] for i in a], [self.names[i] for i in b]
        groups, i, j = [], 0, 0
        for to_a, to_b in zip((np.searchsorted(a_end, common) + 1).tolist(), (np.searchsorted(b_end, common) + 1).tolist(), strict=True):
            groups.append(f"{a_name[i]}|{b_name[j]}" if to_a - i == to_b - j == 1 else ",".join(a_name[i:to_a]) + "|" + ",".join(b_name[j:to_b]))
            i, j = to_a, to_b
        upto = np.stack([np.searchsorted(x, ends) + 1 for x in (a_end, b_end, common, cuts)], axis=1)
        last = upto[:, 2].tolist()
        return np.diff(upto, axis=0, prepend=0), [";".join(groups[s:e]) for s, e in zip([0, *last], last)], links

    def learn(self, chunks: list[str]) -> None:
        """Align new chunks; those that end in white space are encoded alone, others together."""
        rest = []
        for c in chunks:
            if BLANK in c:
                self.chunks.add_broken(c)  # decodes to a blank, so bytes differ
            else:
                rest.append(c)
        together = [c for c in rest if self.local and not (c[:1].isspace() or c[-1:].isspace())]
        alone = list(set(rest).difference(together))
        for s in range(0, len(together), TOGETHER):
            some = together[s : s + TOGETHER]
            aligned = self.align(some)
            if aligned is None:
                alone += some
            else:
                self.chunks.add(some, *aligned)
        for c in alone:
            aligned = self.align([c])
            if aligned is None:
                self.chunks.add_broken(c)
            else:
                self.chunks.add([c], *aligned)

    def documents(self, texts: list[str]) -> Iterator[tuple | None]:
        """(n_a, n_b, n_groups, n_links, checksum of the groups, distinct links, how often) per text; None without tokens."""
        if self.chunks.chars > CHARS_KEPT:
            self.chunks = Chunks()
        orders = [(CUT.split(t) if self.local else [t]) if t else [] for t in texts]
        number = self.chunks.number
        places = [np.fromiter(map(number.get, order, repeat(-1)), np.int64, len(order)) for order in orders]
        new = {order[k] for order, place in zip(orders, places, strict=True) for k in np.flatnonzero(place < 0).tolist()}
        self.learn(sorted(new))
        counts, links, groups = self.chunks.counts, self.chunks.links, self.chunks.groups
        for order, place in zip(orders, places, strict=True):
            for k in np.flatnonzero(place < 0).tolist():
                place[k] = number[order[k]]
            mine, times = np.unique(place, return_counts=True)
            n_a, n_b, n_groups, begin, n = counts[mine].T
            if not order or (n_a < 0).any():
                yield None
                continue
            every = links[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())]
            pairs, where = np.unique(every, return_inverse=True)
            often = np.bincount(where, np.repeat(times, n), len(pairs)).astype(np.int64)
            text = ";".join([groups[k] for k in place.tolist()])
            yield int(times @ n_a), int(times @ n_b), int(times @ n_groups), int(times @ n), hashlib.sha256(text.encode()).hexdigest(), pairs, often


def plain_byte_level(path: str) -> bool:
    """Whether a tokenizer file splits by the byte-level pattern and neither changes nor pads texts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)


def coded(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per row of `texts` its counts, the checksum of its groups and its distinct pairs."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        aligner = Aligner.of(a, b)
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        text = batch.column("text").to_pylist()
        rows = [r or none for s in range(0, len(text), DOCUMENTS) for r in aligner.documents(text[s : s + DOCUMENTS])]
        out: dict = {"doc_id": batch.column("doc_id")}
        out |= {name: [r[k] for r in rows] for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"))}
        # sorted pairs as steps: small numbers, which the stored table packs well
        return out | {"pairs": [np.diff(r[5], prepend=0).astype("<i8").tobytes() for r in rows], "times": [r[6].astype("<i4").tobytes() for r in rows]}

    return arrow_map(docs, per_batch, CODED)


def pairs_of(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "<i8"))


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, count): documents that hold each pair; every task adds up what it can hold first."""
    schema = arrow_schema(table.sparkSession, "pair long, count long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, new, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            both = np.concatenate([pairs, *new])
            weight = np.concatenate([counts, np.ones(size, np.int64)])
            distinct, place = np.unique(both, return_inverse=True)
            return distinct, np.bincount(place, weight, len(distinct)).astype(np.int64)

        for batch in batches:
            for steps in batch.column("pairs").to_pylist():
                new.append(pairs_of(steps))
                size += len(new[-1])
                if size >= PAIRS_HELD:
                    pairs, counts = added()
                    new, size = [], 0
                    if len(pairs) >= PAIRS_HELD:
                        yield record_batch({"pair": pairs, "count": counts}, schema)
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = added()
        yield record_batch({"pair": pairs, "count": counts}, schema)

    return table.select("pairs").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def head_from(counts: DataFrame, head: int) -> int:
    """Smallest power of two such that at most `head` pairs are in that many documents or more."""
    level = F.floor(F.log2("count")).cast("int")
    sizes = {r["level"]: r["n"] for r in counts.where("count >= 2").groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    least, total = 1 << 62, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > head:
            break
        least = 1 << k
    return least if sizes else 2


def looked_up(table: DataFrame, counts: DataFrame, width: int, least: int) -> DataFrame:
    """(row, n_best, count_sum, rest, rest_times): sums over the frequent pairs; the others are left to do unless they must be single."""
    spark = table.sparkSession
    top = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("count").alias("most")).toArrow()  # a row per entry of A
    most = np.zeros(max(top.column("a").to_pylist(), default=-1) + 1, np.int64)
    most[top.column("a").to_numpy()] = top.column("most").to_numpy()
    frequent = counts.where(F.col("count") >= least).toArrow().sort_by("pair")
    single = counts.where((F.col("count") >= 2) & (F.col("count") < least)).limit(1).count() == 0
    shared = spark.sparkContext.broadcast((most, frequent.column("pair").to_numpy(), frequent.column("count").to_numpy()))

    def per_batch(batch: pa.RecordBatch) -> dict:
        most, known, count = shared.value
        out: dict = {"row": batch.column("row"), "n_best": [], "count_sum": [], "rest": [], "rest_times": []}
        for steps, often in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist(), strict=True):
            pairs, times = pairs_of(steps), np.frombuffer(often, "<i4").astype(np.int64)
            n = np.ones(len(pairs), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                hit = known[place] == pairs
                n[hit] = count[place[hit]]
            else:
                hit = np.zeros(len(pairs), bool)
            done = hit | single
            out["n_best"].append(int(times[done & (n == most[pairs // width])].sum()))
            out["count_sum"].append(int((n * times)[done].sum()))
            out["rest"].append(pairs[~done])
            out["rest_times"].append(times[~done])
        return out

    return arrow_map(table.select("row", "pairs", "times"), per_batch, "row long, n_best long, count_sum long, rest array<long>, rest_times array<long>")


def align(docs: DataFrame, a: str, b: str, head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row."""
    table = Stored(coded(texts(docs).select("doc_id", "text"), a, b).withColumn("row", F.monotonically_increasing_id()), "aligned").df
    counts = Stored(pair_counts(table), "pair_counts").df
    width = sentencepiece.SentencePieceProcessor(model_file=b).vocab_size()
    least = head_from(counts, head)
    sums = Stored(looked_up(table, counts, width, least), "looked_up").df
    left = sums.where(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    rare = counts.where(F.col("count") < least)
    most = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("count").alias("most"))
    rare = rare.withColumn("a", F.expr(f"pair div {width}")).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    rest = left.join(rare, "pair").groupBy("row").agg(best.alias("more_best"), F.sum(F.col("count") * F.col("times")).alias("more_sum"))
    out = table.drop("pairs", "times").join(sums.select("row", "n_best", "count_sum"), "row").join(rest, "row", "left")
    total = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).cast("long").alias(x)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")
