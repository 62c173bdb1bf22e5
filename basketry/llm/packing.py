"""Retrieval packing: a sharded BM25 index over token ids returns unused neighbours of a seed, which fill its window.

* Documents become token ids once and are written. Document frequencies of all tokens and the mean length are counted over all
  documents; the vocabulary bounds what is sent back to the tasks.
* Documents are dealt to shards by range of a min-hash of their tokens, so lexically close ones meet; (key, id) is the range key,
  so a hot key is split. A shard is one task with its own inverted index.
* Whole windows of a long document are sequences of their own. The rest of each document seeds or fills windows: the best
  unused neighbours by BM25 follow the seed until the window is full; the last one is cut and its rest seeds the next window.
* What is left at the end of a shard is cut to powers of two. So no sequence holds padding, and each token is in one piece.

Defined results: a null or empty text is the end token alone; rows of one id are packed one by one; rows without an id are left
out; the special token's string in a text is that special token; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm.common import Stored, arrow_schema, mix, parts, record_batch, texts

WINDOW = 2048
SHARD_TOKENS = 2_500_000
QUERY_TERMS = 32
NEAREST = 48
UNITS_KEPT, PIECES_KEPT = 400_000, 100_000
END = 1
K1, B = 1.2, 0.75
# The split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary; printable bytes stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(rest)}


class Encoder(dict):
    """Ids of a text, as bytes of unsigned 16- or 32-bit numbers.

    Some places always begin a piece of the split pattern: a blank before a letter or sign, a dot or comma after a letter or number, a single
    line feed and what follows it. A text cut there is the sum of its units, and words, which repeat, stand apart from the signs beside
    them. Texts in which those places depend on more (runs of white space or signs) are cut at blanks, or at nothing, instead. Units are
    remembered up to a bound, and so are the pieces of those with several.
    """

    LETTERS = byte_letters()
    BLANK = chr(LETTERS[32])
    SIGN_AFTER_OTHERS = re.compile(r"[.,](?<![^\W_][.,])")
    OTHER_SPACE = re.compile(r"[^\S \n]")
    held: dict[str, Encoder] = {}  # per process: later tasks of a worker go on with what it has learnt

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 2**16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.split = regex.compile(PATTERN).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.pieces: dict[str, bytes] = {}

    def ids(self, piece: str) -> bytes:
        if piece.isascii():  # of these a piece of letters holds no byte but the blank that has another letter
            letters = piece.replace(" ", self.BLANK) if piece.removeprefix(" ").isalpha() else piece.translate(self.LETTERS)
        else:
            letters = piece.encode().decode("latin-1").translate(self.LETTERS)
        return array(self.code, [t.id for t in self.tokenize(letters)]).tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= PIECES_KEPT:
                self.pieces.clear()
            ids = self.pieces[piece] = self.ids(piece)
        return ids

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= UNITS_KEPT:
            # frequent units are met early: the half learnt first stays
            first = list(islice(self.items(), UNITS_KEPT // 2))
            self.clear()
            self.update(first)
        # letters are one piece, with a blank before them or without
        ids = self[unit] = self.ids(unit) if unit.removeprefix(" ").isalpha() else b"".join(map(self.piece, self.split(unit)))
        return ids

    def units(self, text: str) -> list[str]:
        if "  " in text or "\0" in text:
            return self.split(text)
        plain = " \n" not in text and "\n\n\n" not in text and "\n\n " not in text and text[-2:] != "\n\n"
        if plain and not self.SIGN_AFTER_OTHERS.search(text) and not self.OTHER_SPACE.search(text):
            text = text.replace("\n", "\0\n\0").replace(".", "\0.").replace(",", "\0,")
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, text: str) -> bytes:
        if any(name in text for name in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join(map(self.__getitem__, self.units(text)))


def kind_of(path: str) -> str:
    return Encoder.of(path).kind.str


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, th, n, key, ids): token ids with the end token, their number, and the shard key."""
    out = "doc_id long, th long, n long, key long, ids binary"
    schema = arrow_schema(docs.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([END], encoder.kind).tobytes()
        mixed = mix(np.arange(encoder.tokenizer.get_vocab_size() + 1, dtype=np.uint64)) >> np.uint64(1)
        for batch in batches:
            ids = [encoder.encode(t) + end for t in batch.column("text").to_pylist()]
            key = [int(mixed[np.frombuffer(x, encoder.kind)].min()) for x in ids]
            yield record_batch({"doc_id": batch.column("doc_id"), "th": batch.column("th"), "n": [len(x) // encoder.kind.itemsize for x in ids], "key": key, "ids": ids}, schema)

    return docs.mapInArrow(run, out)


def document_frequencies(coded: DataFrame, kind: str) -> DataFrame:
    """(token, df) over all documents; each task adds up before the shuffle."""
    schema = arrow_schema(coded.sparkSession, "token long, df long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids").to_pylist():
                held = np.frombuffer(ids, kind)
                if (most := int(held.max())) >= len(total):
                    total = np.append(total, np.zeros(most + 1 - len(total), np.int64))
                total[held] += 1  # numpy adds once for a number that repeats
        some = np.flatnonzero(total)
        yield record_batch({"token": some, "df": total[some]}, schema)

    return coded.select("ids").mapInArrow(run, "token long, df long").groupBy("token").agg(F.sum("df").alias("df"))


class Index:
    """Inverted index of one shard with BM25 weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, owners, weights = [], [], []
        self.query = []
        for k, ids in enumerate(docs):
            term, tf = np.unique(ids, return_counts=True)
            w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))
            terms.append(term)
            owners.append(np.full(len(term), k, np.int32))
            weights.append(w.astype(np.float32))
            best = np.argsort(-(idf[term] * np.minimum(tf, 3)), kind="stable")[:QUERY_TERMS]
            self.query.append(term[best])
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = np.concatenate(owners)[order], np.concatenate(weights)[order]
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.size = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        begin = self.at[self.query[seed]]
        n = self.at[self.query[seed] + 1] - begin
        places = np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)
        return np.bincount(self.owner[places], self.weight[places], self.size)


def fill(docs: list[np.ndarray], index: Index, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length)."""
    start = np.zeros(len(docs), np.int64)
    for k, ids in enumerate(docs):
        while len(ids) - start[k] >= window:
            yield [(k, int(start[k]), window)]
            start[k] += window
    left = np.fromiter(map(len, docs), np.int64, len(docs)) - start
    free = left > 0
    waiting = np.argsort(-left, kind="stable").tolist()[::-1]
    seed = None
    while True:
        while seed is None and waiting:
            k = waiting.pop()
            seed = k if free[k] else None
        if seed is None:
            return
        sequence, room, ranked, whole = [], window, None, False
        current, seed = seed, None
        first = current
        while True:
            n = int(min(left[current], room))
            sequence.append((current, int(start[current]), n))
            start[current] += n
            left[current] -= n
            room -= n
            free[current] = left[current] > 0
            if not room:
                seed = current if free[current] else None
                break
            if ranked is None:
                scores = index.scores(first)
                scores[~free] = -1
                # the best come first; the rest is ordered only if they are used up
                best = np.argpartition(-scores, NEAREST)[:NEAREST] if len(scores) > NEAREST else np.arange(len(scores))
                ranked = best[np.lexsort((best, -scores[best]))].tolist()[::-1]
                whole = len(scores) <= NEAREST
            while ranked and not free[ranked[-1]]:
                ranked.pop()
            if not ranked and not whole:
                scores[~free] = -1
                ranked, whole = [k for k in np.argsort(-scores, kind="stable").tolist()[::-1] if free[k]], True
            if not ranked:
                break
            current = ranked.pop()
        yield sequence


def powers(sequence: list[tuple[int, int, int]], window: int) -> Iterator[list[tuple[int, int, int]]]:
    """A short sequence as sequences of a power of two; full ones as they are."""
    total = sum(n for _, _, n in sequence)
    if total == window:
        yield sequence
        return
    at = 0
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        out = []
        while size:
            k, s, n = sequence[at]
            take = min(n, size)
            out.append((k, s, take))
            size -= take
            sequence[at] = (k, s + take, n - take)
            at += take == n
        yield out


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most `window` tokens; `ids` holds little-endian unsigned 32-bit ids."""
    spark = docs.sparkSession
    kind = kind_of(path)
    coded = Stored(tokens(texts(docs), path), "tokens").df
    count, total = coded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(Tokenizer.from_file(path).get_vocab_size() + 1, np.int64)
    for r in document_frequencies(coded, kind).collect():  # a row per token of the vocabulary
        frequency[r["token"]] = r["df"]
    idf = np.log(1 + (count - frequency + 0.5) / (frequency + 0.5))
    mean = max(total / max(count, 1), 1.0)
    schema = arrow_schema(spark, PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("th", "ascending")])
        ids = [np.frombuffer(x, kind) for x in t.column("ids").to_pylist()]
        names = t.column("doc_id").to_pylist()
        number = TaskContext.get().partitionId() << 32
        out: dict = {f.name: [] for f in schema}

        def piece(k: int, start: int, length: int, offset: int) -> None:
            values = (names[k], start, length, ids[k][start : start + length].astype("<u4").tobytes(), len(ids[k]), number, offset)
            for name, value in zip(out, values, strict=True):
                out[name].append(value)

        for long in fill(ids, Index(ids, idf, mean), window):
            for sequence in powers(long, window):
                offset = 0
                for k, start, length in sequence:
                    piece(k, start, length, offset)
                    offset += length
                number += 1
            if len(out["doc_id"]) > 2000:
                yield record_batch(out, schema)
                out = {f.name: [] for f in schema}
        yield record_batch(out, schema)

    shards = parts(spark, total, SHARD_TOKENS) if total > SHARD_TOKENS else 1
    return coded.repartitionByRange(int(shards), "key", "doc_id", "th").mapInArrow(run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
