"""Toxicity scores: a learnt lexicon, misspellings by Levenshtein automata on its trie, and the context of each hit.

* Lexicon: words and stems (word beginnings) that labelled toxic documents use far more than others, by a binomial
  log-likelihood ratio against the number of candidates. Every term that passes is kept: their number is bounded by the words of the
  `SAMPLE` labelled rows, and so is the lexicon that is broadcast.
* Hits: words at distance 0 of a term, or 1 for terms of five letters or more. The trie and the automata are walked together
  (`automaton`); a word is matched once per task while it is remembered.
* Context: a hit counts as quoted if the `CONTEXT` characters on either side enclose it in quotation marks. Hits are counted per
  (term, edits, quoted) and set against the length of the text: a stem may turn up by chance in a long clean text. The weight
  of each (term, edits, quoted, density) is its log odds among the labelled documents, smoothed towards the term and the class of
  hit; a quoted hit without evidence counts half.
* Score: logistic of the log odds of the strongest hit plus half of the further evidence, or of a text without hits.

Labelled rows are drawn up to `SAMPLE`; labels, language, source and id are no inputs of a score.

Defined results: a null or empty text has no hits and the score of a text without hits; without labelled rows of both kinds there is no
lexicon and the score is the share of label 1 (0 without any); rows that repeat an id are scored one by one; rows without an id are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.automaton import Lexicon
from basketry.llm.common import CACHE_ENTRIES, Stored, arrow_map, arrow_schema, record_batch, rows_where, texts
from basketry.llm.labelled import sample

SAMPLE = 40_000
CONTEXT = 60
SHORTEST, LONGEST = 4, 9

SPLIT = regex.compile(r"[\p{L}\p{N}]+")
# Pairs of quotation marks.
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’", "``": "''"}


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the characters around a hit open a quotation before it and close it after."""
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    for opening, closing in QUOTES.items():
        if opening == closing:
            if before.count(opening) % 2 and closing in after:
                return True
        elif before.rfind(opening) > before.rfind(closing) and closing in after:
            return True
    return False


def term_counts(drawn: DataFrame) -> DataFrame:
    """(term, stem, pos, n): labelled documents with the word or a word that begins so, toxic and all; tasks add up before the shuffle."""
    out = "term string, stem boolean, pos long, n long"
    schema = arrow_schema(drawn.sparkSession, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                pos: Counter = Counter()
                n: Counter = Counter()
                for text, y in zip(some.column("text").to_pylist(), some.column("y").to_pylist(), strict=True):
                    words = set(SPLIT.findall(text.lower()))
                    terms = {(w, False) for w in words if len(w) > 2}
                    for k in range(SHORTEST, LONGEST + 1):
                        terms.update((w[:k], True) for w in words if len(w) >= k)
                    n.update(terms)
                    if y:
                        pos.update(terms)
                keys = list(n)
                yield record_batch({"term": [t for t, _ in keys], "stem": [k for _, k in keys], "pos": [pos[k] for k in keys], "n": list(n.values())}, schema)

    return drawn.mapInArrow(run, out).groupBy("term", "stem").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def surprise(pos, n, rate: float):
    """Log-likelihood ratio of `pos` of `n` against the rate, as a column."""
    share = pos / n
    rest = F.when(pos < n, (n - pos) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    return pos * F.log(share / rate) + rest


def lexicon(counts: DataFrame, rate: float) -> list[tuple[str, bool]]:
    """Terms (text, is_stem) that are surprising beyond chance; of terms that begin alike the one with most evidence stays."""
    need = math.log(max(counts.where("n > 1").count(), 1)) + 2
    sound = counts.where(F.col("pos") > 1).where(F.col("pos") > F.col("n") * rate).withColumn("s", surprise(F.col("pos"), F.col("n"), rate)).where(F.col("s") > need)
    gain = F.col("pos") * F.log(F.col("pos") / F.col("n") / rate)
    rows = sound.orderBy(gain.desc(), F.length("term").desc(), "term", "stem").collect()  # terms of the labelled sample
    words = {r["term"]: r["pos"] for r in rows if not r["stem"]}
    ordered = sorted(words)
    chosen: dict[str, bool] = {}
    heads: set[str] = set()
    for r in rows:
        term = r["term"]
        if term in heads or any(term[:k] in chosen for k in range(1, len(term) + 1)):
            continue
        if r["stem"]:
            # a stem that stands for one word becomes that word
            begin = bisect_left(ordered, term)
            main = max(takewhile(lambda w: w.startswith(term), (ordered[k] for k in range(begin, len(ordered)))), key=lambda w: (words[w], w), default=None)
            if main is not None and words[main] >= 0.8 * r["pos"]:
                term = main
        chosen[term] = r["stem"] and term == r["term"]
        heads.update(term[:k] for k in range(1, len(term)))
    return list(chosen.items())


def density(hits: int, words: int) -> int:
    """Class of the number of hits per thousand words, by powers of two."""
    return min(7, int(math.log2(1 + 1000 * hits / max(words, 30))))


class Finder(dict):
    """Word to its match, remembered up to a bound."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.lexicon = Lexicon(terms)

    def __missing__(self, word: str):
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        hit = self[word] = self.lexicon.match(word)
        return hit

    def hits(self, text: str) -> set[tuple[int, int, bool, int]]:
        """Distinct (term, edits, quoted, density class) of a text."""
        lower = text.lower()
        words = SPLIT.findall(lower)
        wanted = {w for w in set(words) if self[w] is not None}
        if not wanted:
            return set()
        found: Counter = Counter()
        for m in SPLIT.finditer(lower):
            if m[0] in wanted:
                found[*self[m[0]], quoted(lower, m.start(), m.end())] += 1
        return {(*hit, density(n, len(words))) for hit, n in found.items()}


def hit_counts(drawn: DataFrame, terms: list[tuple[str, bool]]) -> DataFrame:
    """(term, edits, quoted, dense, pos, n) over labelled documents; term -1: documents without any hit."""

    finder = Finder(terms)

    def per_batch(batch: pa.RecordBatch) -> dict:
        n: Counter = Counter()
        pos: Counter = Counter()
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            hits = finder.hits(text) or {(-1, 0, False, 0)}
            n.update(hits)
            if y:
                pos.update(hits)
        keys = list(n)
        return {"pos": [pos[k] for k in keys], "n": [n[k] for k in keys]} | {name: [k[i] for k in keys] for i, name in enumerate(("term", "edits", "quoted", "dense"))}

    counts = arrow_map(drawn, per_batch, "term int, edits int, quoted boolean, dense int, pos long, n long")
    return counts.groupBy("term", "edits", "quoted", "dense").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def odds(pos: float, neg: float, all_pos: float, all_neg: float) -> float:
    return math.log((pos + 0.5) / (all_pos + 1)) - math.log((neg + 0.5) / (all_neg + 1))


def weights(counts: list, all_pos: int, all_neg: int) -> tuple[dict, float]:
    """Weight of each (term, edits, quoted, density class) and of each (term, edits, quoted); log odds of a document without hits."""
    kind: Counter = Counter()
    kind_pos: Counter = Counter()
    hit: Counter = Counter()
    hit_pos: Counter = Counter()
    none = math.log((all_pos + 0.5) / (all_neg + 0.5))
    found = []
    for r in counts:
        if r["term"] < 0:
            none += odds(r["pos"], r["n"] - r["pos"], all_pos, all_neg)
            continue
        key = r["term"], r["edits"], r["quoted"]
        found.append((key, r["dense"], r["pos"], r["n"]))
        for total, k, v in ((kind, key[1:], r["n"]), (kind_pos, key[1:], r["pos"]), (hit, key, r["n"]), (hit_pos, key, r["pos"])):
            total[k] += v
    logit = lambda p: math.log(min(max(p, 1e-3), 1 - 1e-3) / (1 - min(max(p, 1e-3), 1 - 1e-3)))
    share = {k: (hit_pos[k] + 2 * (kind_pos[k[1:]] + 0.5) / (kind[k[1:]] + 1)) / (n + 2) for k, n in hit.items()}
    out = {k: logit(p) for k, p in share.items()}
    out |= {(*key, dense): logit((pos + 2 * share[key]) / (n + 2)) for key, dense, pos, n in found}
    return out, none


def scorer(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", rows: int = SAMPLE):
    """Learn from the labelled rows of `docs`; gives a function from `texts` columns to (doc_id, th, score)."""
    base = texts(docs)
    drawn = Stored(sample(base, labels, label, train(F.col("doc_id")), rows), "labelled_texts").df
    count, positive = drawn.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    found: list[tuple[str, bool]] = []
    table: dict = {}
    none = math.log(positive / (count - positive)) if 0 < positive < count else (-20.0 if not positive else 20.0)
    if 0 < positive < count:
        found = lexicon(Stored(term_counts(drawn), "term_counts").df, positive / count)
    if found:
        table, none = weights(hit_counts(drawn, found).collect(), positive, count - positive)  # at most 32 rows a term
    return base, found, table, none


def hit_weight(table: dict, term: int, edits: int, in_quotes: bool, dense: int) -> float:
    for key in ((term, edits, in_quotes, dense), (term, edits, in_quotes)):
        if key in table:
            return table[key]
    if in_quotes:
        return 0.5 * hit_weight(table, term, edits, False, dense)
    # a misspelling not met among the labelled rows: as its term, at half weight
    return 0.5 * table.get((term, 0, False), 0.0)


def rating(found: list[tuple[str, bool]], table: dict, none: float):
    """Text to (score, number of hits)."""
    finder = Finder(found)

    def rate(text: str | None) -> tuple[float, int]:
        hits = finder.hits(text or "") if found else ()
        # the strongest hit decides, further evidence adds to it
        each = sorted((hit_weight(table, *h) for h in hits), reverse=True)
        z = max(none, each[0] + 0.5 * sum(w for w in each[1:] if w > 0)) if each else none
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0))), len(hits)

    return rate


def score(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", rows: int = SAMPLE) -> DataFrame:
    """(doc_id, th, score, hits) per row; hits counts the terms found."""
    base, *model = scorer(docs, labels, train, label, rows)
    rate = rating(*model)

    def per_batch(batch: pa.RecordBatch) -> dict:
        rated = [rate(text) for text in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "score": [s for s, _ in rated], "hits": [n for _, n in rated]}

    return arrow_map(base, per_batch, "doc_id long, th long, score double, hits int")


def clean(docs: DataFrame, labels: DataFrame, train, most: float = 0.5, label: str = "toxic") -> DataFrame:
    """The rows scored under `most`, with all their columns; rows without an id are scored like others."""
    _, *model = scorer(docs, labels, train, label)
    rate = rating(*model)
    return rows_where(docs, lambda batch: [rate(text)[0] < most for text in batch.column("text").to_pylist()])
