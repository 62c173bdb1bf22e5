"""Embedding join, tokenizer alignment and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from basketry.llm import alignment, gridjoin, search
from basketry.llm.common import tokenizer_path
from basketry.llm.packing import byte_letters
from basketry.llm.queries import ORACLE, QUERIES
from tests.llm.conftest import messy_rows, words
from verify.check import compare, oracle_connection

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_statements(spark, name):
    sf = "/root/testdata/sf0.001"
    ok, note = compare(spark, oracle_connection(sf), name, sf, QUERIES[name], ORACLE[name])
    assert ok, note


# embedding join


def near(base, angle, rng):
    """A vector at a given angle from another."""
    side = rng.normal(size=len(base))
    side -= base * (side @ base) / (base @ base)
    return math.cos(angle) * base / np.linalg.norm(base) + math.sin(angle) * side / np.linalg.norm(side)


def vector_rows():
    """Clusters, a chain, a hot tight group, equal vectors, both sides of the limit, and what takes no part."""
    rng = np.random.default_rng(8)
    rows = [(k, int(rng.integers(0, 3)), rng.normal(size=12).tolist()) for k in range(120)]
    for c in range(12):
        base = rng.normal(size=12)
        rows += [(200 + 10 * c + j, c % 3, (near(base, 0.25, rng) * (j + 1)).tolist()) for j in range(6)]
    step = rng.normal(size=12)
    for j in range(8):  # a chain: only neighbours are linked
        rows.append((400 + j, 1, step.tolist()))
        step = near(step, 0.33, rng)
    hot = rng.normal(size=12)
    rows += [(1000 + j, 2, near(hot, 0.05, rng).tolist()) for j in range(150)]
    rows += [(1200 + j, 2, hot.tolist()) for j in range(60)] + [(1300, 1, hot.tolist()), (1301, None, hot.tolist())]
    flat = np.zeros(12)
    flat[0] = 1.0
    rows += [(1400, 0, flat.tolist()), (1401, 0, near(flat, math.acos(0.9301), rng).tolist()), (1402, 0, near(flat, math.acos(0.9299), rng).tolist())]
    rows += [(1500, 0, None), (1501, 0, []), (1502, 0, [0.0] * 12), (1503, 0, [1.0, None] + [0.0] * 10), (1504, 0, [float("nan")] * 12), (1505, 0, [float("inf")] * 12)]
    rows += [(1506, 0, [1.0] * 5), (1507, 0, [2.0] * 5), (1508, 0, [-0.0] * 4 + [1.0]), (1509, 0, [0.0] * 4 + [3.0]), (None, 2, hot.tolist()), (1600, 0, [1e200] * 12), (1601, 0, [1e-200] * 12)]
    rows += [(1000, 2, rows[3][2]), (1000, 2, rows[3][2])]  # one id, other vectors
    return rows


def brute_links(rows, cosine):
    fine = [i is not None and lab is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, lab, v in rows]
    scaled = [np.array(v) / max(map(abs, v)) if ok else None for (_, _, v), ok in zip(rows, fine)]
    links = defaultdict(set)
    for x in range(len(rows)):
        for y in range(x):
            if fine[x] and fine[y] and rows[x][1] == rows[y][1] and len(rows[x][2]) == len(rows[y][2]):
                a, b = scaled[x], scaled[y]
                if float(a @ b) / (float(np.linalg.norm(a)) * float(np.linalg.norm(b))) >= cosine:
                    links[x].add(y)
                    links[y].add(x)
    out = []
    for x, (i, _, _) in enumerate(rows):
        if i is None:
            continue
        seen, todo = {x}, [x]
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        least = min(rows[y][0] for y in seen)
        out.append((i, len(links[x]), least, least == i))
    return sorted(out)


@pytest.mark.parametrize("block,leaf", [(1024, 64), (24, 4)])
def test_grid_join_against_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(gridjoin, "BLOCK", block)
    monkeypatch.setattr(gridjoin, "LEAF", leaf)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, label int, embedding array<double>, node int, times string").repartition(3)
    assert sorted(map(tuple, gridjoin.near_duplicates(df).collect())) == brute_links(rows, 0.93)
    assert gridjoin.near_duplicates(df.limit(0)).collect() == []


def test_grid_join_of_floats_without_links_and_other_limit(spark):
    rows = [(k, 1, np.eye(6)[k % 6].tolist()) for k in range(6)] + [(9, 1, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>")
    assert {r["n_links"] for r in gridjoin.near_duplicates(df).collect()} == {0}
    assert sorted(map(tuple, gridjoin.near_duplicates(df, 0.7).collect())) == brute_links(rows, 0.7)


def test_grid_join_skips_and_counts_whole_intervals(monkeypatch):
    rng = np.random.default_rng(3)
    hot, far = rng.normal(size=16), rng.normal(size=16)
    tight = np.array([near(hot, 0.02, rng) for _ in range(256)])
    other = np.array([near(-hot, 0.02, rng) for _ in range(256)])
    side = lambda first, rows: (np.arange(first, first + len(rows)), np.ones(len(rows), np.int64), rows)
    axes = {16: np.linalg.svd(np.vstack([tight, other]), full_matrices=False)[2][: gridjoin.LEADING].T}
    one = gridjoin.Pair([side(0, tight)], axes, 0.93)
    node, links, root = one.run()
    assert one.compared == 0 and one.whole >= 1 and (links == 255).all() and set(root) == {0} and len(node) == 256
    two = gridjoin.Pair([side(0, tight), side(256, other)], axes, 0.93)
    assert len(two.run()[0]) == 0 and two.compared == 0 and two.skipped == 1
    assert far.shape == (16,)


# tokenizer alignment


def brute_alignment(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {chr(c): k for k, c in byte_letters().items()}
    linked, counts = [], Counter()
    for text in texts:
        whole = b" " + (text or "").encode()
        a_ids, b_ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        a_raw = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
        b_raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not text or b"".join(a_raw) != whole or b"".join(b_raw) != whole:
            linked.append(None)
            continue
        spans = []
        for raw in (a_raw, b_raw):
            ends = np.cumsum([len(x) for x in raw]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends)))
        links = []
        j0 = 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((a_ids[i], b_ids[j]))
                j += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for cut in cuts:
            i2 = next(k for k in range(i, len(a_ids)) if spans[0][k][1] == cut) + 1
            j2 = next(k for k in range(j, len(b_ids)) if spans[1][k][1] == cut) + 1
            groups.append(",".join(map(str, a_ids[i:i2])) + "|" + ",".join(map(str, b_ids[j:j2])))
            i, j = i2, j2
        counts.update(set(links))
        linked.append((len(a_ids), len(b_ids), groups, links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for one in linked:
        if one is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = one
        best = sum(counts[p] == most[p[0]] for p in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD = [
    " leading and  double   blanks ", "tabs\t and\n lines\n \n\n end\r\n", "a \n b \t c", "日本語のテキスト 🙂🙃 と 中文", "ＡＢ　Ｃ ▁x", "plain ▁", "▁",
    "it's we'll  they'd 12 345 6a7b", "<|endoftext|> <s> </s> <unk> <0x41>", "é ́x   y  z", "a\x00b \x1c c\x1f d", "x" * 3000, "\U00010330\U0001f9ff word \U00010330", "\n", " ", "one",
]


@pytest.mark.parametrize("head", [1_000_000, 40, 0])
def test_alignment_against_brute_force(spark, messy, nothing, named, head):
    rnd = random.Random(2)
    mixed = [" ".join(rnd.choice([*words(rnd, 1), rnd.choice(ODD)[:40], "\n", "", "é" * 3]) for _ in range(60)) for _ in range(40)]
    rows = named + [(100 + k, t) for k, t in enumerate(ODD + mixed)]
    extra = spark.createDataFrame([(i, t, 5) for i, t in rows[len(named) :]], "doc_id long, text string, row int")
    docs = messy.select("doc_id", "text", messy.node.alias("row")).unionByName(extra)
    got = sorted(tuple(r) for r in alignment.align(docs, A, B, head).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(rows, brute_alignment([t for _, t in rows])))
    assert alignment.align(nothing, A, B).collect() == []


def test_refined_spans():
    spans = [np.array(x) for x in ([0, 1, 1, 4], [1, 4, 4, 6], [1, 1, 2, 2])]
    assert alignment.refined(*spans).tolist() == [1, 2, 4, 6]


def test_remembered_chunks_do_not_change_a_document(monkeypatch):
    monkeypatch.setattr(alignment, "CHARS_KEPT", 5)
    small, plain = alignment.Aligner(A, B), alignment.Aligner(A, B)
    plain.local = False
    texts = ["one two three four five six seven one two", "two three eight nine ten eleven", "one  two", "", "▁ one"]
    for _ in range(2):
        for x, y in zip(small.documents(texts), plain.documents(texts), strict=True):
            assert (x is None) == (y is None)
            if x:
                assert x[:5] == y[:5] and (x[5] == y[5]).all() and (x[6] == y[6]).all()


def test_a_token_over_two_chunks_is_seen(monkeypatch):
    aligner = alignment.Aligner(A, B)
    monkeypatch.setattr(aligner, "spans_b", lambda text: ([5], np.array([1 + len(text.encode())])))
    assert aligner.align(["one", "two"]) is None


# ranked search


def brute_ranks(docs, items, k):
    pattern = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    held = [(i, Counter(pattern.findall((t or "").translate(lower)))) for i, t in docs if i is not None]
    held = [(i, c) for i, c in held if c]
    total, n = sum(sum(c.values()) for _, c in held), len(held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(pattern.findall((t or "").translate(lower)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def item_rows():
    rnd = random.Random(5)
    docs = [t for _, t, *_ in messy_rows() if t]
    items = [(k, " ".join(rnd.choice(docs).split()[3 : 3 + rnd.randint(1, 40)]) + " ABC x") for k in range(30)]
    return items + [(40, None), (41, ""), (42, "?!"), (None, "one two"), (43, "one TWO"), (43, "three"), (43, "one two"), (44, "unheard-of_wordings"), (45, "é ÉÉ hé"), (46, "abc")]


@pytest.mark.parametrize("postings,item_bytes,k", [(8_000_000, 8 << 20, 50), (30, 400, 3), (30, 8 << 20, 1)])
def test_search_against_brute_force(spark, messy, nothing, monkeypatch, postings, item_bytes, k):
    monkeypatch.setattr(search, "POSTINGS", postings)
    monkeypatch.setattr(search, "ITEM_BYTES", item_bytes)
    items = spark.createDataFrame([(*r, 3, 4) for r in item_rows()], "item_id long, text string, rank int, score int")
    got = sorted(map(tuple, search.rank(messy, items, k).collect()))
    assert got == brute_ranks([(r[0], r[1]) for r in messy_rows()], item_rows(), k)
    assert search.rank(nothing, items, k).collect() == [] and search.rank(messy, items.limit(0), k).collect() == []


def test_search_stops_making_accumulators():
    rng = np.random.default_rng(6)
    n = 2000
    rare = [np.append(np.arange(1, 20), 0) if d < 60 else np.array([0]) for d in range(n)]
    ids, lengths = np.arange(n), np.full(n, 100)
    term, count = np.concatenate(rare), np.array([len(x) for x in rare])
    index = search.Postings((lengths, count), term.astype(np.int32), rng.integers(1, 4, len(term)), np.array([3] + [900] * 19))
    query = np.array([*range(1, 20), 0])
    found, score = index.best(query, 50, ids)
    assert index.made == 60 and len(found) == 50  # term 0 is in all documents and made no accumulator
    every = np.zeros(n, np.int64)
    np.add.at(every, index.doc, index.impact)
    want = np.lexsort((ids, -every))[:50]
    assert (found == want).all() and (score == every[want]).all()
