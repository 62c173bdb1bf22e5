"""Byte, word, line and near-duplicate operators against brute force on messy rows."""

import hashlib
import time
from collections import Counter

import numpy as np
import pytest

from basketry.llm import lines, minhash, substring, suffix
from basketry.llm.common import texts, unions, window_min
from basketry.llm.induced import suffix_order


def runs(gone) -> int:
    return sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("k", [64, 400])
def test_repeated_bytes(messy, nothing, named, k):
    count: Counter = Counter()
    for _, text in named:
        b = text.encode()
        count.update(b[s : s + k] for s in range(len(b) - k + 1))
    want = []
    for i, text in named:
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - k + 1):
            if count[b[s : s + k]] > 1:
                gone[s : s + k] = b"\1" * k
        want.append((i, len(b), sum(gone), runs(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert rows(suffix.kept_bytes(suffix.repeated_bytes(messy, k))) == sorted(want)
    assert rows(suffix.kept_bytes(suffix.repeated_bytes(nothing, k))) == []


def test_repeated_words(messy, nothing, named):
    k, first = 50, {}
    for i, text in named:
        w = text.encode().split()
        for s in range(len(w) - k + 1):
            first[tuple(w[s : s + k])] = min(i, first.get(tuple(w[s : s + k]), i))
    want = []
    for i, text in named:
        w = text.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < i:
                gone[s : s + k] = [True] * k
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    assert rows(substring.kept_words(substring.repeated_passages(messy))) == sorted(want)
    assert rows(substring.kept_words(substring.repeated_passages(nothing))) == []


def test_near_duplicates(messy, nothing, named):
    sets = []
    for _, text in named:
        w = text.encode().lower().split()
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = {i: i for i, _ in named}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(named)):
        for b in range(a):
            same, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if same and 100 * same >= 75 * union:
                low, high = sorted((find(named[a][0]), find(named[b][0])))
                root[high] = low
    want = sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(named, sets, strict=True))
    assert rows(minhash.near_duplicates(messy)) == want
    assert rows(minhash.near_duplicates(nothing)) == []
    kept = {i for i, _, _, k in want if k}
    cleaned = minhash.clean(messy)
    assert cleaned.columns == messy.columns
    assert sorted(r["doc_id"] for r in cleaned.where("doc_id is not null").collect()) == sorted(i for i, _ in named if i in kept)
    assert cleaned.where("doc_id is null").count() == 2


def test_near_duplicates_in_a_template_family(spark, monkeypatch):
    """Documents with a common part just under the limit fill the buckets; few pairs of them are links."""
    monkeypatch.setattr(minhash, "CHUNK", 64, raising=False)  # the buckets are dealt in several tiles
    rnd = np.random.default_rng(12)
    common, own = 200, 34
    docs = []
    for k in range(300):
        docs.append([f"t{w}" for w in range(common)] + [f"d{k}w{w}" for w in range(own)])
    for k in range(0, 12, 2):
        docs[k + 1] = docs[k][: common + 2] + docs[k + 1][common + 2 :]
    ids = [int(x) for x in rnd.permutation(300)]
    sets = [{tuple(d[k : k + 5]) for k in range(len(d) - 4)} for d in docs]
    root = {i: i for i in ids}
    for a in range(300):
        for b in range(a):
            same, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 100 * same >= 75 * union:
                assert a // 2 == b // 2 and a < 12
                root[ids[a]] = root[ids[b]] = min(ids[a], ids[b])
    assert sum(i != r for i, r in root.items()) == 6
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in zip(ids, docs, strict=True)], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == root


@pytest.mark.parametrize("blocks", [9, 12])
def test_near_duplicates_made_of_common_passages(spark, monkeypatch, blocks):
    """Sets that hold almost only shingles of many other sets: the common parts decide, by which passages they are made of."""
    monkeypatch.setattr(minhash, "CHUNK", 16)
    rnd = np.random.default_rng(blocks)
    pool = [[f"b{b}w{w}" for w in range(25)] for b in range(14)]
    docs = [sum((pool[b] for b in sorted(rnd.choice(14, blocks, replace=False))), []) + [f"d{k}"] for k in range(160)]
    ids = [int(x) for x in rnd.permutation(160)]
    sets = [{tuple(d[k : k + 5]) for k in range(len(d) - 4)} for d in docs]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(160):
        for b in range(a):
            same, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 100 * same >= 75 * union:
                low, high = sorted((find(ids[a]), find(ids[b])))
                root[high] = low
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in zip(ids, docs, strict=True)], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {i: find(i) for i in ids}


def test_links_of_open_buckets(spark, monkeypatch):
    """One bucket of many components: all links are found, by rare shingles or in tiles, without the rounds before."""
    monkeypatch.setattr(minhash, "CHUNK", 8)
    rnd = np.random.default_rng(3)
    pool = [[f"b{b}w{w}" for w in range(25)] for b in range(13)]
    docs = [sum((pool[b] for b in sorted(rnd.choice(13, 11, replace=False))), []) + [f"d{k}w{w}" for w in range(int(rnd.integers(0, 30)))] for k in range(60)]
    docs += [[f"e{k // 2}w{w}" for w in range(100 + k % 2 * 8)] for k in range(20)]
    sets = [{tuple(d[k : k + 5]) for k in range(len(d) - 4)} for d in docs]
    want = {(a, b) for a in range(80) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    base = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    packed = minhash.pack(base)
    bucket = packed.selectExpr("1L as key", "node", "node as component")
    sets_held = minhash.Stored(minhash.open_sets(bucket, packed).df, "sets").df
    ordered = minhash.Stored(minhash.ordered_parts(sets_held), "ordered").df
    none = spark.createDataFrame([], "a long, c long")
    rare = {tuple(r) for r in minhash.rare_links(ordered, packed, none).collect()}
    assert rare <= want and {(k + 1, k) for k in range(60, 80, 2)} <= rare
    parts = {r["node"]: r["k"] for r in ordered.collect()}
    needs_rare = {(a, b) for a, b in want if min(parts[a], parts[b]) * 175 < (len(sets[a]) + len(sets[b])) * 75}
    assert needs_rare <= rare
    mates = minhash.ordered_parts(sets_held).where("k * 100 >= s.n * 75").count()
    assert mates >= 30 and want - needs_rare


def test_line_dedup_of_a_very_long_text(spark):
    """A text of 40,000 lines is split once, not once per line kept; only its copied block of lines goes."""
    own = [f"line {k} of the long text" for k in range(40_000)]
    block = [f"shared line {k} of both" for k in range(3)]
    df = spark.createDataFrame([(1, "\n".join(["short head", *block])), (2, "\n".join(own[:20_000] + block + own[20_000:]))], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: (r["kept_text"], r["n_removed"], r["n_runs"]) for r in lines.dedup(df).collect()}
    assert got[2] == ("\n".join(own), 3, 1)
    assert got[1] == ("\n".join(["short head", *block]), 0, 0)
    assert {r["doc_id"]: r["text"] for r in lines.clean(df).collect()}[2] == "\n".join(own)
    assert time.monotonic() - began < 60  # splitting again per line took more than 90 seconds for one of the two


def brute_lines(named, min_lines, long_line):
    """Rows equal in id and text are one document; order of (id, hash of the text, line)."""
    docs = {}
    for i, text, th in named:
        docs[i, th] = [(p, x) for p, x in enumerate(text.split("\n")) if x.strip(" \t\n\x0b\f\r")]
    first: dict = {}
    for key in sorted(docs):
        seq = [x for _, x in docs[key]]
        for depth in (1, min_lines):
            for s in range(len(seq) - depth + 1):
                first.setdefault((depth, *seq[s : s + depth]), (key, s))
    out = {}
    for key, full in docs.items():
        seq, gone = [x for _, x in full], set()
        for s in range(len(seq)):
            if len(seq[s]) >= long_line and first[1, seq[s]] != (key, s):
                gone.add(s)
            if s + min_lines <= len(seq) and first[(min_lines, *seq[s : s + min_lines])] != (key, s):
                gone.update(range(s, s + min_lines))
        out[key] = ({full[s][0] for s in gone}, len(seq), sum(1 for s in gone if s - 1 not in gone))
    return out


@pytest.mark.parametrize(("min_lines", "long_line"), [(2, 40), (3, 10_000), (1, 0)])
def test_line_dedup(spark, messy, nothing, min_lines, long_line):
    # ids that repeat with different texts are ordered by the hash of the text, which Spark computes
    named = [(r["doc_id"], r["text"], r["th"]) for r in texts(messy).collect()]
    brute = brute_lines(named, min_lines, long_line)
    want = []
    for i, text, th in named:
        gone, n, begins = brute[i, th]
        kept = "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)
        want.append((i, n, len(gone), begins, hashlib.sha256(kept.encode()).hexdigest()))
    assert rows(lines.digest(lines.dedup(messy, min_lines, long_line))) == sorted(want)
    assert rows(lines.digest(lines.dedup(nothing, min_lines, long_line))) == []


def test_clean_lines_keeps_columns_and_drops_the_emptied(messy):
    cleaned = lines.clean(messy)
    assert cleaned.schema == messy.schema
    got = cleaned.collect()
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got)
    assert sum(r["doc_id"] is None for r in got) == 2
    assert {r["doc_id"] for r in got} >= {60, 61, 62}
    assert 2 not in {r["doc_id"] for r in got}  # a copy of document 1, nothing is left


def test_suffix_order_and_common_prefixes_against_sorting():
    rng = np.random.default_rng(1)
    for trial in range(60):
        base = rng.integers(1, rng.integers(2, 5), 50)
        pieces = []
        for _ in range(rng.integers(1, 5)):
            pieces += [rng.integers(1, 4, rng.integers(1, 30)), base[rng.integers(0, 49) :], [0]]
        text = np.concatenate(pieces).astype(np.uint16)
        plain = text.tolist()
        for depth in (9, 10_000):
            place, lcp = suffix_order(text, depth, limit=500)  # a limit that makes the queues write blocks out
            assert sorted(place.tolist()) == list(range(len(plain)))
            cut = [plain[p : p + depth] for p in place]
            assert cut == sorted(plain[p : p + depth] for p in range(len(plain))), trial
            common = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(cut, cut[1:], strict=False)]
            assert lcp.tolist() == common, trial


def test_window_minimum_and_unions():
    values = np.random.default_rng(2).integers(0, 1000, 500).astype(np.uint64)
    for w in (1, 7, 41, 500):
        assert window_min(values, w).tolist() == [values[k : k + w].min() for k in range(500 - w + 1)]
    assert len(window_min(values, 501)) == 0
    assert unions(np.array([5, 0, 2, 9]), np.array([7, 2, 4, 9])) == [(0, 4), (5, 7)]


def test_pairs_at_the_limit_share_a_bucket():
    rnd = np.random.default_rng(3)
    for n in (5, 9, 20, 60, 120, 127, 168, 169, 300):
        for _ in range(60):
            pool = rnd.permutation(np.unique(rnd.integers(0, 2**63, 3 * n).astype(np.uint64)))
            same = -(-150 * n // 175)  # of n and n shingles: 100 * same >= 75 * (2 * n - same)
            a, b = np.sort(pool[:n]), np.sort(pool[n - same : 2 * n - same])
            assert np.intersect1d(minhash.keys(a), minhash.keys(b)).size
