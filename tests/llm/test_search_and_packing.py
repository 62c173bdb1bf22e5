"""Top-k, sharding, packing, decontamination and classifiers."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from basketry.llm import decontam, packing, quality, queries, sharding, topk, toxicity
from basketry.llm.automaton import Lexicon
from basketry.llm.common import table, tokenizer_path
from basketry.llm.labelled import remainder
from tests.llm.conftest import words


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=20)], 0, 1) for k in range(150)]
    rows += [(k, rows[7][1], 0, 1) for k in range(150, 190)]  # ties
    rows += [(200, None, 0, 1), (201, [1.0, None] * 10, 0, 1), (202, [float("nan")] * 20, 0, 1), (203, [float("inf")] * 20, 0, 1), (None, rows[0][1], 0, 1), (250, [0.5, 0.25], 0, 1), (251, [0.5, 0.5], 0, 1), (7, rows[7][1], 0, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, block int, score int")


def test_topk_against_brute_force(spark, monkeypatch):
    rows, df = vectors(spark)
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    fine = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in fine:
        if q % 50 == 0:
            best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.nearest(df, lambda v: v % 50 == 0).collect())) == sorted(want)
    assert topk.nearest(df.limit(0), lambda v: v % 50 == 0).collect() == []


def test_segment_bounds_hold():
    rng = np.random.default_rng(5)
    rows = rng.integers(-300, 300, (40, 37))
    for a in topk.statistics(rows):
        assert ((a @ a.T) + 1e-6 >= rows @ rows.T).all()


def test_sharding_law(messy, nothing, named):
    got = sharding.shard(messy, shards=7).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in named)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) <= set(range(7))
    assert sharding.shard(nothing).collect() == []
    assert max(r["shard"] for r in sharding.shard(messy.where("doc_id < 12"), shards=40).collect()) < 40


def test_sharding_keeps_groups_and_splits_a_hot_one(spark):
    rows = [(k, f"copy {k // 4}" if k < 400 else f"own {k}" if k < 1000 else "hot") for k in range(1500)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()}
    cut = sum(len({got[4 * g + j] for j in range(4)}) > 1 for g in range(100))
    assert cut <= 10  # at most one group at the edge of each shard
    hot = [got[k] for k in range(1000, 1500)]
    assert len(set(hot)) >= 4 and max(hot.count(s) for s in set(hot)) <= 150


def test_sharding_propagation_joins_what_the_start_parts(spark):
    for copies, others in ((300, 400), (800, 0)):
        rows = [(k, f"copy {k % (copies // 2)}") for k in range(copies)] + [(k, f"own {k}") for k in range(copies, copies + others)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        links = sharding.copies_links(docs.withColumnRenamed("text", "text_key")).localCheckpoint()
        cut = []
        for rounds in (0, 3):
            label = {r["node"]: r["label"] for r in sharding.propagate(links, len(rows), 10, rounds).collect()}
            cut.append(sum(label[r["u"]] != label[r["v"]] for r in links.collect()))
        assert cut[0] > 0.8 * copies // 2 and cut[1] <= cut[0] * 0.1
        placed = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, shards=10).collect()}
        assert sum(placed[r["u"]] != placed[r["v"]] for r in links.collect()) <= cut[1] + 10


def pieces_ok(pieces, named, window):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i in {i for i, _ in named}:
        want = sorted(tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 1]) for k, t in named if k == i)
        if len(want) == 1:
            ids, at = want[0], 0
            for p in sorted(by_doc[i], key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(ids)
        assert sum(p["length"] for p in by_doc[i]) == sum(map(len, want))
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at < window and not at & (at - 1)


@pytest.mark.parametrize("window", [64, 2048])
def test_packing_round_trip(messy, nothing, named, window):
    pieces_ok(packing.digest(packing.pack(messy, tokenizer_path(), window)).collect(), named, window)
    assert packing.digest(packing.pack(nothing, tokenizer_path())).collect() == []


def test_packing_prefers_lexical_neighbours():
    a, b = np.arange(100, 160, dtype=np.uint16), np.arange(300, 360, dtype=np.uint16)
    docs = [np.concatenate((x, [k])).astype(np.uint16) for k, x in enumerate((a, b, a, b, a, b))]
    index = packing.Index(docs, np.ones(65536), 61)
    first = next(packing.fill(docs, index, 183))
    assert len({k % 2 for k, _, _ in first}) == 1


def edited(rnd, item: bytes, most: int) -> bytes:
    out = bytearray(item)
    for _ in range(most):
        at = rnd.randrange(len(out))
        move = rnd.randrange(3)
        if move == 0:
            out[at] = rnd.choice(b"abcdefgh")
        elif move == 1:
            del out[at]
        else:
            out.insert(at, rnd.choice(b"abcdefgh"))
    return bytes(out)


def plain_distance(pattern: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for k, x in enumerate(pattern, 1):
        last, row = row, [k]
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_edit_distance_of_a_passage():
    rnd = random.Random(6)
    for _ in range(80):
        pattern = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 40)))
        text = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 60)))
        assert decontam.distance_within(pattern, text, 100) == plain_distance(pattern, text)


def test_leaks_reach_recall_and_are_exact(spark, messy, nothing):
    rnd = random.Random(7)
    items = [(k, " ".join(words(rnd, rnd.randint(12, 60)))) for k in range(40)] + [(50, "tiny item"), (51, ""), (52, None), (None, "x y z"), (53, "one of the small items here")]
    docs, planted = [], set()
    for k in range(300):
        body = words(rnd, 150)
        item = decontam.normal(items[k % 40][1])
        most = decontam.edits_allowed(len(item), decontam.RATE)
        passage = edited(rnd, item, most if k % 2 else 0).decode(errors="ignore")
        at = rnd.randrange(150)
        docs.append((k, " ".join([*body[:at], passage, *body[at:]]).upper(), 1))
        if decontam.distance_within(item, decontam.normal(docs[-1][1]), most) is not None:
            planted.add((k, k % 40))
    docs += [(1000 + k, " ".join(words(rnd, 300)), 1) for k in range(100)] + [(2000, None, 1), (2001, "", 1), (2002, "a TINY  item\nhere", 1), (None, items[0][1], 1)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, edits int"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.leaks(df, bench, block=25).collect()}
    assert len(planted & set(found)) >= 0.95 * len(planted)
    assert (2002, 50) in found and not any(d >= 1000 and d < 2000 for d, _ in found)
    sizes = {k: decontam.normal(t) for k, t in items if k is not None}
    by_id = {d: decontam.normal(t) for d, t, _ in docs if d is not None}
    for (d, k), edits in list(found.items())[:60]:
        assert edits <= decontam.edits_allowed(len(sizes[k]), decontam.RATE) or edits == 0
        assert plain_distance(sizes[k], by_id[d]) <= edits
    kept = decontam.clean(df, bench)
    assert kept.schema == df.schema
    assert {r["doc_id"] for r in kept.where("doc_id is not null").collect()} == {d for d in by_id if not any(d == x for x, _ in found)}
    assert decontam.leaks(nothing, bench).collect() == [] and decontam.leaks(df, bench.limit(0)).collect() == []


def test_leaks_in_text_without_blanks():
    rnd = random.Random(14)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    code = [*"abcdefghijklmnop(){}=;./_"]

    def running(letters, n):
        return "".join(rnd.choice(letters) for _ in range(n)).encode()

    def recall(letters, of, edits):
        items = [(k, running(letters, rnd.randint(of, 4 * of))) for k in range(30)]
        docs, planted = [], set()
        for k in range(120):
            item = items[k % 30][1]
            most = decontam.edits_allowed(len(item), decontam.RATE) if edits else 0
            docs.append(running(letters, 200) + edited(rnd, item, most) + running(letters, 150))
            planted.add((k, k % 30))
        found = decontam.Items(items, decontam.RATE).leaks([*docs, running(letters, 900)])
        assert set(found) <= planted
        return len(found) / len(planted)

    for letters, of in ((signs, 8), (code, 24)):
        assert recall(letters, of, False) == 1
        assert recall(letters, of, True) >= 0.95


def brute_match(terms, word):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for k, x in enumerate(a, 1):
            last, row = row, [k]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row

    best = None
    for term, stem in terms:
        row = edits(term, word)
        d = min(row) if stem else row[-1]
        if d == 0 or d == 1 and len(term) >= 5:
            best = d if best is None else min(best, d)
    return best


def test_automaton_finds_what_edit_distance_finds():
    rnd = random.Random(8)
    terms = [("idiot", False), ("trash", False), ("scum", False), ("lowei", True), ("vequ", True), ("worthless", False), ("tras", False)]
    lexicon = Lexicon(terms, states=40)
    for _ in range(4000):
        word = list(rnd.choice(terms)[0] + "".join(rnd.choice("aeiou") for _ in range(rnd.randint(0, 3))))
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randrange(len(word) + 1)
            word[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "s", "é"])
        word = "".join(word)
        hit = lexicon.match(word)
        assert (hit[1] if hit else None) == brute_match(terms, word), word


def test_quotation_is_seen():
    text = 'he said "you idiot" and left, idiot'
    at = text.index("idiot")
    assert toxicity.quoted(text, at, at + 5) and not toxicity.quoted(text, text.rindex("idiot"), len(text))
    table_ = {(0, 0, False): 4.0}
    assert toxicity.hit_weight(table_, 0, 0, True, 3) == 2.0 and toxicity.hit_weight(table_, 0, 1, False, 3) == 2.0


def test_every_sound_term_is_kept(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rnd = random.Random(15)
    names = sorted({"".join(rnd.choice(letters) for _ in range(12)) for _ in range(700)})
    counts = spark.createDataFrame([(n, False, 200, 200) for n in names] + [("plain", False, 100, 200)], "term string, stem boolean, pos long, n long")
    assert sorted(toxicity.lexicon(counts, 0.5)) == [(n, False) for n in names]


@pytest.mark.parametrize(("name", "label", "least"), [("op6_trie_toxicity", "toxic", 0.93), ("op10_neighbour_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    rows = got.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert got.count() == table(spark, sf, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == r[label] for r in rows) >= least * len(rows)


@pytest.mark.parametrize("scored", [quality.score, toxicity.score])
def test_classifiers_on_messy_rows(spark, messy, nothing, named, scored):
    train = lambda doc_id: remainder(doc_id, 3) != 1
    label = "quality" if scored is quality.score else "toxic"
    labels = spark.createDataFrame([(i, k % 2, k % 2, 0.0) for k, (i, _) in enumerate(named)] + [(None, 1, 1, 0.0), (9999, 1, 0, 0.0), (7, None, None, 0.0)], "doc_id long, quality int, toxic int, score double")
    got = scored(messy, labels, train, label).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in named) and all(0 <= r["score"] <= 1 for r in got)
    assert scored(nothing, labels, train, label).collect() == []
    assert len(scored(messy, labels.limit(0), train, label).collect()) == len(named)


def test_short_items_within_their_edits():
    """Items under the shortest walk are found with as many edits as their length allows, wherever they stand."""
    items = [(1, b"capital of france?"), (2, b"ab cd"), (3, b"one two three four five")]
    held = decontam.Items(items, 0.06)
    docs = [b"the capitel of france? xx", b"capital of francs", b"so capital of frnce? it is", b"ab cd", b"ab ce", b"", b"capital of frnxe!", b"one two threee four five", b"capital of " * 500]
    want = {}
    for d, text in enumerate(docs):
        for k, (_, item) in enumerate(items):
            most = decontam.edits_allowed(len(item), 0.06)
            row = [0] * (len(text) + 1)
            for a, x in enumerate(item, 1):
                before, row = row, [a]
                for b, y in enumerate(text, 1):
                    row.append(min(before[b] + 1, row[b - 1] + 1, before[b - 1] + (x != y)))
            if min(row) <= most:
                want[d, k] = min(row)
    assert held.leaks(docs) == want
    assert want[0, 0] == 1 and want[2, 0] == 1 and want[7, 2] == 1 and want[3, 1] == 0 and (4, 1) not in want


def test_words_are_remembered_without_the_signs_beside_them(monkeypatch):
    encoder = packing.Encoder(tokenizer_path())
    encoder.encode("alpha beta, alpha. beta\nalpha, beta.")
    assert set(encoder) == {"alpha", " alpha", " beta", ",", ".", "\n"}
    monkeypatch.setattr(packing, "UNITS_KEPT", 4)
    encoder = packing.Encoder(tokenizer_path())
    encoder.encode("a b c d e")
    assert list(encoder) == ["a", " b", " e"]


def test_units_give_the_ids_of_the_library():
    encoder = packing.Encoder(tokenizer_path())
    parts = ["a", "the", "é", "1", "²", "一", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\0", ".", ",", "...", "'", "'s", "_", "-", "ʰ", "😀"]
    draw = random.Random(3)
    for _ in range(5000):
        text = "".join(draw.choices(parts, k=draw.randint(0, 9)))
        assert np.frombuffer(encoder.encode(text), encoder.kind).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
