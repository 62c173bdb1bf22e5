"""Near-duplicate groups: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document's set holds its distinct 5-word shingles (A-Z lower-cased, words between ASCII white space); a shorter document is
one shingle. Documents whose sets overlap by 75 % or more (intersection over union) are linked; groups are connected components.

* Rows with equal sets are folded first; only one id per set goes on, so a hot group of copies is a single node.
* One hash per shingle; its high bits pick one of 126 bins, each bin keeps its minimum. An empty bin borrows from bins drawn
  by a hash of its own number until one is full, the same draw in every document.
* 42 bands of 3 bins: a pair at 0.75 shares no band with probability under 1e-6. Sets with fewer shingles than bins fill few of them, and
  their bands depend on each other: sets of up to 126 shingles, and those up to 168 that they can match, use three
  permutations of their own with 31 bands of 4 bins each. (A prefix filter cannot miss a pair, but here it puts all documents
  with one common passage into the same buckets.)
* Star-shaped candidates: every member of a bucket meets the bucket's smallest id; of its centres a document tries the smallest first,
  so a group of any size costs a pair per member. Pairs that cannot link by size, or by one bit of each minimum (which misses less
  than one pair at the limit in a million), are left out; the others are confirmed on full sets.
* Buckets that still hold several components go on in rounds: what is outside the largest component of a bucket meets a member of that
  component and one of the rest, other ones each round, until a round links nothing new. Pairs stay linear in the members.
* Then every pair of two components that still shares a bucket is tested or ruled out. Shingles held by more than `CHUNK` members of such
  buckets are common. A pair that needs a rare shingle is found by joining the members on their rarest shingles, whose groups are of at
  most `CHUNK`. Pairs for which the common parts may suffice are left to tiles: members of which at least 3/4 is common are dealt
  in pairs of chunks of their bucket, and tested where both common parts are large enough. Members of the largest component are not set
  against each other.

Defined results: null or empty text or no words: empty set, linked with nothing, kept; rows of one id are one document to the
links (each row keeps its own n_shingles); rows without an id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Stored, WordHash, arrow_map, arrow_schema, gram_hash, mix, ragged, record_batch, signed, texts
from basketry.llm.components import components

SHINGLE = 5
BANDS, ROWS = 42, 3
BINS = BANDS * ROWS
SMALL, SMALL_ROWS = BINS * 4 // 3, 4
BITS_APART = 36
PERCENT = 75
CHUNK = 256


def shingles(text: bytes, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    if len(h) < SHINGLE:
        # the whole sequence is one shingle; its length keeps it apart from the others
        return gram_hash(np.append(h, np.uint64(len(h))), len(h) + 1)
    return np.unique(gram_hash(h, SHINGLE))


def draws() -> np.ndarray:
    """For each bin the order in which it looks at other bins when it is empty."""
    seeds = mix(np.arange(1, BINS * 64 + 1, dtype=np.uint64)).reshape(BINS, 64)
    return (seeds % np.uint64(BINS)).astype(np.int64)


DRAWS = draws()


def signature(values: np.ndarray) -> np.ndarray:
    """Minimum per bin, empty bins densified; values are sorted and not empty."""
    scaled = (values >> np.uint64(32)) * np.uint64(BINS)
    which = (scaled >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
    full = np.zeros(BINS, bool)
    full[which[first]] = True
    out = np.zeros(BINS, np.uint64)
    out[which[first]] = values[first]
    empty = np.flatnonzero(~full)
    for turn in range(DRAWS.shape[1]):
        if not len(empty):
            return out
        source = DRAWS[empty, turn]
        ok = full[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
    out[empty] = values[0]
    return out


def band_keys(bins: np.ndarray, bands: int, rows: int, salt: int) -> np.ndarray:
    """One key per band of neighbouring bins."""
    key = mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(salt << 32))
    for r in range(rows):
        key = mix(key ^ bins[r : bands * rows : rows]) + np.uint64(r)
    return key


def placed_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of a set, one place per band of any kind, and which places are used."""
    few = BINS // SMALL_ROWS
    out = np.zeros(BANDS + 3 * few, np.uint64)
    used = np.zeros(len(out), bool)
    if len(values) > BINS:
        out[:BANDS] = band_keys(signature(values), BANDS, ROWS, 0)
        used[:BANDS] = True
    if len(values) <= SMALL:
        for turn in (1, 2, 3):
            again = np.sort(mix(values ^ np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)))
            out[BANDS + (turn - 1) * few : BANDS + turn * few] = band_keys(signature(again), few, SMALL_ROWS, turn)
        used[BANDS:] = True
    return out, used


def keys(values: np.ndarray) -> np.ndarray:
    """Bucket keys of a set."""
    out, used = placed_keys(values)
    return np.unique(out[used])


BIT_SALTS = mix(np.arange(1, BINS + 1, dtype=np.uint64) + np.uint64(7 << 40))


def bits(values: np.ndarray) -> tuple[int, int]:
    """One bit of the minimum per bin, in two words; small sets take the minimum under as many hash functions instead."""
    if len(values) > SMALL:
        low = signature(values) & np.uint64(1)
    else:
        low = mix(values[None, :] ^ BIT_SALTS[:, None]).min(axis=1) >> np.uint64(7) & np.uint64(1)
    packed = np.packbits(np.append(low, [0, 0]).astype(np.uint8)).view(np.int64)
    return int(packed[0]), int(packed[1])


SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, b1 long, b2 long, keys array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, hash of the whole set and bucket keys per row of `texts`."""
    hashes = WordHash()

    def per_batch(batch: pa.RecordBatch) -> dict:
        size, h1, h2, key, low = [], [], [], [], []
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            values = shingles(text, hashes)
            size.append(len(values))
            whole = xxhash.xxh3_128_intdigest(values.tobytes()) if len(values) else 0
            h1.append(whole >> 64)
            h2.append(whole & (2**64 - 1))
            key.append(signed(keys(values)) if len(values) else np.zeros(0, np.int64))
            low.append(bits(values) if len(values) else (0, 0))
        return {"doc_id": batch.column("doc_id"), "n_shingles": size, "b1": [a for a, _ in low], "b2": [b for _, b in low], "h1": signed(np.array(h1, np.uint64)), "h2": signed(np.array(h2, np.uint64)), "keys": ragged(key, pa.int64())}

    return arrow_map(docs.select("doc_id", "text"), per_batch, SIGNED)


def confirmed(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (a, c) of which 100 * intersection >= 75 * union on full sets."""
    side = packed.select(F.col("node").alias("a"), F.col("z").alias("za"))
    other = packed.select(F.col("node").alias("c"), F.col("z").alias("zc"))
    both = pairs.join(side, "a").join(other, "c")

    def per_batch(batch: pa.RecordBatch) -> dict:
        hashes, unpack = WordHash(), zstandard.ZstdDecompressor()
        out: dict = {"a": [], "c": []}
        last, centre = None, np.zeros(0, np.uint64)
        for a, c, za, zc in zip(*(batch.column(x).to_pylist() for x in ("a", "c", "za", "zc")), strict=True):
            if zc != last:
                last, centre = zc, shingles(unpack.decompress(zc), hashes)
            mine = shingles(unpack.decompress(za), hashes)
            place = np.searchsorted(centre, mine)
            place[place == len(centre)] = 0
            same = int((centre[place] == mine).sum())
            if 100 * same >= PERCENT * (len(mine) + len(centre) - same):
                out["a"].append(a)
                out["c"].append(c)
        return out

    return arrow_map(both, per_batch, "a long, c long").distinct()


def pack(docs: DataFrame) -> DataFrame:
    """(node, z): compressed texts, so that pairs are light to move."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        pressed = zstandard.ZstdCompressor(level=3)
        return {"node": batch.column("doc_id"), "z": [pressed.compress(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]}

    return arrow_map(docs.select("doc_id", "text"), per_batch, "node long, z binary")


def may_link(a: str, b: str):
    """Whether two sets can be linked, by their sizes and bits.

    Of 126 bits a pair at 0.75 differs in 16 on average, in more than `BITS_APART` with probability under 1e-6; a pair at 0.3 in 44.
    """
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    apart = F.bit_count(F.col(f"{a}.b1").bitwiseXOR(F.col(f"{b}.b1"))) + F.bit_count(F.col(f"{a}.b2").bitwiseXOR(F.col(f"{b}.b2")))
    told_apart = ((large <= SMALL) | (small > SMALL)) & (apart > BITS_APART)
    return (small * 100 >= large * PERCENT) & ~told_apart


def open_sets(open_buckets: DataFrame, packed: DataFrame) -> Stored:
    """(node, component, s, hs): the whole set of every member of an open bucket, once, with its size and bits."""

    def per_batch(batch: pa.RecordBatch) -> dict:
        hashes, unpack = WordHash(), zstandard.ZstdDecompressor()
        sets = [shingles(unpack.decompress(z), hashes) for z in batch.column("z").to_pylist()]
        low = [bits(x) for x in sets]
        return {"node": batch.column("node"), "component": batch.column("component"), "n": [len(x) for x in sets], "b1": [a for a, _ in low], "b2": [b for _, b in low], "hs": ragged([signed(x) for x in sets], pa.int64())}

    nodes = open_buckets.select("node", "component").distinct().join(packed, "node")
    rows = arrow_map(nodes, per_batch, "node long, component long, n long, b1 long, b2 long, hs array<long>")
    return Stored(rows.select("node", "component", F.struct("n", "b1", "b2").alias("s"), "hs"), "open_sets")


def ordered_parts(sets: DataFrame) -> DataFrame:
    """(node, component, s, k, rare): size k of the common part of a set and the rare shingles that links of it must touch.

    A shingle is common if more than `CHUNK` sets hold it. Two linked sets share at least 3/4 of the larger one, so what the smaller common part
    cannot supply lies in the rare parts; then both hold one of the other's first n / 4 + 1 rare shingles in order of frequency
    (the prefix lemma). Shingles held once count among these, but meet nothing; so do those of one component.
    """
    each = sets.select("node", "component", "s", F.explode("hs").alias("h"))
    held = each.groupBy("h").agg(F.count("*").alias("c"), (F.min("component") < F.max("component")).alias("crosses")).where("c > 1")
    own = each.join(held, "h").groupBy("node", "component", "s").agg(
        F.count_if(F.col("c") > CHUNK).alias("k"),
        F.sort_array(F.collect_list(F.when(F.col("c") <= CHUNK, F.struct("c", "h", "crosses")))).alias("shared"),
    )
    once = F.col("s.n") - F.col("k") - F.size("shared")
    first = F.slice("shared", 1, F.greatest(F.floor(F.col("s.n") / 4) + 1 - once, F.lit(0)).cast("int"))
    return own.select("node", "component", "s", "k", F.transform(F.filter(first, lambda x: x["crosses"]), lambda x: x["h"]).alias("rare"))


def tiles(members: DataFrame) -> DataFrame:
    """(key, low, high, chunk, node, component, s, k): members in every tile (low, high) of two chunks of their bucket they belong to.

    Chunks of the members outside the largest component come first; a tile has at least one of them.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("many"))
    top = counts.groupBy("key").agg(F.max_by("component", F.struct("many", "component")).alias("top"), F.max("many").alias("many"), F.sum("many").alias("every"), F.count("*").alias("kinds"))
    held = members.join(top.where("kinds > 1"), "key")
    inner = F.col("component") == F.col("top")
    outer_chunks, inner_chunks = F.ceil((F.col("every") - F.col("many")) / CHUNK), F.ceil(F.col("many") / CHUNK)
    spread = F.xxhash64("node", F.lit(0))
    chunk = F.when(inner, outer_chunks + F.pmod(spread, inner_chunks)).otherwise(F.pmod(spread, outer_chunks))
    others = F.sequence(F.lit(0).cast("long"), F.when(inner, outer_chunks).otherwise(outer_chunks + inner_chunks) - 1)
    each = held.select("key", "node", "component", "s", "k", chunk.alias("chunk"), F.explode(others).alias("other"))
    return each.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "component", "s", "k")


class Tile:
    """Members of one tile: which pairs of two components are links."""

    def __init__(self, rows: list[dict], hashes: WordHash):
        unpack = zstandard.ZstdDecompressor()
        key = np.array([rows[0]["key"]], np.int64).view(np.uint64)[0]
        self.rows, self.sets, places, used = [], [], [], []
        for r in rows:
            values = shingles(unpack.decompress(r["z"]), hashes)
            mine, have = placed_keys(values)
            # a text of the same id that is not in this bucket
            if key in mine[have]:
                self.rows.append(r)
                self.sets.append(values)
                places.append(mine)
                used.append(have)
        self.key, self.places, self.used = key, np.array(places), np.array(used)
        self.whole = rows[0]["low"] == rows[0]["high"]
        self.size = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        self.low = np.array([[r["b1"], r["b2"]] for r in self.rows], np.int64).view(np.uint64).reshape(-1, 2)
        self.chunk = np.array([r["chunk"] for r in self.rows])
        self.label = np.array([r["component"] for r in self.rows])

    def partners(self, x: int) -> np.ndarray:
        """Later members that x may link to and meets in this bucket first."""
        y = np.arange(x + 1, len(self.sets))
        y = y[(self.label[y] != self.label[x]) & (self.whole | (self.chunk[y] != self.chunk[x]))]
        small, large = np.minimum(self.size[x], self.size[y]), np.maximum(self.size[x], self.size[y])
        apart = np.bitwise_count(self.low[x] ^ self.low[y]).sum(axis=1)
        y = y[(small * 100 >= large * PERCENT) & ~(((large <= SMALL) | (small > SMALL)) & (apart > BITS_APART))]
        shared = (self.places[y] == self.places[x]) & self.used[y] & self.used[x]
        return y[self.places[x][shared.argmax(axis=1)] == self.key]

    def links(self):
        """Links that join components; those inside what is already joined are left out."""
        for x, mine in enumerate(self.sets):
            y = self.partners(x)
            if not len(y):
                continue
            flat = np.concatenate([self.sets[k] for k in y])
            place = np.searchsorted(mine, flat)
            place[place == len(mine)] = 0
            ends = np.cumsum(self.size[y])
            same = np.add.reduceat((mine[place] == flat).astype(np.int64), ends - self.size[y])
            for k in y[100 * same >= PERCENT * (len(mine) + self.size[y] - same)]:
                if self.label[k] != self.label[x]:
                    self.label[self.label == self.label[k]] = self.label[x]
                    yield self.rows[x]["node"], self.rows[k]["node"]


def rare_links(ordered: DataFrame, packed: DataFrame, every_test: DataFrame) -> DataFrame:
    """(a, c): links between components that need a rare shingle. A rare shingle has at most `CHUNK` holders, so pairs are linear."""
    each = ordered.select("node", "component", "s", F.explode("rare").alias("h"))
    x, y = each.alias("x"), each.alias("y")
    near = (F.col("x.h") == F.col("y.h")) & (F.col("x.node") > F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    pairs = x.join(y, near & may_link("x.s", "y.s")).select(F.col("x.node").alias("a"), F.col("y.node").alias("c")).distinct()
    return confirmed(pairs.join(every_test, ["a", "c"], "left_anti"), packed)


def common_links(open_buckets: DataFrame, ordered: DataFrame, packed: DataFrame) -> DataFrame:
    """(a, c): links between components for which the common parts of both sets may suffice, tested in tiles of their buckets."""
    most = ordered.where(F.col("k") * 100 >= F.col("s.n") * PERCENT).select("node", "component", "s", "k")
    every = Stored(tiles(open_buckets.select("key", "node").distinct().join(most, "node")), "tiles").df
    mine, theirs = every.alias("x"), every.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    crosses = (F.col("x.component") != F.col("y.component")) & ((F.col("x.low") == F.col("x.high")) | (F.col("x.chunk") != F.col("y.chunk")))
    suffices = F.least("x.k", "y.k") * (100 + PERCENT) >= (F.col("x.s.n") + F.col("y.s.n")) * PERCENT
    # only members with a pair to test go on to the texts
    some = mine.join(theirs, same & crosses & suffices & may_link("x.s", "y.s"), "left_semi")
    rows = some.select("key", "low", "high", "chunk", "node", "component", "s.b1", "s.b2").distinct().join(packed, "node")
    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    schema = arrow_schema(packed.sparkSession, "a long, c long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        each = (r for batch in batches for at in range(0, batch.num_rows, CHUNK) for r in batch.slice(at, CHUNK).to_pylist())
        for _, members in groupby(each, key=lambda r: (r["key"], r["low"], r["high"])):
            found = list(Tile(list(members), hashes).links())
            if found:
                yield record_batch({"a": [a for a, _ in found], "c": [c for _, c in found]}, schema)

    return dealt.mapInArrow(run, "a long, c long")


def remaining_links(open_buckets: DataFrame, packed: DataFrame, every_test: DataFrame) -> DataFrame:
    """(a, c): links between the components of open buckets, every pair of members tested or ruled out."""
    ordered = Stored(ordered_parts(open_sets(open_buckets, packed).df), "ordered_parts").df
    return rare_links(ordered, packed, every_test).unionByName(common_links(open_buckets, ordered, packed))


def merged(groups: DataFrame, links: DataFrame) -> Stored:
    """Groups with the components joined that a link (a, c) connects."""
    # only components that a new link joins change
    both = links.join(groups.select(F.col("node").alias("a"), F.col("component").alias("u")), "a").join(groups.select(F.col("node").alias("c"), F.col("component").alias("v")), "c")
    joined = components(both.select("u", "v")).df.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return Stored(groups.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: component_id is the smallest id reachable over links."""
    base = texts(docs)
    signs = Stored(signatures(base), "signatures")
    some = signs.df.where("n_shingles > 0")
    classes = Stored(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    placed_rows = some.join(classes.df, ["h1", "h2"])
    same = Stored(placed_rows.where("doc_id <> node").select(F.col("doc_id").alias("u"), F.col("node").alias("v")).distinct(), "same")
    sizes = Stored(signs.df.select("doc_id", "n_shingles"), "sizes")
    # one row per set before its keys are spread: they stay together, which packs well, and need no shuffle
    one = placed_rows.where("doc_id = node").dropDuplicates(["h1", "h2"]).select("node", F.struct(F.col("n_shingles").alias("n"), "b1", "b2").alias("s"), F.explode("keys").alias("key"))
    buckets = Stored(one, "buckets")
    # each table goes when its last reader is written: disk stays at a few of them
    signs.drop()
    classes.drop()
    shared = buckets.df.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("node", "s")).alias("low")).where("c > 1").select("key", "low")
    members = Stored(buckets.df.join(shared, "key"), "members")
    buckets.drop()
    packed = Stored(pack(base.join(members.df.select(F.col("node").alias("doc_id")).distinct(), "doc_id")).distinct(), "packed_texts")

    near = members.df.where(F.col("node") > F.col("low.node")).where(may_link("s", "low.s"))
    tested = Stored(near.groupBy(F.col("node").alias("a")).agg(F.min("low.node").alias("c")), "pairs")
    every_test = tested.df
    links = confirmed(tested.df, packed.df).select(F.col("a").alias("u"), F.col("c").alias("v"))
    groups = components(links.unionByName(same.df))
    known = groups.df.unionByName(members.df.select("node").distinct().join(groups.df, "node", "left_anti").select("node", F.col("node").alias("component")))
    linked, groups = groups, Stored(known, "groups")
    linked.drop()
    same.drop()
    source = members
    inside = members.df.select("key", "node", "s")
    turn = 1
    while True:
        placed = inside.join(groups.df, "node")
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("many"), F.min_by(F.struct("node", "s"), F.xxhash64("node", "key", F.lit(turn))).alias("pick"))
        top = parts.groupBy("key").agg(F.max_by(F.struct("component", "pick"), F.struct("many", -F.col("component"))).alias("top"), F.count("*").alias("kinds"), F.max("many").alias("many"), F.sum("many").alias("every")).where("kinds > 1")
        rest = Stored(placed.join(top, "key"), "open_buckets")
        inside = rest.df.select("key", "node", "s")
        source.drop()
        source = rest
        outside = rest.df.where(F.col("component") != F.col("top.component"))
        second = outside.groupBy("key").agg(F.min_by(F.struct("component", "node", "s"), F.xxhash64("node", "key", F.lit(-turn))).alias("other"))
        to_top = outside.where(may_link("s", "top.pick.s")).select("node", F.col("top.pick.node").alias("c"))
        to_rest = outside.join(second, "key").where(F.col("component") != F.col("other.component")).where(may_link("s", "other.s")).select("node", F.col("other.node").alias("c"))
        pairs = to_top.unionByName(to_rest).select(F.greatest("node", "c").alias("a"), F.least("node", "c").alias("c")).distinct()
        tested = Stored(pairs.join(every_test, ["a", "c"], "left_anti"), "pairs")
        every_test = every_test.unionByName(tested.df)
        found = Stored(confirmed(tested.df, packed.df), "links")
        if not found.df.limit(1).count():
            break
        before, groups = groups, merged(groups.df, found.df)
        before.drop()
        found.drop()
        turn += 1
    found = Stored(remaining_links(rest.df, packed.df, every_test), "links")
    if found.df.limit(1).count():
        groups = merged(groups.df, found.df)
    source.drop()
    packed.drop()
    out = sizes.df.join(groups.df.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def clean(docs: DataFrame) -> DataFrame:
    """One document per group with all its columns: the one of the smallest id. Rows of one id stay or go together; rows without an id stay."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
