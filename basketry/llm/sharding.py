"""Sharding by balanced label propagation.

Linked documents move towards the shard most of their neighbours are in; a shard accepts newcomers only while it has room.
Every linked document starts in a shard of its own hash, so neighbours begin apart. Each round is two joins over the links: votes of
the neighbours (counted before the shuffle) and the accepted moves. Who may move is decided on a histogram of movers per shard, of 256
hash classes, so no task holds the movers of a shard; a class holds whole groups. Documents with a smaller neighbour move first, later a
random half each round. The class that meets a shard's border comes in whole, and who may not leave stays: the last step cuts what
is too much.

The last step meets the law `rows` exactly: a shard keeps its linked documents up to its quota, in order of their group; what is
over the quota and all documents without links fill the room left. So shard counts differ by one at most, and a group is
cut only if its shard has no room for it.

Defined results: a null text has size 16 and the checksum of an empty text, and counts as an empty text for the links; rows of one
id get the same label but each its own slot; rows without an id are left out; fewer rows than shards leave shards empty; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import Stored
from basketry.llm.positions import numbered

SHARDS = 40
ROUNDS = 3
CLASSES = 256


def copies_links(rows: DataFrame) -> DataFrame:
    """Links (u, v) between documents of equal text: from each to the smallest id of its group."""
    groups = rows.groupBy("text_key").agg(F.min("doc_id").alias("v"), F.count("*").alias("c")).where("c > 1")
    return rows.join(groups, "text_key").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()


def propagate(links: DataFrame, total: DataFrame | int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(node, label, seed) for every linked node; `total` is the number of rows that share the capacity."""
    both = Stored(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    start = both.df.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("seed"))
    labels = Stored(start.select(F.col("u").alias("node"), "seed", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int").alias("label")), "labels")
    capacity = -(-total // shards)
    for turn in range(rounds):
        votes = both.df.join(labels.df.select(F.col("node").alias("v"), "label"), "v").groupBy("u", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("u").alias("node")).agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("b"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("all"))
        # never all nodes of a group may move in a round: two neighbours do not swap places
        turns = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0 if turn else F.col("node") != F.col("seed")
        wish = labels.df.join(best, "node", "left").select("node", "seed", "label", F.when(turns & (F.col("b.n") > F.coalesce(F.col("all")[F.col("label")], F.lit(0))), -F.col("b.l")).alias("to"))
        wish = wish.withColumn("class", F.pmod(F.xxhash64("seed", F.lit(turn)), F.lit(CLASSES)))
        wish = Stored(wish, "wishes")
        # who wants to leave takes no room
        load = wish.df.where("to is null").groupBy("label").agg(F.count("*").alias("load"))
        # shards x classes rows at most
        crowd = wish.df.where("to is not null").groupBy("to", "class").agg(F.count("*").alias("n"))
        room = crowd.join(load.withColumnRenamed("label", "to"), "to", "left").withColumn("upto", F.sum("n").over(Window.partitionBy("to").orderBy("class")))
        # the class that meets the border comes in whole
        accepted = room.where(F.col("upto") - F.col("n") + F.coalesce("load", F.lit(0)) < capacity).select("to", "class", F.lit(True).alias("ok"))
        labels = Stored(wish.df.join(F.broadcast(accepted), ["to", "class"], "left").select("node", "seed", F.when(F.col("ok"), F.col("to")).otherwise(F.col("label")).cast("int").alias("label")), "labels")
    return labels.df


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, links: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row; links default to equal texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))
    rows = Stored(rows, "sizes").df
    total = rows.count()
    labels = propagate(copies_links(rows) if links is None else links, total, shards, rounds)
    placed = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "size", "text_crc32", "label", "seed")
    order = numbered(placed.where("label is not null"), ["label", "seed", "doc_id"], "linked")
    count = {r["label"]: r["n"] for r in order.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row per shard
    quota = [total * (s + 1) // shards - total * s // shards for s in range(shards)]
    starts, room, at, filled = [], [], 0, 0
    for s in range(shards):
        starts.append(at)
        at += count.get(s, 0)
        room.append(filled)
        filled += max(0, quota[s] - count.get(s, 0))
    start = F.array(*map(F.lit, starts))[F.col("label")]
    order = order.withColumn("slot", F.col("_pos") - start)
    keeps = F.col("slot") < F.array(*map(F.lit, quota))[F.col("label")]
    stay = order.where(keeps).select("doc_id", "size", "text_crc32", F.col("label").alias("shard"), "slot")
    pool = order.where(~keeps).select("doc_id", "size", "text_crc32", "seed").unionByName(placed.where("label is null").select("doc_id", "size", "text_crc32", F.lit(None).cast("long").alias("seed")))
    pool = numbered(pool, ["seed", "doc_id"], "pool")
    # last shard with room that begins at or before the position
    open_shards = [s for s in range(shards) if quota[s] > count.get(s, 0)]
    begins = F.array(*[F.lit(room[s]).cast("long") for s in open_shards]) if open_shards else F.array(F.lit(0).cast("long"))
    which = F.size(F.filter(begins, lambda b: b <= F.col("_pos"))) - 1
    number = F.array(*map(F.lit, open_shards or [0]))
    held = F.array(*[F.lit(min(count.get(s, 0), quota[s])).cast("long") for s in open_shards] or [F.lit(0).cast("long")])
    fill = pool.withColumn("_w", which).select("doc_id", "size", "text_crc32", number[F.col("_w")].alias("shard"), (held[F.col("_w")] + F.col("_pos") - begins[F.col("_w")]).alias("slot"))
    return stay.unionByName(fill).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
