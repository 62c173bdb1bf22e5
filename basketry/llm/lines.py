"""Line dedup: repeated windows of `min_lines` lines, counted by prefix doubling over line ids up to that depth.

A document is the sequence of its lines that are not blank, a line is its id. Suffixes (document, line number) are ranked by their first
1, 2, 4, … lines, up to `min_lines` (with the default of 2 this is a count of line pairs): the rank at twice the depth is the order of the pair (rank here, rank that many lines on). Ranks are given to
the distinct pairs in range-sorted order, so no task sees all of them, and suffixes alone in their class drop out, as no longer prefix of
theirs can repeat. Of the suffixes that agree over `min_lines` lines the first (smallest id, then line number) is the original, the
lines of all others are later copies and go. No suffix array is built and no maximal run is looked for: one of more lines is the
union of its windows of `min_lines`. A single repeated line goes if it has at least `long_line` characters.

DataFrame operations only. A hot line is counted before the shuffle, and its rows are dealt by document in the doubling steps.

Defined results: a null or empty text has no lines; blank lines are no part of the sequence and stay; rows equal in id and
text are one document and get the same result; rows of one id with other texts are documents of their own, ordered by the hash of the
text; rows without an id are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Stored, free_name, texts

MIN_LINES = 2
LONG_LINE = 40
PLACE = ["doc_id", "th", "seq"]


def line_table(base: DataFrame) -> DataFrame:
    """(doc_id, th, seq, pos, id, chars): lines that are not blank, numbered, with their place among all lines."""
    lines = F.split("text", "\n", -1)
    full = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("pos"), line.alias("line"))), lambda x: x["line"].rlike("\\S"))
    each = base.select("doc_id", "th", F.posexplode(full).alias("seq", "l"))
    return each.select("doc_id", "th", "seq", "l.pos", F.unhex(F.md5(F.col("l.line").cast("binary"))).alias("id"), F.length("l.line").alias("chars"))


def ranked(rows: DataFrame, keys: list[str], name: str) -> Stored:
    """Rows whose keys occur more than once, with the rank of the keys and the first place that has them."""
    classes = rows.groupBy(*keys).agg(F.count("*").alias("c"), F.min(F.struct(*PLACE)).alias("first")).where("c > 1").drop("c")
    # ranks follow the order of the keys: range partitions in sorted order, numbered where they are written
    order = Stored(classes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_rank", F.monotonically_increasing_id()), name)
    return Stored(rows.join(order.df, keys).drop(*keys).withColumnRenamed("_rank", "rank"), name)


def later_copies(base: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """(doc_id, th, seq, pos) of all lines to delete."""
    lines = Stored(line_table(base.dropDuplicates(["doc_id", "th"])), "lines")
    now = ranked(lines.df, ["id"], "rank_1")
    copy = F.struct(*PLACE) > F.col("first")
    gone = now.df.where(copy & (F.col("chars") >= long_line)).select(*PLACE)
    depth = 1
    while depth < min_lines:
        step = min(depth, min_lines - depth)
        ahead = now.df.select("doc_id", "th", (F.col("seq") - step).alias("seq"), F.col("rank").alias("next"))
        pairs = now.df.select(*PLACE, "rank").join(ahead, PLACE)
        depth += step
        now = ranked(pairs, ["rank", "next"], f"rank_{depth}")
    if min_lines > 1:
        runs = now.df.where(copy).select("doc_id", "th", F.explode(F.sequence("seq", F.col("seq") + (min_lines - 1))).alias("seq"))
        gone = gone.unionByName(runs)
    return lines.df.join(gone.distinct(), PLACE).select(*PLACE, "pos")


def text_without(gone: str) -> Column:
    """The text without the lines at the places `gone`; linear in the lines, as the text is split once and not again inside a lambda."""
    parts = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    bound = F.array(F.struct(parts.alias("lines"), stay.alias("stay")))
    left = F.transform(bound, lambda b: F.array_join(F.transform(b["stay"], lambda p: F.element_at(b["lines"], p + 1)), "\n"))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(left[0])


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """(doc_id, th, text, kept_text, n_lines, n_removed, n_runs) per row."""
    base = texts(docs)
    gone = later_copies(base, min_lines, long_line)
    per_doc = gone.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("gone"), F.sort_array(F.collect_list("seq")).alias("seqs"))
    lines, kept = F.split("text", "\n", -1), text_without("gone")
    # a run begins where the line before is kept
    begins = F.size(F.array_except(F.col("seqs"), F.transform("seqs", lambda s: s + 1)))
    return base.join(per_doc, ["doc_id", "th"], "left").select(
        "doc_id", "th", "text", kept.alias("kept_text"), F.size(F.filter(lines, lambda x: x.rlike("\\S"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(begins, F.lit(0)).cast("long").alias("n_runs"),
    )


def clean(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """All rows and columns with the later copies cut out of the text; `n_chars` follows it. Rows that lose all their lines go.

    A null text and a row without an id stay as they are.
    """
    th, gone = free_name(docs, "_th"), free_name(docs, "_gone")
    found = later_copies(texts(docs), min_lines, long_line).groupBy("doc_id", F.col("th").alias(th)).agg(F.collect_list("pos").alias(gone))
    found = found.withColumnRenamed("doc_id", free_name(docs, "_doc_id"))
    key = free_name(docs, "_doc_id")
    hashed = docs.withColumn(th, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    both = hashed.join(found.withColumnRenamed(th, th + "2"), (F.col("doc_id") == F.col(key)) & (F.col(th) == F.col(th + "2")), "left")
    kept = text_without(gone)
    new = free_name(docs, "_new")
    both = both.withColumn(new, kept)  # in a step of its own: an alias `text` beside it would be read inside the lambda
    touched = F.col(gone).isNotNull()
    changed = {"text": F.col(new), "n_chars": F.when(touched, F.length(new)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    columns = [changed.get(c, F.col(f"`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]
    return both.where(~touched | F.col(new).rlike("\\S")).select(*columns)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", F.when(F.col("n_removed") > 0, F.col("n_removed")).otherwise(0).alias("n_removed"), F.when(F.col("n_runs") > 0, F.col("n_runs")).otherwise(0).alias("n_runs"), F.sha2("kept_text", 256).alias("kept_sha256"))
