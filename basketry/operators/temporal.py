"""Time-valid joins: item version at order time, best promotion on the order date, window overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.config import Settings
from basketry.operators.timeline import as_of, busy_spots, hot_and_busy, hot_keys, split_neighbours
from basketry.session import materialize

VERSION_ATTRIBUTES = (
    "item_key_sk",
    "item_scd_sk",
    "item_name_en",
    "item_name_de",
    "item_name_preferred",
    "item_category",
    "brand_name",
    "product_base_price_gross_eur",
    "vat_rate_pct",
    "valid_from_utc",
    "valid_to_utc",
)


def small_history(history: DataFrame, key: str, cfg: Settings) -> bool:
    """True if the history is safe to broadcast: few rows, few bytes and few versions of any one key."""
    text = [f.name for f in history.schema.fields if f.dataType == T.StringType()]
    width = F.lit(16 * len(history.columns)).cast("long")
    for name in text:
        width = width + F.coalesce(F.octet_length(name), F.lit(0))
    per_key = history.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes"))
    total, worst, size = per_key.agg(*[F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "n"), (F.max, "n"), (F.sum, "bytes"))]).first()
    return total <= cfg.broadcast_rows and worst <= cfg.broadcast_rows_per_key and size <= cfg.broadcast_bytes


def disjoint_windows(windows: DataFrame, key: str, start: str, end: str, choice: Column, unit: str) -> DataFrame:
    """(key, segment_from, segment_to, choice): windows that do not overlap, each with the largest choice among those open in it.

    Starts and ends cut a key's timeline into pieces, numbered in time order. A window covers a range of numbers, which is
    cut into at most two aligned blocks per power of two; the best choice per block is kept, and a piece takes the best of
    the blocks above it. Work is (windows + cuts) * log(cuts): no window meets all cuts it covers, no key is gathered.
    """
    valid = windows.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    folded = valid.groupBy(F.col(key).alias("__key"), F.col(start).alias("__from"), F.col(end).alias("__to")).agg(F.max(choice).alias("choice"))
    cuts = folded.select("__key", F.explode(F.array("__from", "__to")).alias("__t")).distinct()
    cuts = split_neighbours(cuts, ["__key"], "__t", [], leads={"__until": "__t"}, unit=unit, number="__n")
    ranged = (
        folded.join(cuts.select("__key", F.col("__t").alias("__from"), F.col("__n").alias("__a")), ["__key", "__from"])
        .join(cuts.select("__key", F.col("__t").alias("__to"), F.col("__n").alias("__b")), ["__key", "__to"])
    )
    # more levels than any number of cuts needs; empty ones are filtered before anything is shuffled
    levels = F.sequence(F.lit(0), F.ceil(F.log2(F.col("__b") + 1)).cast("int"))

    def blocks(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        low, high = F.ceil(F.col("__a") / size).cast("long"), F.floor(F.col("__b") / size).cast("long")
        odd = lambda n: n % 2 == 1
        both = F.array(F.when((low < high) & odd(low), low), F.when((low < high) & odd(high), high - 1))
        return F.transform(F.array_distinct(F.array_compact(both)), lambda n: F.struct(level.alias("level"), n.alias("block")))

    kept = ranged.select("__key", "choice", F.explode(F.flatten(F.transform(levels, blocks))).alias("p"))
    best = kept.groupBy("__key", "p.level", "p.block").agg(F.max("choice").alias("choice"))
    deepest = F.ceil(F.log2(F.col("__n") + 1)).cast("int")
    above = F.transform(
        F.sequence(F.lit(0), deepest),
        lambda level: F.struct(level.alias("level"), F.floor(F.col("__n") / F.pow(F.lit(2.0), level)).cast("long").alias("block")),
    )
    pieces = cuts.where("__until is not null").select("__key", "__t", "__until", F.explode(above).alias("p")).select("__key", "__t", "__until", "p.level", "p.block")
    return (
        pieces.join(best, ["__key", "level", "block"])
        .groupBy("__key", "__t", "__until")
        .agg(F.max("choice").alias("choice"))
        .select(F.col("__key").alias(key), F.col("__t").alias("segment_from"), F.col("__until").alias("segment_to"), "choice")
    )


def interval_lookup(
    facts: DataFrame,
    windows: DataFrame,
    key: str,
    at: str,
    valid_from: str,
    valid_to: str,
    attributes: Sequence[str],
    rank: Sequence[Column] = (),
    cfg: Settings = Settings(),
    strategy: str = "auto",
) -> DataFrame:
    """Left join of each fact to the window [valid_from, valid_to) of its key that contains its time.

    Windows of one key must not overlap (gaps are fine), so a fact meets at most one and is never multiplied.

    * "broadcast", "auto": the facts are not shuffled at all, if the windows are few enough when counted.
    * "asof", or too many windows: any size and any skew; linear merge of both sides in time order. A key with more rows than a task
      should hold is cut into pieces of time, any other stays whole, so both sides move once.
    * "counted": the caller has found the windows to be few.

    All give the same rows, as a fact meets at most one window.
    """
    windows = windows.where(F.col(valid_from) < F.col(valid_to))
    if strategy in ("broadcast", "auto"):
        strategy = "counted" if small_history(windows, key, cfg) else "asof"
    if strategy == "counted":
        side = windows.select(
            F.col(key).alias("__key"), F.col(valid_from).alias("__from"), F.col(valid_to).alias("__to"), *attributes
        )
        hit = (F.col(key) == F.col("__key")) & (F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__to"))
        return facts.join(F.broadcast(side), hit, "left").drop("__key", "__from", "__to")
    hot = hot_keys(facts.select(key).unionByName(windows.select(key)), [key], cfg.rows_per_task)
    busy = None if hot is None else busy_spots(facts.join(F.broadcast(hot), key, "left_semi"), [key], at, cfg.split_unit, cfg.rows_per_task)
    return _merged(facts, windows, key, at, valid_from, valid_to, attributes, rank, cfg.split_unit, busy, hot)


def _merged(
    facts: DataFrame, windows: DataFrame, key: str, at: str, valid_from: str, valid_to: str, attributes: Sequence[str],
    rank: Sequence[Column], unit: str, busy: DataFrame | None, hot: DataFrame | None,
) -> DataFrame:
    carried = list(dict.fromkeys([*attributes, valid_to]))
    matched = as_of(facts, windows, key, at, valid_from, rank, carried, unit, busy=busy, hot=hot)
    inside = F.when(F.col(at) < F.col("__version")[valid_to], F.col("__version"))
    return matched.withColumn("__version", inside).select(
        *facts.columns, *[F.col("__version")[a].alias(a) for a in attributes]
    )


def day_lookup(
    facts: DataFrame,
    windows: DataFrame,
    key: str,
    date: str,
    valid_from: str,
    valid_to: str,
    attributes: Sequence[str],
    cfg: Settings = Settings(),
) -> DataFrame:
    """Left join of each fact to the window [valid_from, valid_to) of its key that contains its date, for any size and skew.

    Facts and windows of a key are merged in time order in one task, as long as a task should hold them. Of the other keys all facts of
    a key and date have the same window, so windows are looked up once per key and date (counted before the shuffle) and
    the facts meet the result in an equi-join on both. A key and date with more than `rows_per_task` facts is dealt to as many
    tasks as it fills: its facts get a salt, its window is repeated per salt. Only these keys and dates are broadcast; there are
    fewer than `busy_spots` of them, as the limit grows with the number of facts.
    """
    windows = windows.where(F.col(valid_from) < F.col(valid_to))
    hot = hot_keys(facts.select(key).unionByName(windows.select(key)), [key], cfg.rows_per_task)
    if hot is None:
        return _merged(facts, windows, key, date, valid_from, valid_to, attributes, (), "month", None, None)
    cold = facts.join(F.broadcast(hot), key, "left_anti").select(*facts.columns)
    rest = _merged(cold, windows.join(F.broadcast(hot), key, "left_anti"), key, date, valid_from, valid_to, attributes, (), "month", None, None)
    facts, windows = (df.join(F.broadcast(hot), key, "left_semi").select(*df.columns) for df in (facts, windows))
    spots = facts.where(F.col(key).isNotNull() & F.col(date).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(date).alias("__day")).agg(F.count(F.lit(1)).alias("__facts"))
    carried = list(dict.fromkeys([*attributes, valid_to]))
    matched = as_of(spots, windows, "__key", "__day", valid_from, (), carried, "month", version_key=key)
    found = F.when(F.col("__day") < F.col("__version")[valid_to], F.struct(*[F.col("__version")[a].alias(a) for a in attributes]))
    matched = materialize(matched.select("__key", "__day", "__facts", found.alias("__found")), "windows-by-day")
    total = matched.agg(F.coalesce(F.sum("__facts"), F.lit(0))).first()[0]
    limit = max(cfg.rows_per_task, total // cfg.busy_spots + 1)
    copies = F.ceil(F.col("__facts") / limit).cast("int")
    busy = matched.where(F.col("__found").isNotNull() & (F.col("__facts") > limit)).select(F.col("__key").alias("__b_key"), F.col("__day").alias("__b_day"), copies.alias("__copies"))
    is_busy = (F.col(key) == F.col("__b_key")) & (F.col(date) == F.col("__b_day"))
    salt = F.coalesce(F.pmod(F.xxhash64(*facts.columns), F.col("__copies")), F.lit(0).cast("long"))
    salted = facts.join(F.broadcast(busy), is_busy, "left").withColumn("__salt", salt)
    repeated = matched.where("__found is not null").select("__key", "__day", F.explode(F.sequence(F.lit(0).cast("long"), copies.cast("long") - 1)).alias("__s"), "__found")
    hit = (F.col(key) == F.col("__key")) & (F.col(date) == F.col("__day")) & (F.col("__salt") == F.col("__s"))
    found = salted.join(repeated, hit, "left").select(*facts.columns, *[F.col("__found")[a].alias(a) for a in attributes])
    return found.unionByName(rest)


def resolved_history(history: DataFrame, key: str, attributes: Sequence[str], cfg: Settings = Settings()) -> DataFrame:
    """Stored windows of a history that do not overlap: (key, segment_from, segment_to, attributes).

    Where versions overlap, the one that starts last counts, then the one that closes last, has a price, and comes last by
    log id and key. A history that has no overlaps is only copied.
    """
    start, end = "valid_from_utc", "valid_to_utc"
    valid = history.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    periods = valid.select(key, start, end)
    crowded = hot_and_busy(periods, [key], start, cfg.split_unit, cfg.rows_per_task)
    nexted = split_neighbours(periods, [key], start, [end], leads={"__next": start}, unit=cfg.split_unit, **crowded)
    if nexted.where(F.col(end) > F.col("__next")).limit(1).count() == 0:
        return materialize(valid.select(key, F.col(start).alias("segment_from"), F.col(end).alias("segment_to"), *attributes), "resolved-history")
    # of the versions of one period the best is known at once; the periods alone are then resolved, start and end give their order
    rank = [F.coalesce(F.col("product_base_price_gross_eur") > 0, F.lit(False)), F.col("log_item_id"), F.col("item_scd_sk")]
    kept = F.struct(*[c.alias(f"__r{k}") for k, c in enumerate(rank)], F.struct(*attributes).alias("version"))
    best = valid.groupBy(F.col(key).alias("__key"), F.col(start).alias("__from"), F.col(end).alias("__to")).agg(F.max(kept).alias("__kept"))
    segments = disjoint_windows(periods, key, start, end, F.struct(F.col(start).alias("from"), F.col(end).alias("to")), cfg.split_unit)
    hit = (F.col(key) == F.col("__key")) & (F.col("choice.from") == F.col("__from")) & (F.col("choice.to") == F.col("__to"))
    found = segments.join(best, hit).select(key, "segment_from", "segment_to", *[F.col("__kept.version")[a].alias(a) for a in attributes])
    return materialize(found, "resolved-history")


def time_valid_join(
    facts: DataFrame,
    history: DataFrame,
    key: str = "item_key",
    ts: str = "time_order_received_utc",
    attributes: tuple[str, ...] = VERSION_ATTRIBUTES,
    cfg: Settings = Settings(),
    strategy: str = "auto",
    disjoint: bool = False,
) -> DataFrame:
    """Left join of each fact to the item version valid at its time.

    `disjoint` says that versions of an item do not overlap, as in what `item_scd2` builds; the history is then used as it is.
    Otherwise it is checked, resolved where versions overlap, and stored once, so a fact never meets two.
    """
    wanted = [a for a in attributes if a != key]
    if disjoint:
        return interval_lookup(facts, history, key, ts, "valid_from_utc", "valid_to_utc", wanted, (), cfg, strategy)
    segments = resolved_history(history, key, wanted, cfg)
    return interval_lookup(facts, segments, key, ts, "segment_from", "segment_to", wanted, (), cfg, strategy)


# ---------------------------------------------------------------------------------------- promotions

SEGMENT_COLUMNS = ("promo_sk", "promo_type", "discount_pct")


def promo_segments(promos: DataFrame, key: str = "item_key") -> DataFrame:
    """Non-overlapping windows per item, each with the best promotion active in it: discount, then later start, then key."""
    start, end = "promo_start_date", "promo_end_date"
    choice = F.struct("discount_pct", start, "promo_sk", "promo_type")
    segments = disjoint_windows(promos, key, start, end, choice, "month")
    return segments.select(key, "segment_from", "segment_to", *[F.col("choice")[c].alias(c) for c in SEGMENT_COLUMNS])


def apply_promo_segments(
    priced: DataFrame,
    segments: DataFrame,
    key: str = "item_key",
    date: str = "order_date_berlin",
    cfg: Settings = Settings(),
    strategy: str = "auto",
) -> DataFrame:
    """Left join to the promotion active on the order's local date (start inclusive, end exclusive).

    The order items are not shuffled if the segments are few enough to broadcast (strategy "broadcast" or "auto"); else, and with
    "asof", each (item, date) looks its promotion up once.
    """
    if strategy != "asof" and small_history(segments, key, cfg):
        return interval_lookup(priced, segments, key, date, "segment_from", "segment_to", SEGMENT_COLUMNS, (), cfg, "counted")
    return day_lookup(priced, segments, key, date, "segment_from", "segment_to", SEGMENT_COLUMNS, cfg)


def apply_promos(
    priced: DataFrame,
    promos: DataFrame,
    key: str = "item_key",
    date: str = "order_date_berlin",
    cfg: Settings = Settings(),
    strategy: str = "auto",
) -> DataFrame:
    """Best promotion of each order item straight from the promotion rules (which carry `promo_sk`); they are resolved once."""
    segments = materialize(promo_segments(promos, key), "promo-segments")
    return apply_promo_segments(priced, segments, key, date, cfg, strategy)


def overlapping_windows(df: DataFrame, key: str, start: str, end: str, ties: list[str]) -> DataFrame:
    """Date windows that overlap others of their key: each distinct window once, with `copies` (equal rows) and `overlaps`.

    `overlaps` counts the other rows a row of the window meets, so `copies * overlaps` summed over a key is twice its number of
    overlapping pairs. A window meets what began before its end, less what ended by its start, less itself: two running counts over a
    key's calendar. No two windows are ever compared, so a key with many windows costs no more than its rows.
    """
    cols = [start, end, *ties]
    folded = df.where(F.col(start) < F.col(end)).groupBy(key, *cols).agg(F.count(F.lit(1)).alias("copies"))
    edges = folded.select(
        key, F.explode(F.array(F.struct(F.col(start).alias("day"), F.col("copies").alias("b"), F.lit(0).cast("long").alias("e")), F.struct(F.col(end).alias("day"), F.lit(0).cast("long").alias("b"), F.col("copies").alias("e")))).alias("x")
    )
    days = edges.groupBy(key, "x.day").agg(F.sum("x.b").alias("b"), F.sum("x.e").alias("e"))
    # one row per key and day: bounded by the calendar
    so_far = Window.partitionBy(key).orderBy("day")
    counted = days.select(
        key, "day",
        F.coalesce(F.sum("b").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__begun"),
        F.sum("e").over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias("__ended"),
    )
    return (
        folded.join(counted.select(key, F.col("day").alias(end), "__begun"), [key, end])
        .join(counted.select(key, F.col("day").alias(start), "__ended"), [key, start])
        .withColumn("overlaps", F.col("__begun") - F.col("__ended") - 1)
        .where("overlaps > 0")
        .select(key, *cols, "copies", "overlaps")
    )
