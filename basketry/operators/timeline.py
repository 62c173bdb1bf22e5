"""Window functions over one key's timeline that never need the whole key in one task.

A plain window puts all rows of a key into one task. Here every key's timeline is cut into time buckets;
rows are sorted and numbered inside a bucket, and what a bucket needs from its neighbours (a row count, the
last row, the next row) is carried through a small table with one row per key and bucket. Results equal the
plain window exactly; a key holding a third of all rows is spread over as many tasks as it has buckets.

A bucket is an hour (or another unit). Where one key has more rows in one bucket than a task should hold, `busy_spots` finds
these spots first, and they are cut into seconds; every function takes them. Only rows of one key at one second stay together.

Only the timelines of keys with more rows than a task should hold are cut, if a function is given them (`hot_keys`). Any other key
stays whole, which needs no small table: its rows move once.

Keys and the time column must not be null (use surrogate keys).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.session import materialize

BUCKET = "__bucket"
FINE = "second"
# as many busy spots are sent to all tasks at most
MOST_SPOTS = 10_000


def busy_spots(df: DataFrame, keys: Sequence[str], ts: str, unit: str = "hour", rows_per_task: int = 1_000_000) -> DataFrame | None:
    """(keys, bucket) with more rows than a task should hold; None if there are none.

    Rows are counted per key and bucket, added up before the shuffle. The limit grows with the table, so that there are fewer than
    `MOST_SPOTS` of them, whatever its size.
    """
    counts = df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).alias(BUCKET)).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(rows_per_task, (total or 0) // MOST_SPOTS + 1)
    if (most or 0) <= limit:
        return None
    return materialize(counts.where(F.col("__n") > limit).select(*keys, BUCKET), "busy-spots")


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int = 1_000_000) -> DataFrame | None:
    """Keys with more rows than a task should hold; None if there are none. The limit grows with the table, as in `busy_spots`."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    limit = max(rows_per_task, (total or 0) // MOST_SPOTS + 1)
    if (most or 0) <= limit:
        return None
    return materialize(counts.where(F.col("__n") > limit).select(*keys), "hot-keys")


def hot_and_busy(
    df: DataFrame, keys: Sequence[str], ts: str, unit: str = "hour", rows_per_task: int = 1_000_000
) -> dict[str, DataFrame | None]:
    """`hot` and `busy` of a table: its hot keys, and the busy spots among their rows."""
    hot = hot_keys(df, keys, rows_per_task)
    busy = None if hot is None else busy_spots(df.join(F.broadcast(hot), list(keys), "left_semi"), keys, ts, unit, rows_per_task)
    return {"hot": hot, "busy": busy}


def _with_bucket(
    df: DataFrame, ts: str, unit: str, keys: Sequence[str] = (), busy: DataFrame | None = None, spot_keys: Sequence[str] | None = None
) -> DataFrame:
    """Adds the bucket of each row: the start of its unit, or of its second where the spot is busy.

    `spot_keys` names the key columns of `busy` where they differ.
    """
    coarse = F.date_trunc(unit, F.col(ts))
    if busy is None:
        return df.withColumn(BUCKET, coarse)
    names = spot_keys or keys
    spots = busy.select(*[F.col(n).alias(f"__s{k}") for k, n in enumerate(names)], F.col(BUCKET).alias("__spot"))
    hit = F.col("__spot") == coarse
    for k, key in enumerate(keys):
        hit = hit & (F.col(key) == F.col(f"__s{k}"))
    fine = F.when(F.col("__spot").isNotNull(), F.date_trunc(FINE, F.col(ts))).otherwise(coarse)
    joined = df.join(F.broadcast(spots), hit, "left").withColumn(BUCKET, fine)
    return joined.drop("__spot", *[f"__s{k}" for k in range(len(names))])


def _hot_apart(
    df: DataFrame, keys: Sequence[str], hot: DataFrame | None, whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """`cut` of the rows of hot keys and `whole` of the others."""
    if hot is None:
        return whole(df)
    cold, rest = (df.join(F.broadcast(hot), list(keys), how).select(*df.columns) for how in ("left_anti", "left_semi"))
    return whole(cold).unionByName(cut(rest))


def split_row_number(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    out: str,
    unit: str = "hour",
    busy: DataFrame | None = None,
    hot: DataFrame | str | None = "all",
) -> DataFrame:
    """`row_number()` per key ordered by (ts, ties). `hot` as in `as_of`."""
    if not isinstance(hot, str):
        whole = W.partitionBy(*keys).orderBy(ts, *ties)
        return _hot_apart(
            df, keys, hot, lambda rows: rows.withColumn(out, F.row_number().over(whole).cast("long")),
            lambda rows: split_row_number(rows, keys, ts, ties, out, unit, busy),
        )
    spot = [*keys, BUCKET]
    rows = _with_bucket(df, ts, unit, keys, busy)
    earlier = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*spot)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*spot, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    local = W.partitionBy(*spot).orderBy(ts, *ties)
    numbered = rows.withColumn("__rn", F.row_number().over(local))
    return (
        numbered.join(offsets, spot)
        .withColumn(out, (F.col("__rn") + F.col("__before")).cast("long"))
        .drop(BUCKET, "__rn", "__before")
    )


def split_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ties: Sequence[str],
    lags: Mapping[str, Column | str] | None = None,
    leads: Mapping[str, Column | str] | None = None,
    unit: str = "hour",
    number: str | None = None,
    busy: DataFrame | None = None,
    hot: DataFrame | str | None = "all",
) -> DataFrame:
    """`lag` / `lead` by one row per key ordered by (ts, ties); new columns are named by the mappings.

    `number` names a column for `row_number()` in the same order, found in the same pass. `hot` as in `as_of`.
    """
    lags, leads = dict(lags or {}), dict(leads or {})
    if not isinstance(hot, str):
        whole = W.partitionBy(*keys).orderBy(ts, *ties)
        near = {n: F.lag(c).over(whole) for n, c in lags.items()} | {n: F.lead(c).over(whole) for n, c in leads.items()}
        if number:
            near[number] = F.row_number().over(whole).cast("long")
        return _hot_apart(
            df, keys, hot, lambda rows: rows.withColumns(near),
            lambda rows: split_neighbours(rows, keys, ts, ties, lags, leads, unit, number, busy),
        )
    spot = [*keys, BUCKET]
    order = F.struct(F.col(ts), *[F.col(t) for t in ties])

    def pack(cols: Mapping[str, Column | str]) -> Column:
        return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in cols.items()])

    bucketed = rows = _with_bucket(df, ts, unit, keys, busy)
    local = W.partitionBy(*spot).orderBy(ts, *ties)
    across = W.partitionBy(*keys).orderBy(BUCKET)
    edge_aggs, edge_cols = [], []
    if lags:
        rows = rows.withColumn("__lag", F.lag(pack(lags)).over(local))
        edge_aggs.append(F.max_by(pack(lags), order).alias("__last"))
        edge_cols.append(F.lag("__last").over(across).alias("__prev"))
    if leads:
        rows = rows.withColumn("__lead", F.lead(pack(leads)).over(local))
        edge_aggs.append(F.min_by(pack(leads), order).alias("__first"))
        edge_cols.append(F.lead("__first").over(across).alias("__next"))
    if number:
        rows = rows.withColumn("__rn", F.row_number().over(local))
        edge_aggs.append(F.count(F.lit(1)).alias("__n"))
        earlier = across.rowsBetween(W.unboundedPreceding, -1)
        edge_cols.append(F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    edges = bucketed.groupBy(*spot).agg(*edge_aggs).select(*spot, *edge_cols)
    joined = rows.join(edges, spot)
    # a whole struct is null only when there is no neighbour inside the bucket
    for name in lags:
        joined = joined.withColumn(name, F.coalesce("__lag", "__prev")[name])
    for name in leads:
        joined = joined.withColumn(name, F.coalesce("__lead", "__next")[name])
    if number:
        joined = joined.withColumn(number, (F.col("__rn") + F.col("__before")).cast("long"))
    return joined.drop(BUCKET, "__lag", "__prev", "__lead", "__next", "__rn", "__before")


def as_of(
    facts: DataFrame,
    versions: DataFrame,
    key: str,
    ts: str,
    valid_from: str,
    rank: Sequence[Column],
    attributes: Sequence[str],
    unit: str = "hour",
    version_key: str | None = None,
    busy: DataFrame | None = None,
    hot: DataFrame | str | None = "all",
) -> DataFrame:
    """For every fact the latest version with `valid_from <= ts` of its key; null struct if there is none.

    Facts and versions are merged in time order inside each (key, bucket); a bucket also receives the last
    version of the buckets before it as a seed row. Work is linear in facts plus versions: no key is ever
    paired with all of its versions. Adds one struct column `__version` with `attributes`. `version_key` names the
    key column of the versions where it differs.

    `hot` names the keys whose timelines are cut into buckets, a table as `hot_keys` gives it (None: no key); others are one bucket, have
    no seed rows, and move once. Facts without a key are always spread.
    """
    owner = version_key or key
    payload = F.struct(*[F.col(c) for c in facts.columns])
    version = F.struct(*[F.col(a) for a in attributes])
    ranking = F.struct(F.col(valid_from), *rank)
    clean = versions.where(F.col(owner).isNotNull() & F.col(valid_from).isNotNull())

    def in_buckets(df: DataFrame, name: str, at: str) -> DataFrame:
        cut = _with_bucket(df, at, unit, [name], busy, [key])
        if isinstance(hot, str):
            return cut
        if hot is None:
            return cut.withColumn(BUCKET, F.when(F.col(name).isNull(), F.col(BUCKET)))
        marked = cut.join(F.broadcast(hot.select(F.col(key).alias("__hot"))), F.col(name) == F.col("__hot"), "left")
        return marked.withColumn(BUCKET, F.when(F.col("__hot").isNotNull() | F.col(name).isNull(), F.col(BUCKET))).drop("__hot")

    vers = in_buckets(clean, owner, valid_from).select(
        F.col(owner).alias("__key"),
        BUCKET,
        F.struct(ranking.alias("rank"), version.alias("version")).alias("__v"),
    )
    placed = in_buckets(facts.withColumn("__fact", payload), key, ts)
    when = facts.schema[ts].dataType
    nothing = F.lit(None).cast(facts.select(payload.alias("p")).schema["p"].dataType)
    stream = (
        placed.select(
            F.col(key).alias("__key"),
            BUCKET,
            F.col(ts).alias("__t"),
            F.lit(2).alias("__side"),
            "__fact",
            F.lit(None).cast(vers.schema["__v"].dataType).alias("__v"),
        )
        .unionByName(
            vers.select("__key", BUCKET, F.col("__v.rank")[valid_from].cast(when).alias("__t"), F.lit(1).alias("__side"),
                        nothing.alias("__fact"), "__v")
        )
    )
    if hot is not None:
        spots = placed.select(F.col(key).alias("__key"), BUCKET).where(F.col("__key").isNotNull() & F.col(BUCKET).isNotNull())
        earlier = W.partitionBy("__key").orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
        seeds = (
            spots.distinct()
            .withColumn("__v", F.lit(None).cast(vers.schema["__v"].dataType))
            .unionByName(vers.where(F.col(BUCKET).isNotNull()).select("__key", BUCKET, "__v"))
            .groupBy("__key", BUCKET)
            .agg(F.max("__v").alias("__v"))
            .withColumn("__v", F.last("__v", ignorenulls=True).over(earlier))
            .where(F.col("__v").isNotNull())
        )
        stream = stream.unionByName(
            seeds.select("__key", BUCKET, F.col(BUCKET).cast(when).alias("__t"), F.lit(0).alias("__side"),
                         nothing.alias("__fact"), "__v")
        )
    so_far = (
        W.partitionBy("__key", BUCKET)
        .orderBy("__t", "__side", "__v.rank")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        stream.withColumn("__v", F.last("__v", ignorenulls=True).over(so_far))
        .where(F.col("__side") == 2)
        .select("__fact.*", F.col("__v.version").alias("__version"))
    )
