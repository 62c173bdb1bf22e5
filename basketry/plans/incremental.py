"""Incremental runs of the core tables: watermarks, lookback window, backfill and full refresh."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.config import Settings
from basketry.functions import surrogate_key
from basketry.operators.curation import curate_purchases
from basketry.operators.enrich import orders_with_rollups
from basketry.operators.history import item_scd2
from basketry.operators.joins import restrict_to_keys
from basketry.operators.staging import explode_basket, stage_item_logs, stage_promos, stage_purchase_logs
from basketry.operators.temporal import disjoint_windows, interval_lookup
from basketry.operators.timeline import busy_spots, split_row_number
from basketry.operators.upsert import RunLog, WatermarkStore, drop_table, in_partitions, replace_table, table_exists, upsert, upsert_table
from basketry.plans import core, reporting
from basketry.session import materialize
from basketry.streaming.curate import EVENT_DAY, curated_rows, merge_batch

PARTITION = "part_date"
# tables of a run, in the order of the run log
MODELS = ("int_purchases", "int_item_logs", "int_promoted", "fct_order", "dim_customer", "dim_item_current", "dim_promo", "rpt_category_monthly", "rpt_customer_promo")


class CoreTables:
    """Curated purchases, item-log state, facts and dimensions under one root folder.

    A run takes in what is new and restates what that changes, and reads only that:

    * Item logs are folded into their state; the items of which a log changed get their history and current version anew.
    * Purchases from the cutoff on (watermark minus lookback) are taken, and older ones that hold a line of an item at a time at
      which its versions or promotions have changed. These times are disjoint intervals per item; the dates they cover select
      the partitions of the stored lines that are looked at.
    * Orders of these purchases are built from their lines. Later orders of their customers only get a new number, counted on
      from the orders before them, so a customer with very many orders, or all orders without a customer, is not restated whole.
    * The monthly category report is made anew for the months of these orders, the promotion behaviour for their customers.
    * What a table writes is limited to the partitions that hold or receive these rows.

    A deeper backfill is a larger `lookback_days`; `full_refresh` drops the tables first. `grain` is the partition grain of the dated
    tables, "day" or "month".
    """

    def __init__(self, spark: SparkSession, root: str, cfg: Settings = Settings(), grain: str = "day"):
        self.spark, self.root, self.cfg, self.grain = spark, root, cfg, grain
        self.watermarks = WatermarkStore(spark, f"{root}/_watermarks", cfg)
        self.runs = RunLog(spark, f"{root}/_runs", cfg)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return table_exists(self.spark, self.path(name))

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        return df.drop(PARTITION)

    def part_date(self, date: str) -> Column:
        """Partition of a date."""
        day = F.col(date).cast("date")
        return F.trunc(day, "month") if self.grain == "month" else day

    def _from(self, date: dt.date) -> Column:
        """Literal predicate for the partitions from a date on."""
        return F.col(PARTITION) >= F.lit(date.replace(day=1) if self.grain == "month" else date)

    def _in_dates(self, name: str, dates: list) -> DataFrame:
        """The rows of a dated table in these partitions; the scan lists only their folders."""
        return self.spark.read.parquet(self.path(name)).where(in_partitions(PARTITION, dates)).drop(PARTITION)

    def _cutoff(self, name: str, column: str, lookback_days: int | None) -> dt.datetime | None:
        """None on the first load, and where a first load stopped before its watermark was set: everything is read."""
        if not self.exists(name):
            return None
        if self.cfg.watermarks_enabled and not self.watermarks.known(name):
            return None
        return self.watermarks.cutoff(name, self.table(name), column, lookback_days)

    def _merge(self, name: str, rows: DataFrame, keys: list[str], gone: DataFrame | None = None) -> None:
        upsert_table(self.spark, self.path(name), rows, keys, gone=gone)

    def _merge_dated(self, name: str, rows: DataFrame, keys: list[str], date: str, stored_in: list, gone: DataFrame | None = None) -> None:
        dated = rows.withColumn(PARTITION, self.part_date(date))
        upsert_table(self.spark, self.path(name), dated, keys, PARTITION, gone=gone, stored_in=stored_in)

    def _dates(self, rows: DataFrame, date: str) -> list:
        """Partitions of the rows; an entry per date at most."""
        return [r[0] for r in rows.select(self.part_date(date).alias("d")).distinct().collect()]

    # ------------------------------------------------------------------------------------ what has changed

    def _differing(self, name: str, rows: DataFrame, items: DataFrame | None = None) -> DataFrame | None:
        """Rows that only the stored or only the new version of a table has; with `items` only theirs are compared."""
        if not self.exists(name):
            return None
        before = self.table(name).select(*rows.columns)
        if items is not None:
            before = restrict_to_keys(before, items.select("item_key"), "item_key")
        return before.exceptAll(rows).unionByName(rows.exceptAll(before))

    def changed_times(self, windows: DataFrame, start: str, end: str) -> DataFrame:
        """(item_key, segment_from, segment_to): disjoint intervals covered by the windows."""
        unit = "month" if windows.schema[start].dataType == T.DateType() else self.cfg.split_unit
        return materialize(disjoint_windows(windows, "item_key", start, end, F.lit(True), unit).drop("choice"), "changed-times")

    def dates_covered(self, times: DataFrame) -> list:
        """Partitions of stored lines that the intervals touch, out of those between the table's first and last."""
        have = self.spark.read.parquet(self.path("int_promoted")).agg(F.min(PARTITION).alias("lo"), F.max(PARTITION).alias("hi")).first()
        if have["lo"] is None:
            return []
        # a day more on both sides: intervals may be in UTC, partitions are local dates
        first = F.greatest(F.date_sub(F.col("segment_from").cast("date"), 1), F.lit(have["lo"]))
        last = F.least(F.date_add(F.col("segment_to").cast("date"), 1), F.last_day(F.lit(have["hi"])))
        monthly = self.grain == "month"
        ranges = times.select((F.trunc(first, "month") if monthly else first).alias("a"), last.alias("b")).where("a <= b").distinct()
        step = F.expr("interval 1 month" if monthly else "interval 1 day")
        return [r[0] for r in ranges.select(F.explode(F.sequence("a", "b", step)).alias("d")).distinct().collect()]

    def lines_met(self, times: DataFrame, at: str) -> DataFrame:
        """(purchase_key, order_date_utc) of stored lines of an item inside its intervals."""
        lines = self._in_dates("int_promoted", self.dates_covered(times)).select("purchase_key", "item_key", "order_date_utc", at)
        seen = times.withColumn("seen", F.lit(True))
        met = interval_lookup(lines, seen, "item_key", at, "segment_from", "segment_to", ["seen"], (), self.cfg)
        return met.where("seen").select("purchase_key", "order_date_utc").distinct()

    def _restated(self, windows: DataFrame | None, start: str, end: str, at: str) -> DataFrame | None:
        """Stored purchases with a line at a time at which the versions or promotions of its item have changed."""
        if windows is None or not self.exists("int_promoted"):
            return None
        met = materialize(self.lines_met(self.changed_times(windows, start, end), at), "lines-met")
        stored = self._in_dates("int_purchases", self._dates(met, "order_date_utc"))
        return restrict_to_keys(stored, met.select("purchase_key"), "purchase_key")

    # ------------------------------------------------------------------------------------------------ orders

    def _orders(self, recent: DataFrame, promoted: DataFrame, before: DataFrame | None) -> DataFrame:
        """Orders to write: those of `recent` from their lines, and later ones of their customers if the numbers change.

        `before` holds the stored orders of `recent`. Numbers change from the first order on that is new or has moved to another
        time or customer; they go on from the count of the orders before it. Other orders keep their number.
        """
        fresh = core.fct_order(orders_with_rollups(recent, promoted, self.cfg), self.cfg)
        if before is None:
            return fresh
        columns = fresh.columns
        number, is_first = "customer_order_number", "is_first_order_for_customer"
        place = ["customer_sk", "order_ts_utc"]
        was = before.select("order_sk", F.struct(*place, F.col(number).alias("number")).alias("was"))
        fresh = materialize(fresh.drop(number, is_first).join(was, "order_sk", "left"), "fresh-orders")
        unmoved = reduce(lambda a, b: a & b, [F.col(c) == F.col("was")[c] for c in place])
        moved = fresh.where(~F.coalesce(unmoved, F.lit(False)))
        times = moved.select(*place).unionByName(moved.where("was is not null").select("was.customer_sk", "was.order_ts_utc"))
        since = materialize(times.groupBy("customer_sk").agg(F.min("order_ts_utc").alias("since")), "renumbered-customers")
        first = since.agg(F.date_sub(F.min("since").cast("date"), 1)).first()[0]

        fresh = fresh.join(since, "customer_sk", "left")
        renumber = F.coalesce(F.col("order_ts_utc") >= F.col("since"), F.lit(False))
        keys = fresh.select("order_sk")
        path = self.spark.read.parquet(self.path("fct_order"))
        from_first = self._from(first) if first else F.lit(False)
        held = path.where(from_first).drop(PARTITION).join(since, "customer_sk").where("order_ts_utc >= since").join(keys, "order_sk", "left_anti")
        unnumbered = [c for c in columns if c not in (number, is_first)]
        later = fresh.where(renumber).select(*unnumbered).unionByName(held.select(*unnumbered))
        busy = busy_spots(later, ["customer_sk"], "order_ts_utc", self.cfg.split_unit, self.cfg.rows_per_task)
        ordered = split_row_number(later, ["customer_sk"], "order_ts_utc", ["purchase_key"], "place", self.cfg.split_unit, busy)
        earlier = path.select("order_sk", *place).join(since, "customer_sk").where("order_ts_utc < since").join(moved.select("order_sk"), "order_sk", "left_anti")
        offsets = earlier.groupBy("customer_sk").agg(F.count(F.lit(1)).alias("offset"))
        numbered = ordered.join(offsets, "customer_sk", "left").withColumn(number, F.col("place") + F.coalesce("offset", F.lit(0)))
        same = fresh.where(~renumber).withColumn(number, F.col("was.number"))
        both = numbered.select(*unnumbered, number).unionByName(same.select(*unnumbered, number))
        return both.withColumn(is_first, F.col(number) == 1).select(*columns)

    # ----------------------------------------------------------------------------------------------- reports

    def _in_months(self, name: str, months: list) -> DataFrame:
        return self.spark.read.parquet(self.path(name)).where(F.trunc(PARTITION, "month").isin(months)).drop(PARTITION)

    def _reports(self, months: list, buyers: DataFrame) -> None:
        """Category rows of the given months and promotion behaviour of the given customers, made anew from the facts."""
        if months:
            items = core.fct_order_item(self._in_months("int_promoted", months))
            rows = reporting.category_monthly(items, self._in_months("fct_order", months))
            # a category may have left a month: all rows of the month are replaced
            gone = self.spark.createDataFrame([(m,) for m in months], "order_month date")
            upsert_table(self.spark, self.path("rpt_category_monthly"), rows, ["order_month"], "order_month", gone=gone, stored_in=months)
        items = core.fct_order_item(restrict_to_keys(self.table("int_promoted"), buyers, "customer_sk"))
        behaviour = reporting.customer_promo_behavior(items, restrict_to_keys(self.table("fct_order"), buyers, "customer_sk"))
        self._merge("rpt_customer_promo", behaviour, ["customer_sk"], buyers)

    # --------------------------------------------------------------------------------------------------- run

    def run(
        self,
        raw: Mapping[str, DataFrame],
        run_id: str,
        now: dt.datetime,
        full_refresh: bool = False,
        lookback_days: int | None = None,
    ) -> None:
        """Fold the feeds `raw_item_logs`, `raw_promos`, `raw_purchases` and `raw_baskets` into the tables.

        What a run compares with (stored purchases, history, promotions, the journal of changed items) is replaced last, so a run
        that stopped anywhere can be repeated.
        """
        cfg, spark, journal = self.cfg, self.spark, self.path("_changed_items")
        if full_refresh:
            for name in (*MODELS, "int_item_scd2", "int_promo_segments", "_changed_items"):
                drop_table(spark, self.path(name))
        self.watermarks.ensure()
        self.runs.ensure()

        # all logs of the feed are looked at: one may come late, and its item's history decides the price of stored orders
        merge_batch(spark, stage_item_logs(raw["raw_item_logs"]), self.path("int_item_logs"), self.grain, journal)
        state = self.table("int_item_logs").drop(EVENT_DAY).withColumn("item_key_sk", surrogate_key("item_key"))
        items = None
        if self.exists("int_item_scd2"):
            changed = spark.read.schema("item_key string").parquet(journal) if table_exists(spark, journal) else spark.createDataFrame([], "item_key string")
            items = materialize(changed.distinct().withColumn("item_key_sk", surrogate_key("item_key")), "changed-items")
            state = restrict_to_keys(state, items.select("item_key_sk"), "item_key_sk")
        curated = materialize(curated_rows(state.drop("item_key_sk")), "curated-logs")
        changed_history = materialize(item_scd2(curated, cfg.split_unit, cfg.rows_per_task), "changed-history")
        history = changed_history
        if items is not None:
            history = materialize(upsert(self.table("int_item_scd2"), changed_history, ["item_key_sk"], gone=items), "history")
        segments = materialize(core.keyed_promo_segments(stage_promos(raw["raw_promos"])), "promo-segments")

        since = self._cutoff("int_purchases", "time_order_received_utc", lookback_days)
        fresh = materialize(curate_purchases(stage_purchase_logs(raw["raw_purchases"], cfg), cfg, since), "fresh-purchases")
        recent, known, before = fresh, None, None
        if self.exists("int_purchases"):
            stored = self.table("int_purchases")
            # where the purchases of the feed stand now; a corrected time moves them
            known = materialize(restrict_to_keys(stored.select("purchase_key", "customer_key", "order_date_utc", "order_date_berlin"), fresh.select("purchase_key"), "purchase_key"), "known-purchases")
            window = stored
            if since is not None:
                window = spark.read.parquet(self.path("int_purchases")).where(self._from(since.date()) & (F.col("time_order_received_utc") >= F.lit(since)))
            others = [
                window,
                self._restated(self._differing("int_item_scd2", changed_history, items), "valid_from_utc", "valid_to_utc", "time_order_received_utc"),
                self._restated(self._differing("int_promo_segments", segments), "segment_from", "segment_to", "order_date_berlin"),
            ]
            rest = reduce(DataFrame.unionByName, [o.select(*fresh.columns) for o in others if o is not None])
            rest = rest.dropDuplicates(["purchase_key"]).join(fresh, "purchase_key", "left_anti")
            recent = materialize(fresh.unionByName(rest), "recent-purchases")

        def held(date: str) -> list:
            """Partitions in which the restated purchases stand, before and after."""
            both = recent.select(date) if known is None else recent.select(date).unionByName(known.select(date))
            return self._dates(both, date)

        local = held("order_date_berlin")
        keys = recent.select(surrogate_key("purchase_key").alias("order_sk"))
        # only baskets of the purchases read in this run are opened
        lines = explode_basket(restrict_to_keys(raw["raw_baskets"], recent.select("purchase_key"), "purchase_key"))
        priced = core.order_items_with_price(lines, recent, history, cfg, disjoint=True)
        promoted = materialize(core.order_items_with_promo(priced, segments, cfg), "promoted")
        if self.exists("fct_order"):
            before = materialize(restrict_to_keys(self._in_dates("fct_order", local), keys, "order_sk"), "orders-before")
        orders = materialize(self._orders(recent, promoted, before), "orders")

        # the lines of a purchase are replaced as a set: a corrected basket may have lost some
        self._merge_dated("int_promoted", promoted, ["order_sk"], "order_date_berlin", local, keys)
        buyers = orders.select("customer_sk")
        if known is not None:
            buyers = buyers.unionByName(known.select(surrogate_key("customer_key").alias("customer_sk")))
        buyers = materialize(buyers.distinct(), "buyers")
        restated = [*local, *self._dates(orders, "order_date")]
        self._merge_dated("fct_order", orders, ["order_sk"], "order_date", restated, keys)
        customers = core.dim_customer(restrict_to_keys(self.table("fct_order"), buyers, "customer_sk"))
        self._merge("dim_customer", customers, ["customer_sk"], buyers)
        self._merge("dim_item_current", core.dim_item_current(changed_history), ["item_key_sk"], items)
        self._merge("dim_promo", core.dim_promo(stage_promos(raw["raw_promos"])), ["promo_sk"])
        self._reports(sorted({d.replace(day=1) for d in restated}), buyers)

        self._merge_dated("int_purchases", fresh, ["purchase_key"], "order_date_utc", held("order_date_utc"))
        self._replace("int_item_scd2", history)
        self._replace("int_promo_segments", segments)
        self.watermarks.put_all(
            {
                "int_item_logs": (curated, "time_log_created_utc"),
                "int_purchases": (fresh, "time_order_received_utc"),
                "fct_order": (orders, "order_ts_utc"),
                "fct_order_item": (promoted, "time_order_received_utc"),
                "dim_customer": (orders, "order_ts_utc"),
                "dim_item_current": (changed_history.where("is_current"), "valid_from_utc"),
            },
            now,
            raise_only=not full_refresh,
        )
        self.runs.put_all(run_id, MODELS, now, now)
        drop_table(spark, journal)

    def _replace(self, name: str, rows: DataFrame) -> None:
        if self.exists(name):
            replace_table(self.spark, self.path(name), rows)
        else:
            rows.write.parquet(self.path(name))

    def fct_order_item(self) -> DataFrame:
        return core.fct_order_item(self.table("int_promoted"))
