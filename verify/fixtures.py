"""Adapters that derive the raw feeds of the library from the given TPC-H-like tables.

All of them are row-wise or keyed by existing keys, so they grow with the tables. `verify/oracle_base.py` states
the same rules in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
EPOCH_1995 = 788_918_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_text(seconds: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(" Z"))


def raw_item_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five published versions per part, with repeats, conflicts, bad prices and bad times."""
    p = F.col("p")
    base = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("p"), "p_name", "p_brand", "p_type",
        F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"),
        F.explode(F.sequence(F.lit(0), F.lit(4))).alias("v"),
    )
    v = F.col("v")
    # a republished version repeats the price of the version before it
    step = F.when((p % 3 == 0) & v.isin(2, 4), v - 1).otherwise(v)
    cents = F.expr("cents * (100 + 5 * step) div 100")
    cents = cents * F.when((p % 29 == 0) & (v == 3), 6).otherwise(1)
    cents = F.when((p % 13 == 0) & (v == 2), None).when((p % 17 == 0) & (v == 1), -cents).otherwise(cents)
    shaped = base.withColumn("step", step).select(
        "p",
        "v",
        F.concat(F.lit("L"), p.cast("string"), F.lit("-"), v.cast("string")).alias("log_item_id"),
        F.concat(F.lit("I"), p.cast("string")).alias("item_key"),
        (F.lit(EPOCH_1995) + (v * 450 + p % 97) * DAY + (p % 24) * 3600).cast("long").alias("at"),
        cents.cast("long").alias("cents"),
        F.when(p % 19 != 0, F.col("p_name")).alias("en"),
        F.when(p % 400 != 3, F.concat(F.lit("de "), F.col("p_name"))).alias("de"),
        F.when(p % 31 == 0, None).when(p % 37 == 0, F.lit(" ")).otherwise(F.col("p_brand")).alias("brand"),
        F.when(p % 40 == 7, None)
        .when((p % 50 == 0) & (v >= 3), F.lit("SEASONAL"))
        .otherwise(F.col("p_type"))
        .alias("category"),
        (p % 6 + 1).alias("pieces"),
        F.when(p % 23 != 0, 50 + p % 450).alias("grams"),
        F.when(p % 2 == 0, F.lit("7.00")).otherwise(F.lit("19.00")).alias("vat"),
    ).withColumn("src", F.col("at") - DAY)
    # names are missing altogether for a few items
    shaped = shaped.withColumn("en", F.when(p % 400 != 3, F.col("en")))
    repeat = shaped.where((p % 7 == 0) & (v == 1)).select(
        *[c for c in shaped.columns if c not in ("at", "cents")],
        (F.col("at") - 7200).alias("at"), (F.abs("cents") + 100).alias("cents"),
    )
    rival = shaped.where((p % 11 == 0) & (v == 2)).select(
        *[c for c in shaped.columns if c not in ("log_item_id", "src", "cents")],
        F.concat(F.lit("X"), p.cast("string")).alias("log_item_id"),
        (F.col("src") + 2 * DAY).alias("src"),
        (F.coalesce("cents", F.lit(5000)) + 300).alias("cents"),
    )
    timeless = shaped.where((p % 43 == 0) & (v == 0)).select(
        *[c for c in shaped.columns if c not in ("log_item_id", "at")],
        F.concat(F.lit("N"), p.cast("string")).alias("log_item_id"), F.lit(None).cast("long").alias("at"),
    )
    rows = reduce(DataFrame.unionByName, [shaped, repeat, rival, timeless])
    price = (F.col("cents").cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)")
    payload = F.to_json(
        F.struct(
            F.array(F.struct(price.cast("string").alias("product_base_price"), F.col("vat").alias("vat_rate_in_percent"))).alias("price_attributes"),
            F.array(
                F.struct(F.lit("en").alias("lang"), F.col("en").alias("value")),
                F.struct(F.lit("de").alias("lang"), F.col("de").alias("value")),
            ).alias("name"),
            F.col("brand").alias("brand_name"),
            F.when(p % 2 == 0, F.col("category")).alias("item_category_en"),
            F.col("category").alias("item_category"),
            F.col("pieces").alias("number_of_units"),
            F.col("grams").alias("weight_in_grams"),
            F.date_format(F.timestamp_seconds("src"), "yyyy-MM-dd HH:mm:ss").alias("time_item_created_in_source_utc"),
        )
    )
    return rows.select(
        "log_item_id",
        "item_key",
        F.coalesce(_event_text(F.col("at")), F.lit("bad time")).alias("time_log_created_utc"),
        payload.alias("payload"),
    )


def raw_promos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular, overlapping, long, repeated, malformed and unknown-item promotions."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    p = F.col("p")

    def rows(cond: Column, item: Column, start: Column, end: Column, kind: str, pct: Column) -> DataFrame:
        return part.where(cond).select(
            start.cast("string").alias("promo_start_date"),
            end.cast("string").alias("promo_end_date"),
            item.alias("item_key"),
            F.lit(kind).alias("promo_type"),
            pct.cast("string").alias("discount_in_percentage"),
        )

    item = F.concat(F.lit("I"), p.cast("string"))
    start = F.date_add(F.lit("1996-01-01").cast("date"), (p % 300).cast("int"))
    day = lambda text: F.lit(text).cast("date")
    regular = (p % 5 == 0, item, start, F.date_add(start, 180), "discount", 10 + (p % 4) * 10)
    return reduce(
        DataFrame.unionByName,
        [
            rows(*regular),
            rows(regular[0] & (p % 500 == 0), *regular[1:]),
            rows(p % 10 == 0, item, F.date_add(start, 90), F.date_add(start, 270), "bundle", 10 + (p % 3) * 10),
            rows(p % 97 == 0, item, day("1999-03-10"), day("2001-06-20"), "loyalty", F.lit(5)),
            rows(p % 250 == 0, item, day("1998-02-01"), day("1998-02-15"), "clearance", F.lit(95)),
            rows(
                p % 200 == 0, F.concat(F.lit("U"), p.cast("string")), day("1997-01-01"), day("1997-01-31"),
                "discount", F.when(p % 400 == 0, 120).otherwise(92),
            ),
            rows(p % 600 == 1, item, F.lit("not a date"), day("1997-05-01"), "discount", F.lit(15)),
        ],
    )


def order_seconds() -> Column:
    return F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 7919 % DAY


def raw_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One purchase log per order; a few with an unreadable time or total."""
    k = F.col("o_orderkey")
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 997 == 0, F.lit("unknown")).otherwise(_event_text(order_seconds())).alias("time_order_received_utc"),
        F.concat(F.lit("P"), k.cast("string")).alias("purchase_key"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer_key"),
        (100 + k * 31 % 9000).cast("string").alias("delivery_distance_line_meters"),
        ((k % 5).cast("decimal(9,0)") * F.lit("0.50").cast("decimal(3,2)")).cast("string").alias("service_fee"),
        (F.lit("2.00").cast("decimal(5,2)") + (k % 7).cast("decimal(9,0)") * F.lit("0.25").cast("decimal(3,2)"))
        .cast("string").alias("courier_base_fee"),
        F.when(k % 1499 == 0, F.lit("n/a")).otherwise(total).alias("total_basket_value"),
        F.lit("[]").alias("item_basket_description"),
    )


def raw_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basket JSON per order line: the line's units in two entries of the same item, plus an empty entry.

    Built row by row (no grouping), so a very large order does not gather in one place.
    """
    item = F.concat(F.lit("I"), F.col("l_partkey").cast("string"))
    units = F.col("l_quantity").cast("long")

    def entry(key: Column, count: Column) -> Column:
        return F.struct(key.alias("item_key"), count.alias("item_count"))

    no_key = F.lit(None).cast("string")
    basket = F.array(entry(item, units - 1), entry(item, F.lit(1).cast("long")), entry(no_key, F.lit(3).cast("long")))
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("purchase_key"),
        F.to_json(basket).alias("item_basket_description_raw"),
    )


def event_item_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged-shape item logs from the event stream: two rows per log id, same-hour conflicts, bad prices."""
    e = F.col("event_id")
    value = F.col("value").cast("decimal(18,2)")
    price = F.when(e % 7 == 0, None).when(e % 11 == 0, -value).otherwise(value)
    ts = F.col("ts").cast("timestamp")
    text = lambda: F.lit(None).cast("string")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), F.lpad(F.expr("event_id div 2").cast("string"), 12, "0")).alias("log_item_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("item_key"),
        F.date_trunc("hour", ts).alias("time_log_created_utc"),
        text().alias("item_name_en"),
        text().alias("item_name_de"),
        text().alias("item_name_preferred"),
        text().alias("brand_name"),
        F.col("event_type").alias("item_category"),
        F.lit(None).cast("long").alias("number_of_units"),
        F.lit(None).cast("long").alias("weight_in_grams"),
        price.cast("decimal(18,4)").alias("product_base_price_gross_eur"),
        F.lit(None).cast("decimal(18,4)").alias("vat_rate_pct"),
        ts.alias("time_item_created_in_source_utc"),
        F.lpad(e.cast("string"), 12, "0").alias("payload_raw"),
    )


def date_bounds(df: DataFrame, column: str) -> tuple[str, str]:
    """First and last day of a column, as text."""
    low, high = df.agg(F.min(column).cast("date").cast("string"), F.max(column).cast("date").cast("string")).first()
    return low, high
