"""Raw feeds: every column a string, explicit schema, header skipped, quoted newlines allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.config import Settings

ITEM_LOG_COLUMNS = ("log_item_id", "item_key", "time_log_created_utc", "payload")
PROMO_COLUMNS = (
    "promo_start_date",
    "promo_end_date",
    "item_key",
    "promo_type",
    "discount_in_percentage",
)
PURCHASE_COLUMNS = (
    "time_order_received_utc",
    "purchase_key",
    "customer_key",
    "delivery_distance_line_meters",
    "service_fee",
    "courier_base_fee",
    "total_basket_value",
    "item_basket_description",
)


def string_schema(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _read_csv(spark: SparkSession, path: str, columns: tuple[str, ...], multi_line: bool) -> DataFrame:
    # Quoted newlines make one CSV file one task, so land such a feed as many files of moderate size.
    return (
        spark.read.schema(string_schema(columns))
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_item_logs(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, ITEM_LOG_COLUMNS, True)


def read_promos(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Promotions have no quoted newlines, so their files are split; `multi_line` reads a feed that has."""
    return _read_csv(spark, path, PROMO_COLUMNS, multi_line)


def read_purchase_logs(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, PURCHASE_COLUMNS, True)


def write_replace(df: DataFrame, path: str) -> DataFrame:
    """Full-replace load into the raw layer; returns the table as read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dev_date_window(df: DataFrame, column: str, cfg: Settings) -> DataFrame:
    """Keep rows of the development window [start, end); a no-op unless sampling is on."""
    if not cfg.dev_sampling:
        return df
    kind = df.schema[column].dataType
    c = F.col(column)
    return df.where((c >= F.lit(cfg.dev_start).cast(kind)) & (c < F.lit(cfg.dev_end).cast(kind)))
