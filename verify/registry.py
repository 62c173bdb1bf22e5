"""Registration of queries with their oracle, and the form in which results are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.config import Settings
from basketry.plans.build import RAW, Warehouse
from basketry.session import tune
from verify import fixtures
from verify.oracle_base import sql

# Names of the test data stand in for the shop's own categories and product names.
CFG = Settings(
    snack_category="SMALL",
    dip_category="LARGE",
    sweet_categories=("MEDIUM", "PROMO"),
    category_remaps=(("%red%", "RED GOODS"),),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_warehouses: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The tables built from one data folder; stored tables are written once per Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _warehouses:
        _warehouses[key] = Warehouse({n: getattr(fixtures, n)(spark, sf_dir) for n in RAW}, CFG)
    return _warehouses[key]


def comparable(df: DataFrame) -> DataFrame:
    """Plain types: decimals as double, doubles to six digits, times as text, arrays as joined text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def add(name: str, fn: Callable[[Warehouse, SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    """Register `fn(warehouse, spark, sf_dir)` under a name, with the statement that must give the same rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return comparable(fn(warehouse(spark, sf_dir), spark, sf_dir))

    QUERIES[name] = run
    if oracle is not None:
        ORACLE[name] = sql(oracle)
