import datetime as dt
import hashlib

from pyspark.sql import functions as F

from basketry import functions as fn
from basketry.config import DAYPARTS_FOUR


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("out")).first()[0]


def test_safe_divide(spark):
    assert one(spark, fn.safe_divide("a", "b"), a=3, b=2) == 1.5
    assert one(spark, fn.safe_divide("a", "b"), a=3, b=0) is None


def test_surrogate_key_marks_null(spark):
    got = one(spark, fn.surrogate_key(F.lit("p1"), F.lit(None).cast("string")))
    assert got == hashlib.md5(b"p1||_dbt_null_").hexdigest()


def test_sunday_week_equals_strftime(spark):
    days = [dt.date(2018, 12, 20) + dt.timedelta(days=i) for i in range(0, 1500)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", fn.sunday_week("d").alias("w"))
    assert all(r.w == int(r.d.strftime("%U")) for r in df.collect())


def test_parsing_never_fails(spark):
    assert one(spark, fn.parse_event_time("t"), t="2023-05-01 10:00:00.25 Z") == dt.datetime(2023, 5, 1, 10, 0, 0, 250000)
    assert one(spark, fn.parse_event_time("t"), t="2023-05-01 10:00:00 Z") == dt.datetime(2023, 5, 1, 10)
    assert one(spark, fn.parse_event_time("t"), t="2023-05-01T10:00") is None
    assert one(spark, fn.parse_date("t"), t="2023-02-30") is None
    assert one(spark, fn.try_money("t"), t="n/a") is None


def test_local_time_follows_daylight_saving(spark):
    summer = F.lit("2023-07-01 22:30:00").cast("timestamp")
    winter = F.lit("2023-12-01 22:30:00").cast("timestamp")
    assert one(spark, fn.local_time(summer, "Europe/Berlin")) == dt.datetime(2023, 7, 2, 0, 30)
    assert one(spark, fn.local_time(winter, "Europe/Berlin")) == dt.datetime(2023, 12, 1, 23, 30)


def test_daypart_edges(spark):
    hours = spark.range(24).select(F.col("id"), fn.daypart("id", DAYPARTS_FOUR).alias("p")).collect()
    got = {r.id: r.p.split(" ")[0] for r in hours}
    assert [got[h] for h in (5, 6, 10, 11, 16, 17, 22, 23)] == [
        "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Night"
    ]


def test_plain_number(spark):
    for value, text in ((45.5, "45.5"), (3.0, "3"), (100.0, "100"), (0.126, "0.13"), (12345678.9, "12345678.9")):
        assert one(spark, fn.plain_number("v"), v=value) == text


def test_sample_values_is_sorted_distinct_and_bounded(spark):
    df = spark.createDataFrame([(f"{i % 7}",) for i in range(100)] + [(None,)], "v string")
    assert fn.sample_values(df, "v", 3).first()[0] == ["0", "1", "2"]
    assert fn.sample_values(df.where("v = 'x'"), "v", 3).first()[0] == []


def test_distinct_list(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert df.agg(fn.distinct_list("v")).first()[0] == "a, b"
