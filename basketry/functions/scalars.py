"""Scalar helpers; each returns a Column made of built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.config import NIGHT, NULL_KEY_TEXT

MONEY = "decimal(18,4)"

# Text formats of the raw feeds.
EVENT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS] 'Z'"
SOURCE_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
DATE_FORMAT = "yyyy-MM-dd"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """Ratio as double; null when the divisor is zero or null."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def surrogate_key(*cols: Column | str) -> Column:
    """Lower-hex MD5 over the text of the columns, with a marker for null.

    Decimals and timestamps must come in with a fixed type so their text is stable; timestamps are
    written in UTC and need a UTC session.
    """
    parts = [key_text(c) for c in cols]
    return F.md5(F.concat_ws("||", *parts))


def key_text(c: Column | str) -> Column:
    """The text from which `surrogate_key` of one column is made: rows with the same text have the same key."""
    return F.coalesce(_col(c).cast("string"), F.lit(NULL_KEY_TEXT))


def pack_key(c: Column | str) -> Column:
    """A text in fewer bytes, equal for equal texts only: 32 hex digits as 16 bytes, other texts as they are or with a byte added.

    For keys that move or are stored; `unpack_key` gives the text back.
    """
    text = _col(c).cast("string")
    plain = text.cast("binary")
    # no other text has 16 bytes
    other = F.when(F.octet_length(text) < 16, plain).otherwise(F.concat(plain, F.lit(bytearray(1))))
    return F.when(text.rlike("^[0-9a-f]{32}$") & (F.octet_length(text) == 32), F.unhex(text)).otherwise(other)


def short_key(df: DataFrame, name: str) -> Column:
    """The packed form of a column of texts, another column as it is; for keys that are counted and not shown."""
    return pack_key(name).alias(name) if df.schema[name].dataType == T.StringType() else F.col(name)


def unpack_key(c: Column | str) -> Column:
    packed = _col(c)
    size = F.octet_length(packed)
    other = F.when(size < 16, packed).otherwise(F.substring(packed, F.lit(1), size - 1))
    return F.when(size == 16, F.lower(F.hex(packed))).otherwise(other.cast("string"))


def utc_text(ts: Column | str) -> Column:
    """Timestamp as text with its offset, the form used inside version keys."""
    return F.concat(_col(ts).cast("string"), F.lit("+00"))


def parse_event_time(c: Column | str) -> Column:
    return F.try_to_timestamp(_col(c), F.lit(EVENT_TIME_FORMAT))


def parse_source_time(c: Column | str) -> Column:
    return F.try_to_timestamp(_col(c), F.lit(SOURCE_TIME_FORMAT))


def parse_date(c: Column | str) -> Column:
    return F.try_to_timestamp(_col(c), F.lit(DATE_FORMAT)).cast("date")


def try_money(c: Column | str) -> Column:
    return _col(c).try_cast(MONEY)


def local_time(ts: Column | str, zone: str) -> Column:
    """Civil time of an instant in the business zone (daylight saving included)."""
    return F.from_utc_timestamp(_col(ts), zone)


def month_of(d: Column | str) -> Column:
    return F.trunc(_col(d), "month")


def sunday_week(d: Column | str) -> Column:
    """Week of year 0..53 with weeks starting on Sunday (not the ISO week)."""
    day = _col(d)
    return F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7).cast("long")


def daypart(hour: Column | str, buckets) -> Column:
    """Label of the bucket an hour falls into; everything outside is night."""
    h = _col(hour)
    out = None
    for first, last, label in buckets:
        hit = h.between(first, last)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(NIGHT)


def preferred_name(fallback: str | None = None) -> Column:
    """Product name of an order-item row: preferred, else English, else German."""
    names = [F.col("item_name_preferred"), F.col("item_name_en"), F.col("item_name_de")]
    if fallback is not None:
        names.append(F.lit(fallback))
    return F.coalesce(*names)


def plain_number(c: Column | str, digits: int = 2) -> Column:
    """Rounded number as text without trailing zeros, e.g. 45.50 -> '45.5', 3.00 -> '3'."""
    rounded = F.round(_col(c).cast("double"), digits).cast(f"decimal(38,{digits})")
    text = rounded.cast("string")
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text
