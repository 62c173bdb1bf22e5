import datetime as dt
import random

UTC = dt.timezone.utc


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def timeline(seed: int, n: int = 600, keys: int = 5, hot: float = 0.4) -> list[tuple]:
    """Rows (key, ts, id, value) in which one key holds a large share and times repeat."""
    rnd = random.Random(seed)
    start = dt.datetime(2023, 1, 1)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else f"k{rnd.randrange(keys)}"
        ts = start + dt.timedelta(minutes=20 * rnd.randrange(300))
        rows.append((key, ts, f"id{i:05d}", rnd.choice([None, "a", "b", "c"])))
    return rows


def rows(df, *order: str) -> list[tuple]:
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def partition_filters(df) -> str:
    """What the first scan of the plan prunes partitions by; the text of long lists is cut."""
    return plan(df).split("PartitionFilters: [")[1].split("PushedFilters")[0]
