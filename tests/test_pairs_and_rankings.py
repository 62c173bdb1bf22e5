import random
from collections import Counter
from itertools import combinations, permutations

from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.operators import pairs
from basketry.operators.joins import null_safe_join, with_totals
from basketry.operators.ranking import kpi_long, measure_rollup, top_n, top_n_per_group
from tests.helpers import rows


def baskets(seed=1, n=400):
    rnd = random.Random(seed)
    return [(f"o{rnd.randrange(80)}", rnd.choice("abcdef")) for _ in range(n)]


def sets_of(data):
    out = {}
    for order, member in data:
        out.setdefault(order, set()).add(member)
    return out


def test_pairs_equal_brute_force(spark):
    data = baskets()
    df = spark.createDataFrame(data, "o string, m string")
    sets = sets_of(data)
    undirected = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    directed = Counter(p for s in sets.values() for p in permutations(s, 2))
    assert {(a, b): n for a, b, n in rows(pairs.basket_pairs(df, "o", "m"))} == dict(undirected)
    assert {(a, b): n for a, b, n in rows(pairs.attach_pairs(df, "o", "m"))} == dict(directed)


def test_affinity_scores_and_buckets(spark):
    df = spark.createDataFrame(baskets(2), "o string, m string")
    sets = pairs.basket_sets(df, "o", "m")
    total = sets.agg(F.sum("baskets").alias("total_orders"))
    got = pairs.affinity_scores(pairs.unordered_pairs(sets), pairs.member_counts(sets), total, Settings()).collect()
    for r in got:
        assert abs(r.lift - (r.pair_orders * r.total_orders) / (r.a_orders * r.b_orders)) < 1e-9
        assert r.lift > 0 and 0 < r.support <= 1
        assert (r.actionability_rank == 5) == (r.lift < 0.9)


def test_measure_rollup_counts_distinct(spark):
    rnd = random.Random(3)
    data = [(rnd.choice(["g", "g", None]), f"o{o}", f"c{o % 20}", rnd.randrange(10), rnd.random() < 0.2)
            for o in (rnd.randrange(100) for _ in range(500))]
    df = spark.createDataFrame(data, "g string, order_sk string, customer_sk string, v long, flag boolean")
    got = {r.g: r for r in measure_rollup(df, ["g"], {"v": "v"}, {"flagged": F.col("flag")}).collect()}
    for g in ("g", None):
        part = [d for d in data if d[0] == g]
        assert got[g].v == sum(d[3] for d in part)
        assert got[g].orders == len({d[1] for d in part})
        assert got[g].customers == len({d[2] for d in part})
        assert got[g].flagged == len({d[1] for d in part if d[4]})
        per = Counter(c for c, _ in {(d[2], d[1]) for d in part})
        assert got[g].repeat_customers == sum(n > 1 for n in per.values())


def test_global_rollup_of_nothing_is_one_row(spark):
    df = spark.createDataFrame([], "order_sk string, customer_sk string, v long")
    assert tuple(measure_rollup(df, [], {"v": "v"}).first()) == (None, 0, 0, 0)


def test_rankings(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(20)] + [("b", i, 1) for i in range(2)], "g string, id long, v long")
    best = top_n_per_group(df, ["g"], [F.desc("v"), F.asc("id")], 3)
    assert rows(best.select("g", "id", "rank"), "g", "rank") == [("a", 2, 1), ("a", 5, 2), ("a", 8, 3), ("b", 0, 1), ("b", 1, 2)]
    assert [r[1] for r in rows(top_n(df, [F.desc("id")], 2, "rank").select("id", "rank"), "rank")] == [1, 2]


def test_null_safe_join_and_totals(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x long")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y long")
    assert sorted(rows(null_safe_join(left, right, ["k"])), key=str) == [("a", 1, 10), (None, 2, 20)]
    total = left.agg(F.sum("x").alias("t"))
    assert {r.t for r in with_totals(left, total).collect()} == {3}


def test_kpi_long_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1, None)], "k string, x long, y double")
    assert rows(kpi_long(df, ["k"], {"X Y": "x", "Z": "y"}, "m", "v"), "m") == [("a", "X Y", 1.0), ("a", "Z", None)]
