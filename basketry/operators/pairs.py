"""Basket pairs without joining orders to themselves.

Each order is reduced to the sorted set of its members (categories, or the selected top products: both are
small vocabularies). Equal sets are counted, and only the distinct sets are expanded to pairs, weighted by
their count. Pair work therefore depends on how many different baskets exist, not on how many orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.config import Settings
from basketry.functions import safe_divide, short_key
from basketry.operators.joins import with_totals


def basket_sets(rows: DataFrame, basket: str, member: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of baskets per distinct member set (and per `by` columns): columns by, members, baskets."""
    sets = rows.groupBy(*by, short_key(rows, basket)).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return sets.groupBy(*by, "members").agg(F.count(F.lit(1)).alias("baskets"))


def _expand(sets: DataFrame, by: Sequence[str], keep: Column) -> DataFrame:
    left = sets.select(*by, "members", "baskets", F.explode("members").alias("a"))
    both = left.select(*by, "baskets", "a", F.explode("members").alias("b"))
    return both.where(keep).groupBy(*by, "a", "b").agg(F.sum("baskets").alias("pair_orders"))


def unordered_pairs(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Baskets holding both members, a < b: columns by, a, b, pair_orders."""
    return _expand(sets, by, F.col("a") < F.col("b"))


def directed_pairs(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Baskets holding both members, for every ordered pair a <> b."""
    return _expand(sets, by, F.col("a") != F.col("b"))


def member_counts(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Baskets holding each member: columns by, a, orders."""
    single = sets.select(*by, "baskets", F.explode("members").alias("a"))
    return single.groupBy(*by, "a").agg(F.sum("baskets").alias("orders"))


def basket_pairs(rows: DataFrame, basket: str, member: str) -> DataFrame:
    return unordered_pairs(basket_sets(rows, basket, member))


def attach_pairs(rows: DataFrame, basket: str, member: str, by: Sequence[str] = ()) -> DataFrame:
    return directed_pairs(basket_sets(rows, basket, member, by), by)


def affinity_scores(
    pairs: DataFrame, singles: DataFrame, total: DataFrame, cfg: Settings = Settings()
) -> DataFrame:
    """Support, confidence, lift and the action bucket of each pair.

    `pairs` has a, b, pair_orders; `singles` has a, orders; `total` is one row with total_orders.
    """
    left = singles.select("a", F.col("orders").alias("a_orders"))
    right = singles.select(F.col("a").alias("b"), F.col("orders").alias("b_orders"))
    scored = with_totals(pairs.join(left, "a").join(right, "b"), total)
    share_a, share_b = safe_divide("a_orders", "total_orders"), safe_divide("b_orders", "total_orders")
    scored = (
        scored.withColumn("a_order_penetration", share_a)
        .withColumn("b_order_penetration", share_b)
        .withColumn("support", safe_divide("pair_orders", "total_orders"))
        .withColumn("confidence_a_to_b", safe_divide("pair_orders", "a_orders"))
        .withColumn("confidence_b_to_a", safe_divide("pair_orders", "b_orders"))
        .withColumn("expected_support_independent", F.col("a_order_penetration") * F.col("b_order_penetration"))
        .withColumn("expected_pair_orders_independent", F.col("expected_support_independent") * F.col("total_orders"))
        .withColumn("lift", safe_divide("support", "expected_support_independent"))
    )
    delta = F.col("pair_orders") - F.col("expected_pair_orders_independent")
    scored = scored.withColumn("pair_orders_vs_expected_delta", delta).withColumn(
        "pair_orders_vs_expected_pct", safe_divide(delta, "expected_pair_orders_independent")
    )
    return with_action(scored, cfg)


def with_action(scored: DataFrame, cfg: Settings) -> DataFrame:
    lift, support = F.col("lift"), F.col("support")
    strong, common = lift >= cfg.strong_lift, support >= cfg.high_support
    neutral = lift.between(cfg.neutral_lift_low, cfg.neutral_lift_high)
    # Rank and label of each action bucket.
    label = (
        F.when(strong & common, "Strong Affinity (Bundle Candidate)")
        .when(strong, "Niche Affinity")
        .when(common & neutral, "Popularity Effect (Lift ~ 1)")
        .when(lift < cfg.neutral_lift_low, "Substitution / Avoidance")
        .otherwise("Monitor")
    )
    rank = (
        F.when(strong & common, 1)
        .when(strong, 2)
        .when(common & neutral, 3)
        .when(lift < cfg.neutral_lift_low, 5)
        .otherwise(4)
    )
    return scored.withColumn("actionability_bucket", label).withColumn(
        "actionability_rank", rank.cast("long")
    )
