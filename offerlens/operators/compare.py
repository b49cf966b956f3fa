"""Cross-retailer comparison: groups of equal products, best offers, spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import numbers
from offerlens.operators import dedupe, ranking


def comparison(offers: DataFrame, key: list[str], min_retailers: int = 2, shown: int = 4, pk: str = "offer_id") -> DataFrame:
    """Per group: retailers, offers, best and worst price, spread in percent and the `shown` cheapest offers' ids.

    Offers that share (key, dedupe_key) count once, the cheapest. The shown ids come from sorted slices of partial
    results, so a group's offers never meet in one list: the first step ranks within (key, dedupe_key).
    """
    one = offers.groupBy(*key, "dedupe_key").agg(F.min(F.struct("unit_price", pk, "retailer_key")).alias("o")).select(*key, "o.*")
    groups = one.groupBy(*key).agg(F.count_distinct("retailer_key").alias("retailer_count"), F.count("*").alias("offer_count"), F.min("unit_price").alias("best_price"), F.max("unit_price").alias("worst_price"), F.min(F.struct("unit_price", pk, "retailer_key")).alias("b"))
    return groups.filter((F.col("retailer_count") >= min_retailers) & (F.col("offer_count") >= 2)).select(
        *key, "retailer_count", "offer_count", F.least(F.col("offer_count"), F.lit(shown)).alias("shown_count"), "best_price", "worst_price",
        F.when(F.col("best_price") > 0, (F.col("worst_price") - F.col("best_price")) / F.col("best_price") * 100).alias("spread_percent"),
        F.col(f"b.{pk}").alias("best_offer_id"), F.col("b.retailer_key").alias("best_retailer"),
    )


def comparable() -> Column:
    """Offers that comparisons take: active, safe to compare, in a group and with a unit price."""
    return F.coalesce(F.col("is_active") & F.col("comparison_safe") & (F.col("comparison_group") != "") & F.col("unit_price").isNotNull(), F.lit(False))


def cards(offers: DataFrame, key: list[str], top: int = 8, shown: int = 4, min_retailers: int = 2, pk: str = "offer_id") -> DataFrame:
    """The `top` groups by retailers, offers and best price, each with its `shown` cheapest offers, their place and the gap to the best in percent.

    The group limit cuts each partition to `shown` rows before the shuffle; the groups that join are `top` at most.
    """
    one = dedupe.first_wins(offers, [*key, "dedupe_key"], ["unit_price", pk])
    groups = one.groupBy(*key).agg(F.count_distinct("retailer_key").alias("retailer_count"), F.count("*").alias("offer_count"), F.min("unit_price").alias("best_price"))
    best = groups.filter((F.col("retailer_count") >= min_retailers) & (F.col("offer_count") >= 2)).orderBy(F.desc("retailer_count"), F.desc("offer_count"), "best_price", *key).limit(top)
    out = ranking.top_per_group(one.join(F.broadcast(best), key), key, ["unit_price", pk], shown, "place")  # best has `top` rows
    gap = F.when(F.col("best_price") != 0, numbers.once((F.col("unit_price") - F.col("best_price")) / F.col("best_price") * 100, numbers.money)).otherwise(0.0)
    return out.withColumn("gap_percent", gap)
