"""Aggregate tables: retailer coverage, category tree, retailer x category cube and its roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import text

# Active offers expected of a retailer; others 25.
COVERAGE_TARGETS = {"hofer": 60, "lidl": 100, "spar": 80, "billa": 90, "billa-plus": 90, "penny": 40, "adeg": 35, "dm": 35, "bipa": 45}


def coverage_target(key: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, n in COVERAGE_TARGETS.items():
        out = out.when(key == k, n)
    return out.otherwise(25)


def coverage(offers: DataFrame) -> DataFrame:
    """Per retailer: counts, sources, ratio to the target, signal, status, priority and reasons (no crawl log)."""
    base = offers.groupBy("retailer_key").agg(
        F.count("*").alias("offer_count"), F.count_if("is_active").alias("active_count"), F.count_if(F.col("is_active") & F.col("comparison_safe") & (F.col("price") > 0)).alias("usable_count"),
        F.count_distinct("source_id").alias("source_count"), F.min("valid_from").alias("first_from"), F.max("valid_to").alias("last_to"),
    )
    base = base.withColumn("target", coverage_target(F.col("retailer_key")))
    ratio = F.floor(F.col("active_count") / F.col("target") * 1000 + 0.5) / 1000
    base = base.withColumn("coverage_ratio", ratio)
    r, a = F.col("coverage_ratio"), F.col("active_count")
    signal = F.when(a == 0, "empty").when((r >= 1) & (F.col("source_count") >= 2), "strong").when(r >= 0.6, "medium").otherwise("weak")
    base = base.withColumn("signal", signal)
    reasons = F.array_compact(
        F.array(
            F.when(a == 0, "no-active-offers").when(r < 0.6, "far-below-target").when(r < 1, "below-target"),
            F.when(F.col("source_count") <= 1, "single-source"),
            F.when((F.col("offer_count") >= F.greatest(F.lit(20), F.col("target"))) & (a <= F.greatest(F.lit(5), F.floor(F.col("offer_count") * 0.2 + 0.5))), "mostly-inactive"),
        )
    )
    s = F.col("signal")
    points = F.when(s == "empty", 60).when(s == "weak", 40).when(s == "medium", 15).otherwise(0) + F.when(F.col("source_count") <= 1, 20).otherwise(0) + F.when(r < 0.35, 15).otherwise(0)
    status = F.when((s == "strong") & (F.size("reasons") == 0), "trusted").when(s.isin("empty", "weak"), "gap").otherwise("watch")
    return base.withColumn("reasons", reasons).withColumn("priority", points).withColumn("status", status)


def cube(offers: DataFrame) -> DataFrame:
    """Counts by retailer, main and subcategory: the finest level, from which the others roll up."""
    return offers.groupBy("retailer_key", "main_key", "sub_key").agg(F.count("*").alias("offer_count"), F.count_if("is_active").alias("active_count"), F.max("valid_to").alias("last_to"))


def roll_up(cells: DataFrame) -> DataFrame:
    """Main categories from cube cells, with the number of subcategories that have active offers."""
    subs = cells.groupBy("main_key", "sub_key").agg(F.sum("offer_count").alias("offers"), F.sum("active_count").alias("active"))
    return subs.groupBy("main_key").agg(F.sum("offers").alias("offer_count"), F.sum("active").alias("active_count"), F.count_if(F.col("active") > 0).alias("active_subs"))


def category_tree(offers: DataFrame) -> DataFrame:
    """main_key, active_count, subs: array of (sub_key, active) with active offers, in order of count, then key.

    A main category has a bounded number of subcategories (the taxonomy's), so the nested list is bounded too.
    """
    subs = offers.filter("is_active").groupBy("main_key", "sub_key").agg(F.count("*").alias("active"))
    entry = F.struct((-F.col("active")).alias("o"), F.col("sub_key").alias("k"))
    tree = subs.groupBy("main_key").agg(F.sum("active").alias("active_count"), F.array_sort(F.collect_list(entry)).alias("e"))
    return tree.select("main_key", "active_count", F.transform("e", lambda x: F.struct(x["k"].alias("sub_key"), (-x["o"]).alias("active"))).alias("subs"))


def totals(offers: DataFrame) -> DataFrame:
    """level (all, main, sub), main_key, sub_key, offer_count, active_count, retailer_count and the price sum by
    grouping sets over the cells of retailer, main and subcategory: offers are counted once, and only cells multiply by
    level. Offers without a key count under an empty one. An empty table has no totals."""
    keyed = offers.withColumns({"main_key": F.coalesce("main_key", F.lit("")), "sub_key": F.coalesce("sub_key", F.lit(""))})
    main, sub = F.col("main_key"), F.col("sub_key")
    cells = keyed.groupBy("retailer_key", "main_key", "sub_key").agg(F.count("*").alias("n"), F.count_if("is_active").alias("active"), F.sum(F.col("price").cast("decimal(18,2)")).alias("sum"))
    out = cells.groupingSets([[main, sub], [main], []], main, sub).agg(
        F.sum("n").alias("offer_count"), F.sum("active").alias("active_count"), F.count_distinct("retailer_key").alias("retailer_count"), F.coalesce(F.sum("sum"), F.lit(0)).cast("decimal(28,2)").alias("price_sum"),
        F.element_at(F.array(F.lit("sub"), F.lit("main"), F.lit("?"), F.lit("all")), F.grouping_id("main_key", "sub_key").cast("int") + 1).alias("level"),
    )
    return out.select("level", F.coalesce("main_key", F.lit("")).alias("main_key"), F.coalesce("sub_key", F.lit("")).alias("sub_key"), "offer_count", "active_count", "retailer_count", "price_sum")


def label_counts(offers: DataFrame) -> DataFrame:
    """label, n and place of main and subcategory labels: a label's offers as main and as subcategory add up; broad and empty
    labels are left out. In order of count, then of the label in German order."""
    main, sub = F.col("category_primary"), F.col("category_secondary")
    rows = offers.groupingSets([[main], [sub]], main, sub).agg(F.count("*").alias("n"), F.grouping("category_primary").alias("g"))
    label = F.trim(F.when(F.col("g") == 0, main).otherwise(sub))
    counts = rows.select(label.alias("label"), "n").filter((F.col("label") != "") & ~text.is_broad(F.col("label"))).groupBy("label").agg(F.sum("n").alias("n"))
    # labels are the taxonomy's: few, so that one task can number them
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.collate("label", "de"), "label")))


def subcategory_options(pairs: DataFrame, order: str = "sub") -> DataFrame:
    """One row with options: a map from each main category to its subcategories in order; pairs has main, sub and order."""
    subs = pairs.filter("main <> ''").groupBy("main").agg(F.array_sort(F.collect_set(F.struct(F.col(order).alias("o"), F.col("sub").alias("s")))).alias("e"))
    return subs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("main", F.transform("e", lambda x: x["s"]).alias("subs"))))).alias("options"))
