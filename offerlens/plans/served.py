"""The served queries: ranking, basket, comparison, quality, dashboard and filters over a table of offers.

Each takes DataFrames and plain parameters and returns DataFrames; `as_of` stands for now.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import numbers
from offerlens.operators import audit, compare, coverage, metadata, ranking
from offerlens.sources import memo, versions


def parse_limit(value, default: int = 30) -> int | None:
    """5 to 500, or None for all."""
    if value == "all":
        return None
    try:
        return max(5, min(500, int(value)))
    except (TypeError, ValueError):
        return default


def parse_list(value) -> list[str]:
    parts = value if isinstance(value, (list, tuple)) else str(value or "").split(",")
    return [p for p in (str(x).strip() for x in parts) if p]


def flat(stored: DataFrame) -> DataFrame:
    """Offers as ingest stores them, in the flat form that the served queries read: unit price and savings apart from their structs."""
    c = F.col
    return stored.withColumnsRenamed({"unit_price": "__priced", "unit": "quantity_unit"}).withColumns({
        "unit_price": c("__priced.amount"), "unit": c("__priced.unit"), "comparable_unit": c("__priced.unit"), "savings_amount": c("promotion_savings.amount"), "savings_percent": c("promotion_savings.percent"), "minimum_purchase_quantity": c("needs.required"),
        "effective_discount_type": c("discount_type"), "is_multi_buy": c("discount_type") == "multi-buy", "conditions_text": c("conditions"), "has_conditions": F.coalesce(F.trim("conditions"), F.lit("")) != "", "subcategory_key": c("category_key"),
        "has_reference_price": c("reference").isNotNull(), "evidence_urls": F.array_distinct(F.array_compact(c("evidence.url"))), "source_types": F.array_distinct(F.array_compact(c("evidence.channel"))),
    }).drop("__priced")


def offer_ranking(offers: DataFrame, categories=(), q: str = "", unit: str = "all", retailers=(), programs=(), only_public: bool = False, limit=30) -> dict[str, DataFrame]:
    """What a ranked search shows: items (ranking.SHOWN, best first), groups (units by their best score), retailers (of the items,
    by number), summary (one row), units and category labels to choose from.

    Offers need offer_id; other columns may be missing (ranking.complete). Of duplicates by dedupe_key, offer_key or the
    fallback key, the most relevant and cheapest stays. With a limit, items have rank and rank_in_unit; with limit="all"
    these are null and the order is the table's own, so that no task holds all items.
    """
    slugs = [re.sub("[^a-z0-9]+", "-", c.lower()) for c in parse_list(categories)]
    current = ranking.complete(offers).filter((F.col("status") == "active") & F.col("is_active"))
    candidates = current.filter(ranking.chosen(slugs, parse_list(retailers)))
    eligible = ranking.eligible(F.col("program_required"), F.col("retailer_key"), only_public, parse_list(programs))
    found = ranking.scored(ranking.matches(candidates.filter(eligible & ranking.in_unit(unit)), q))
    n = parse_limit(limit)
    items = found.orderBy("place").limit(n) if n else found
    ends = items.agg(F.count("*").alias("displayed_count"), F.min_by("unit_price", "place").alias("best_unit_price"), F.max_by("unit_price", "place").alias("worst_unit_price"))
    best, worst = F.col("best_unit_price"), F.col("worst_unit_price")
    spread = F.when((best != 0) & (worst != 0), numbers.money((worst - best) / best * 100)).otherwise(0.0)
    summary = found.agg(F.count("*").alias("result_count")).join(F.broadcast(ends)).select(  # both are one row
        "result_count", "displayed_count", F.lit(str(n or "all")).alias("requested_display"), (F.col("displayed_count") == F.col("result_count")).alias("complete_result_set_visible"), "best_unit_price", "worst_unit_price", spread.alias("spread_percent")
    )
    by_unit = items.groupBy(F.coalesce(F.nullif("unit", F.lit("")), F.lit("unbekannt")).alias("unit")).agg(F.count("*").alias("n"), F.max("consumer_score").alias("top_score"), F.min("unit_price").alias("best_price"))
    by_retailer = items.groupBy("retailer_key").agg(F.max("retailer_name").alias("retailer_name"), F.count("*").alias("n"), F.min("unit_price").alias("best_price"))
    return {
        "items": ranking.shown(items, ends, n is not None), "groups": by_unit.orderBy(F.desc("top_score"), F.collate("unit", "de")), "retailers": by_retailer.orderBy(F.desc("n"), F.asc_nulls_last("best_price"), "retailer_key"),
        "summary": summary, "units": candidates.filter("unit <> ''").select("unit").distinct().orderBy("unit"), "categories": metadata.label_counts(current).orderBy("place"),
    }


#: The tables of a ranking.
RANKING = ("items", "groups", "retailers", "summary", "units", "categories")


def remembered_ranking(kept: memo.Memo, root: str, now: datetime, **params) -> dict[str, DataFrame]:
    """offer_ranking over the offers stored at root (sources.versions), each of its tables kept by the question and the
    version asked: a change of the offers asks anew."""
    version = versions.state(kept.spark, root).version
    made: dict[str, DataFrame] = {}

    def make(name: str) -> DataFrame:
        if not made:
            made.update(offer_ranking(versions.read(kept.spark, root), **params))
        return made[name]

    return {name: kept.remember(version, f"ranking-{name}", params, lambda n=name: make(n), now) for name in RANKING}


def snapshot(df: DataFrame, seconds: float = 8.0) -> DataFrame:
    """df, or no rows where it takes longer than a dashboard waits."""
    return memo.within(df, seconds)[0]


def basket_suggestions(offers: DataFrame, items: str, categories=(), retailers=(), programs=(), only_public: bool = False, alternatives: int = 3) -> dict[str, DataFrame]:
    """matches (the best offers of each wish), mix (offers and sum of the best ones by retailer) and summary (the same of all,
    with the numbers of wishes and retailers): mix and summary are two levels of one grouping."""
    rows = offers.filter("is_active and comparison_safe").filter(ranking.filters(parse_list(categories), parse_list(retailers), "all", only_public, parse_list(programs)))
    wishes = [x for line in items.split("\n") for x in line.split(",")]
    found = ranking.basket(rows, wishes, {"title": "title", "category_secondary": "category_secondary", "brand": "brand", "category_primary": "category_primary"}, alternatives)
    levels = found.filter("rank = 1").rollup("retailer_key").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("price").cast("decimal(18,2)")), F.lit(0)).cast("decimal(28,2)").alias("total"), F.count_distinct("retailer_key").alias("retailers"), F.grouping("retailer_key").alias("all"))
    n_wishes = len([x for x in wishes if x.strip()][:12])
    or_zero = lambda c: F.coalesce(F.max(c), F.lit(0))  # noqa: E731 - one row, also where no wish is met
    summary = levels.filter("all = 1").agg(F.lit(n_wishes).alias("item_count"), or_zero("n").alias("matched_count"), or_zero("total").alias("total"), or_zero("retailers").alias("retailer_count"))
    return {"matches": found, "mix": levels.filter("all = 0").select("retailer_key", "n", "total").orderBy(F.desc("n"), "total", "retailer_key"), "summary": summary}


def comparisons(offers: DataFrame, top: int = 20) -> dict[str, DataFrame]:
    """exact matches and category benchmarks, widest first."""
    base = offers.filter("is_active and comparison_safe and unit_price > 0")
    order = [F.desc("retailer_count"), F.desc("spread_percent"), "best_offer_id"]
    return {"exact": compare.comparison(base, ["brand", "title"]).orderBy(*order).limit(top), "benchmarks": compare.comparison(base, ["category_key", "unit"]).orderBy(*order).limit(top)}


def quality_snapshot(offers: DataFrame, q: str = "", retailer: str = "", primary: str = "", secondary: str = "", limit: int = 100) -> dict[str, DataFrame]:
    rows = audit.searched(offers, q, ["title", "category_primary", "category_secondary", "retailer_key"])
    for c, v in (("retailer_key", retailer), ("category_primary", primary), ("category_secondary", secondary)):
        rows = rows.filter(F.col(c) == v) if v else rows
    return {
        "offers": rows.orderBy(F.desc("updated_at"), F.desc("offer_id")).limit(max(1, min(500, limit))), "categories": rows.groupBy("category_primary").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category_primary"),
        "subcategories": audit.mapping_counts(rows, ["category_primary", "category_secondary"]), "articles": audit.mapping_counts(rows, ["title"]),
    }


def dashboard_snapshot(offers: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    return {"kpis": audit.kpis(offers, as_of), "latest": offers.orderBy(F.desc("updated_at"), F.desc("offer_id")).limit(24), **comparisons(offers)}


def filter_retailers(offers: DataFrame, as_of: Column, sources: DataFrame | None = None, jobs: DataFrame | None = None) -> DataFrame:
    """coverage.full of the offers, most urgent first. Without sources or jobs, none are registered or logged."""
    spark = offers.sparkSession
    now = F.coalesce("valid_to", "valid_from") if "seen_at" not in offers.columns else F.col("seen_at")
    named = offers.withColumns({"seen_at": now} | ({} if "retailer_name" in offers.columns else {"retailer_name": F.col("retailer_key")}))
    table = coverage.full(named, sources if sources is not None else coverage.no_sources(spark), jobs if jobs is not None else coverage.no_jobs(spark), as_of)
    return table.orderBy(F.desc("priority"), "retailer_key")


def filter_categories(offers: DataFrame, retailers=()) -> DataFrame:
    chosen = parse_list(retailers)
    cells = metadata.cube(offers)
    return metadata.roll_up(cells.filter(F.col("retailer_key").isin(*chosen)) if chosen else cells).orderBy(F.desc("active_count"), "main_key")
