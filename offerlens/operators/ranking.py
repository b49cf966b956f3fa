"""Search, ranking and baskets over an offer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import numbers, promotions, text
from offerlens.operators import dedupe

# Points for the whole query in a field, and for each of its words.
PHRASE_POINTS = {"title": 120, "category_secondary": 95, "brand": 90, "category_primary": 75, "retailer": 25, "aggregate": 15}
WORD_POINTS = {"title": 24, "category_secondary": 18, "brand": 16, "category_primary": 12}
# What a ranked offer shows, and what stands where its table lacks the column or the row has null in it.
TEXTS = (
    "retailer_key", "retailer_name", "title", "title_normalized", "brand", "category_primary", "category_secondary", "category_key", "subcategory_key", "quantity_text", "conditions_text", "comparison_group",
    "unit_type", "comparable_unit", "package_type", "unit", "reference_source", "savings_display_type", "image_url", "source_type",
)
NUMBERS = ("category_confidence", "subcategory_confidence", "reference_confidence", "savings_confidence", "sort_score")
FLAGS = (
    "program_required", "has_conditions", "is_multi_buy", "is_active", "is_active_today", "comparison_safe", "has_reference_price", "has_prospect_normal_price", "has_estimated_reference_price", "is_action_price_only", "needs_review",
)
LISTS = ("source_types", "evidence_urls", "review_reasons")
AMOUNTS = ("price", "reference", "unit_price", "unit_value", "total_comparable_amount", "savings_amount", "savings_percent")
COUNTS = ("pack_count", "minimum_purchase_quantity", "minimum_purchase_qty")
DATES = ("valid_from", "valid_to")
WORDED = {"status": "unknown", "effective_discount_type": "unknown"}
UNTIL, OPEN = "gueltig bis", "aktuell verfuegbar, Enddatum nicht erkannt"
#: The columns of a ranked offer in order.
SHOWN = (
    "offer_id", *TEXTS, *WORDED, *NUMBERS, *FLAGS, *LISTS, *AMOUNTS, *COUNTS, *DATES, "display_category", "relevance", "consumer_score", "best_unit_price", "gap_to_best", "relative_position", "validity_label", "rank", "rank_in_unit",
)


def relevance(fields: dict[str, Column], query: str) -> Column:
    """Points of a query in the given fields; an empty query scores 1. Words of the query are known when the plan is built."""
    return points({k: text.search_words(c) for k, c in fields.items()}, query)


def points(prepared: dict[str, Column], query: str) -> Column:
    """relevance over fields whose search words are there already; they are named once for each word of the query."""
    words = [w for w in _search(query) if w]
    if not words:
        return F.lit(1)
    phrase, total = " ".join(words), F.lit(0)
    for name, c in (prepared | {"aggregate": F.concat_ws(" ", *prepared.values())}).items():
        total = total + F.when(text.has_phrase(c, F.lit(phrase)), PHRASE_POINTS.get(name, 0)).otherwise(0)
        if name in WORD_POINTS:
            for w in words:
                total = total + F.when(text.has_phrase(c, F.lit(w)), WORD_POINTS[name]).otherwise(0)
    return total


def _search(query: str) -> list[str]:
    import re
    import unicodedata

    s = (query or "").lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = s.replace(a, b)
    return re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", s)).split()


def filters(categories=(), retailers=(), unit: str = "all", only_public: bool = False, programs=()) -> Column:
    """The conjunction that the parameters ask for, over category_key, retailer_key, unit and program_required."""
    out = chosen(categories, retailers)
    if unit not in ("", "all"):
        out = out & (F.col("unit") == unit)
    return out & eligible(F.col("program_required"), F.col("retailer_key"), only_public, programs)


def chosen(categories=(), retailers=()) -> Column:
    """Of the categories and of the retailers; none asked for means all."""
    out = F.lit(True)
    if categories:
        out = out & F.col("category_key").isin(*categories)
    if retailers:
        out = out & F.col("retailer_key").isin(*retailers)
    return out


def eligible(required: Column, retailer: Column, only_public: bool, programs) -> Column:
    """Public offers always; others not if only public ones are asked for, and only of retailers whose program one has."""
    return ~required | (F.lit(not only_public) & (retailer.isin(*programs) if programs else F.lit(False)))


def with_gaps(df: DataFrame, by: list[str], price: str, order: list) -> DataFrame:
    """gap_to_best and relative_position (percent) against the best and worst price of each group: two aggregates and a join."""
    ends = df.groupBy(*by).agg(F.min(price).alias("best_price"), F.max(price).alias("worst_price"))
    out = df.join(ends, by)
    p, b, w = F.col(price), F.col("best_price"), F.col("worst_price")
    return out.withColumn("gap_to_best", F.when(b > 0, (p - b) / b * 100)).withColumn("relative_position", F.when(w > b, (p - b) / (w - b) * 100).otherwise(0.0))


def top_per_group(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits each group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def basket(offers: DataFrame, items: list[str], fields: dict[str, str], alternatives: int = 3) -> DataFrame:
    """item, rank, offer columns and score of the best matches of each wish; at most 12 wishes, scored in one pass over
    the offers, each row bringing only the wishes that it meets."""
    wishes = [x.strip() for x in items if x.strip()][:12]
    ready = {k: F.col(f"__words_{k}") for k in fields}
    prepared = offers.withColumns({f"__words_{k}": text.search_words(F.col(v)) for k, v in fields.items()})  # once a row, not once a word
    scored = F.array(*[F.struct(F.lit(i).alias("item_no"), F.lit(w).alias("item"), points(ready, w).alias("score")) for i, w in enumerate(wishes)])
    met = prepared.select(*offers.columns, F.explode(F.filter(scored, lambda s: s["score"] > 0)).alias("hit")).select(*offers.columns, "hit.item_no", "hit.item", "hit.score")
    return top_per_group(met, ["item_no", "item"], [F.desc("score"), "unit_price", "offer_id"], alternatives)


def by_unit(scored: DataFrame, n: int) -> DataFrame:
    """The first n offers of each unit (`unbekannt` where none) with rank_in_unit, by consumer score, unit price, title in German order and id."""
    named = scored.withColumn("unit", F.coalesce(F.nullif("unit", F.lit("")), F.lit("unbekannt")))
    return top_per_group(named, ["unit"], [F.desc("consumer_score"), "unit_price", F.collate("title", "de"), "offer_id"], n, "rank_in_unit")


def complete(offers: DataFrame) -> DataFrame:
    """The offers with every column that a ranked offer shows; missing texts are empty, numbers 0, flags false, lists empty,
    amounts, counts and dates null; a missing retailer_name is the key, a missing sort_score is computed. Other columns stay."""
    have = set(offers.columns)
    given = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    filled = {n: F.coalesce(given(n, "string"), F.lit("")) for n in (*TEXTS, "dedupe_key", "offer_key")}
    filled |= {n: F.coalesce(given(n, "string"), F.lit(word)) for n, word in WORDED.items()}
    filled["retailer_name"] = F.coalesce(F.nullif(given("retailer_name", "string"), F.lit("")), given("retailer_key", "string"), F.lit(""))
    filled |= {n: F.coalesce(given(n, "double"), F.lit(0.0)) for n in NUMBERS} | {n: F.coalesce(given(n, "boolean"), F.lit(False)) for n in FLAGS}
    filled |= {n: F.coalesce(given(n, "array<string>"), F.array().cast("array<string>")) for n in LISTS}
    filled |= {n: given(n, "double") for n in AMOUNTS} | {n: given(n, "int") for n in COUNTS} | {n: F.col(n) if n in have else F.lit(None).cast("timestamp") for n in DATES}
    out = offers.withColumns(filled)
    if "sort_score" in have:
        return out
    plain = F.when(F.col("has_conditions"), "given").otherwise("")
    bought = F.coalesce("minimum_purchase_quantity", F.lit(1))
    return out.withColumn("sort_score", numbers.sort_score(F.col("is_active"), F.col("comparison_safe"), F.col("program_required"), plain, bought, given("confidence", "double"), F.col("unit_price")).cast("double"))


def in_unit(unit: str) -> Column:
    """Compared in the unit, or priced in it where no comparable unit is known; `all` and no unit hold for all."""
    return F.lit(True) if unit in ("", "all") else F.coalesce(F.nullif("comparable_unit", F.lit("")), "unit") == unit


def matches(candidates: DataFrame, query: str) -> DataFrame:
    """Candidates (complete) that the query meets, with relevance, one of each ranking_key: the most relevant, then the cheapest,
    then the first title in German order and the least id."""
    fields = {"title": F.col("title"), "category_secondary": F.col("category_secondary"), "brand": F.col("brand"), "category_primary": F.col("category_primary"), "retailer": F.col("retailer_name")}
    met = candidates.withColumn("relevance", relevance(fields, query)).filter("relevance > 0")
    order = [F.desc("relevance"), F.asc_nulls_last("unit_price"), F.collate("title", "de"), "offer_id"]
    return dedupe.first_wins(met.withColumn("__key", dedupe.ranking_key()), ["__key"], order).drop("__key")


def scored(rows: DataFrame) -> DataFrame:
    """rows (complete) with consumer_score and the place that it gives: by score, unit price (none last), offers without
    program, conditions and multi-buy first, title in German order and id."""
    c = F.col
    single = ~c("is_multi_buy") & (F.coalesce(c("minimum_purchase_quantity"), F.lit(1)) <= 1)
    plain = F.when(c("has_conditions"), "given").otherwise("")
    priced = F.when(c("unit_price") > 0, c("unit_price"))
    score = numbers.consumer_score(c("sort_score"), (c("status") == "active") & c("is_active"), c("comparison_safe") & (c("comparison_group") != ""), priced, single, c("program_required"), plain)
    place = F.struct(
        (-score).alias("score"), c("unit_price").isNull().alias("unpriced"), c("unit_price").alias("price"), (c("program_required") | c("has_conditions") | c("is_multi_buy")).alias("tied"),
        F.collate("title", "de").alias("title"), c("offer_id").alias("id"),
    )
    return rows.withColumns({"consumer_score": score, "place": place})


def shown(items: DataFrame, ends: DataFrame, numbered: bool) -> DataFrame:
    """Scored items in order, as SHOWN. ends: one row with best_unit_price and worst_unit_price, the first and last item's.

    Savings that aren't given are computed from price and reference (no reference price where it is estimated). rank and
    rank_in_unit are null unless numbered, which takes a bounded number of items: they are numbered in one task.
    """
    c, nothing = F.col, F.lit(None)
    needs = promotions.requirement(c("title"), c("conditions_text"), nothing.cast("array<string>"), c("minimum_purchase_quantity"), c("effective_discount_type"))
    estimated = promotions.is_estimated(c("savings_display_type"), c("has_estimated_reference_price"), c("reference_source"))
    out = items.join(F.broadcast(ends)).withColumn("__needs", needs)  # ends is one row
    out = out.withColumn("__saved", promotions.savings(c("price"), c("reference"), nothing.cast("double"), estimated, c("__needs")))
    gap, spread, best = c("unit_price") - c("best_unit_price"), c("worst_unit_price") - c("best_unit_price"), c("best_unit_price")
    wanted = F.coalesce("minimum_purchase_quantity", F.when(c("savings_amount").isNull(), c("__needs.required")))
    unit = F.coalesce(F.nullif("unit", F.lit("")), F.lit("unbekannt"))
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("place")) if numbered else nothing.cast("int")
    out = out.withColumns({
        "savings_amount": F.coalesce("savings_amount", c("__saved.amount")), "savings_percent": F.coalesce("savings_percent", c("__saved.percent")), "minimum_purchase_quantity": wanted,
        "minimum_purchase_qty": F.coalesce("minimum_purchase_qty", wanted, F.lit(1)), "display_category": text.display_category(c("category_secondary"), c("category_primary")),
        "gap_to_best": F.when(best != 0, numbers.money(gap / best * 100)).otherwise(0.0), "relative_position": F.when((best != 0) & (c("worst_unit_price") != 0) & (spread != 0), numbers.money(gap / spread * 100)).otherwise(0.0),
        "validity_label": F.when(c("valid_to").isNotNull(), UNTIL).otherwise(OPEN), "rank": number(), "rank_in_unit": number(unit),
    })
    return out.orderBy("place").select(*SHOWN)
