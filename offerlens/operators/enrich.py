"""Enrichment before storage: confidences, savings flags, review reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import numbers, text

# Sources whose reference prices are estimates.
ESTIMATE_WORDS = "estimate|estimated|historisch|history|produktseite|product-search|normalerweise|referenz"


def category_confidence(primary: Column, secondary: Column) -> Column:
    p, s = F.nullif(text.squeezed(primary), F.lit("")), F.nullif(text.squeezed(secondary), F.lit(""))
    return F.when(p.isNull(), 0.25).when(s.isNotNull() & (s != p), 0.78).otherwise(0.58)


def subcategory_confidence(secondary: Column, confidence: Column) -> Column:
    return F.when(text.squeezed(secondary) == "", 0.25).otherwise(numbers.clamped(confidence - 0.05, 0.45, 0.85))


def source_type(given: Column, channel: Column, url: Column) -> Column:
    low = F.lower(F.concat_ws(" ", channel, url))
    return F.coalesce(F.nullif(given, F.lit("")), F.when(low.rlike("flyer|flugblatt|prospekt"), "flyer").when(low.rlike("aggregator"), "aggregator").when(low.rlike("official|site"), "website").otherwise("unknown"))


def source_confidence(channel: Column) -> Column:
    return F.when(F.coalesce(channel, F.lit("")).startswith("official"), 0.9).otherwise(0.78)


def savings_flags(current: Column, reference: Column, source: Column) -> Column:
    """struct(display_type, prospect, estimated, action_price_only, confidence)"""
    has = F.coalesce(reference > 0, F.lit(False))
    guess = has & text.match_title(source).rlike(ESTIMATE_WORDS)
    kind = F.when(~has, "action-price-only").when(guess, "estimated-reference-price").otherwise("prospect-normal-price")
    sure = F.when(~has, 0.0).when(~guess & (reference > current), 0.95).otherwise(0.55)
    return F.struct(kind.alias("display_type"), (has & ~guess).alias("prospect"), guess.alias("estimated"), (~has).alias("action_price_only"), sure.alias("confidence"))


def review_reasons(title, price, parsing, category, subcategory, quantity, valid_to, snapshot, price_only, parser_limit: float = 0.75) -> Column:
    """The data-quality rules that an offer breaks, in order."""
    return F.array_compact(
        F.array(
            F.when(text.squeezed(title) == "", "missing-title"), F.when(price.isNull() | (price <= 0), "missing-current-price"), F.when(parsing < parser_limit, "parser-low-confidence"),
            F.when(category < 0.5, "category-low-confidence"), F.when(subcategory < 0.4, "subcategory-low-confidence"), F.when(quantity.isNull(), "missing-quantity"),
            F.when(valid_to.isNull() & ~F.coalesce(snapshot, F.lit(False)), "validity-incomplete"), F.when(price_only, "action-price-only"),
        )
    )


def needs_review(reasons: Column) -> Column:
    """Whether any reason but the lack of a reference price was found."""
    return F.exists(reasons, lambda r: r != "action-price-only")


def enriched(offers: DataFrame) -> DataFrame:
    """Adds confidences, savings fields, review reasons and the review flag to offers with the usual columns."""
    flags = savings_flags(F.col("price"), F.col("reference"), F.col("reference_source"))
    out = offers.withColumn("category_confidence", category_confidence(F.col("category_primary"), F.col("category_secondary")))
    out = out.withColumns({"subcategory_confidence": subcategory_confidence(F.col("category_secondary"), F.col("category_confidence")), "source_confidence": source_confidence(F.col("channel")), "source_type": source_type(F.col("source_type"), F.col("channel"), F.col("source_url")), "savings": flags})
    reasons = review_reasons(F.col("title"), F.col("price"), F.col("parsing_confidence"), F.col("category_confidence"), F.col("subcategory_confidence"), F.col("quantity"), F.col("valid_to"), F.col("snapshot"), F.col("savings.action_price_only"))
    return out.withColumn("review_reasons", reasons).withColumn("needs_review", needs_review(F.col("review_reasons")))
