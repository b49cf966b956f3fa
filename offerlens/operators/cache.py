"""The offer cache: active offers by retailer, main category and subcategory, with what they save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import promotions

BUCKET = ["retailer_key", "main_key", "sub_key"]


def saved(price: Column, reference: Column) -> Column:
    """What a single piece saves, or null."""
    nothing = F.lit(None)
    needs = F.struct(F.lit(1).alias("required"), nothing.cast("int").alias("payable"), F.lit("single").alias("mechanic"))
    return promotions.savings(price, reference, nothing.cast("double"), F.lit(False), needs)["amount"]


def order() -> list[Column]:
    """Within a bucket: most saved first (none counts as -1), then the least unit price (none last), the title in German order and the id."""
    return [F.desc(F.coalesce("savings", F.lit(-1.0))), F.asc_nulls_last("unit_price"), F.collate("title", "de"), F.col("offer_id")]


def entries(offers: DataFrame) -> DataFrame:
    """The active offers with savings, in no order."""
    return offers.filter("is_active").withColumn("savings", saved(F.col("price"), F.col("reference")))


def rows(offers: DataFrame) -> DataFrame:
    """The active offers with bucket and savings, sorted by bucket and the bucket's order.

    One row per offer rather than one list per bucket: a range shuffle splits a bucket that holds much of the table, and
    readers take a bucket's first rows from the sorted files.
    """
    return entries(offers).sort(*BUCKET, *order())


def buckets(cached: DataFrame) -> DataFrame:
    """Per bucket: its offers' number, latest sighting and first offer in the bucket's order."""
    place = F.struct(-F.coalesce("savings", F.lit(-1.0)), F.col("unit_price").isNull(), F.col("unit_price"), F.collate("title", "de"), F.col("offer_id").alias("id"))
    return cached.groupBy(*BUCKET).agg(F.count("*").alias("offer_count"), F.max("seen_at").alias("last_at"), F.min(place)["id"].alias("first_offer_id"))


def holding(cached: DataFrame, categories: list[str], retailers: list[str] = ()) -> DataFrame:
    """The rows of the buckets that any offer of the categories lies in, or of which the bucket is one; all where none are asked for."""
    asked = cached.filter(F.col("retailer_key").isin(*retailers)) if retailers else cached
    if not categories:
        return asked
    hit = F.col("category_key").isin(*categories) | F.col("main_key").isin(*categories) | F.col("sub_key").isin(*categories)
    buckets_hit = asked.filter(hit).select(*BUCKET).distinct()  # retailers times the taxonomy's categories at most
    return asked.join(F.broadcast(buckets_hit), BUCKET, "left_semi")
