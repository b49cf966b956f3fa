"""From landed rows to published tables: connectors, normalization, enrichment, manual rules, duplicates, aggregates."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import coverage, dedupe, enrich, metadata, normalize, overrides
from offerlens.sources import registry, store


def promotions_of(landed: Mapping[str, DataFrame]) -> DataFrame:
    """Promotion records of all connectors; landed names the connector of each table of landed rows."""
    out = None
    for connector, rows in landed.items():
        part = registry.offers_of(rows, connector)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing has landed")
    return out


def stored_offers(normalized: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Normalized offers fit to be stored: enriched, with manual rules applied and their keys and search text made anew,
    and one canonical offer of each group of duplicates, with the evidence of all."""
    rows = normalized.withColumns({"reference_source": F.lit(""), "source_type": F.lit(""), "source_url": F.col("url"), "offer_id": text.digest(F.concat_ws("::", "source_id", "offer_key"))})
    rows = enrich.enriched(rows.withColumnRenamed("savings", "promotion_savings"))
    rows = overrides.applied(rows, rules)
    rows = rows.withColumns({
        "search_text": text.match_title(F.concat_ws(" ", "title", "brand", "category_primary", "category_secondary", "retailer_name", "conditions")),
        "main_category_key": text.slug(F.col("category_primary"), "unkategorisiert"), "confidence": F.col("parsing_confidence"),
        "filled": F.size(F.array_compact(F.array(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("brand", "quantity", "reference", "valid_from", "valid_to", "url", "category_secondary")]))),
        "created_at": as_of, "updated_at": as_of,
    })
    return dedupe.canonical(rows)


def tables(offers: DataFrame, as_of: Column, sources: DataFrame | None = None, jobs: DataFrame | None = None) -> dict[str, DataFrame]:
    """What is published beside the offers: coverage in full by retailer, the cube and its roll-up."""
    keyed = offers.withColumns({"main_key": F.col("main_category_key"), "sub_key": F.col("category_key")})
    cells = metadata.cube(keyed)
    seen = offers.withColumn("seen_at", F.col("updated_at"))
    known = sources if sources is not None else coverage.no_sources(offers.sparkSession)
    covered = coverage.full(seen, known, jobs if jobs is not None else coverage.no_jobs(offers.sparkSession), as_of)
    return {"offers": offers, "coverage": covered, "cube": cells, "main_categories": metadata.roll_up(cells)}


def run(landed: Mapping[str, DataFrame], rules: DataFrame, root: str, as_of: Column, sources: DataFrame | None = None, jobs: DataFrame | None = None) -> str:
    """Store and publish all tables of one crawl under root; returns the version. Each step reads what the one before wrote,
    which keeps the plans small: rules read the normalized offers several times, the aggregates the stored ones.

    The steps stand in a folder of this run's own, so a run that fails, or another at the same time, leaves them alone.
    """
    spark, own = rules.sparkSession, f"{root}/staging/{uuid.uuid4().hex}"
    normalize.offers(promotions_of(landed), as_of).write.parquet(f"{own}/normalized")
    stored_offers(spark.read.parquet(f"{own}/normalized"), rules, as_of).write.parquet(f"{own}/staged")
    return store.publish(tables(spark.read.parquet(f"{own}/staged"), as_of, sources, jobs), root)
