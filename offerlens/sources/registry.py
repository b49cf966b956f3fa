"""The source registry: what is landed from where, in which order, and how it is kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "source_id string, retailer_key string, retailer_name string, channel string, label string, url string, active boolean"
# Sources as (retailer key, retailer, channel, label, address).
SOURCES = (
    ("hofer", "Hofer", "aggregator", "Aktionsfinder HOFER Aktionen", "https://www.aktionsfinder.at/pv/hofer/"),
    ("hofer", "Hofer", "official-flyer", "HOFER aktuelle Flugblaetter und Broschueren", "https://www.hofer.at/de/angebote/aktuelle-flugblaetter-und-broschuren.html"),
    ("hofer", "Hofer", "aggregator", "Marktguru HOFER Angebote", "https://www.marktguru.at/r/hofer"),
    ("lidl", "Lidl", "aggregator", "Aktionsfinder Lidl Aktionen", "https://www.aktionsfinder.at/pv/lidl/"),
    ("lidl", "Lidl", "official-flyer", "Lidl Flugblatt", "https://www.lidl.at/c/flugblatt/s10012330"),
    ("lidl", "Lidl", "aggregator", "Marktguru Lidl Angebote", "https://www.marktguru.at/r/lidl"),
    ("spar", "Spar", "aggregator", "Aktionsfinder SPAR Aktionen", "https://www.aktionsfinder.at/pv/spar/"),
    ("spar", "Spar", "official-flyer", "SPAR Aktionen", "https://www.spar.at/aktionen"),
    ("spar", "Spar", "aggregator", "Marktguru SPAR Angebote", "https://www.marktguru.at/r/spar"),
    ("billa", "Billa", "aggregator", "Aktionsfinder BILLA Aktionen", "https://www.aktionsfinder.at/pv/billa/"),
    ("billa", "Billa", "official-flyer", "BILLA Flugblatt", "https://www.billa.at/unsere-aktionen/flugblatt"),
    ("billa", "Billa", "official-site", "BILLA Aktionen", "https://www.billa.at/unsere-aktionen/aktionen"),
    ("billa", "Billa", "aggregator", "Marktguru BILLA Angebote", "https://www.marktguru.at/r/billa"),
    ("billa-plus", "Billa Plus", "aggregator", "Aktionsfinder BILLA PLUS Aktionen", "https://www.aktionsfinder.at/pv/billa-plus/"),
    ("billa-plus", "Billa Plus", "official-flyer", "BILLA PLUS Flugblatt", "https://www.billa.at/unsere-aktionen/flugblatt"),
    ("billa-plus", "Billa Plus", "official-site", "BILLA PLUS Aktionen", "https://www.billa.at/unsere-aktionen/aktionen"),
    ("billa-plus", "Billa Plus", "aggregator", "Marktguru BILLA PLUS Angebote", "https://www.marktguru.at/r/billa-plus"),
    ("penny", "PENNY", "aggregator", "Aktionsfinder PENNY Aktionen", "https://www.aktionsfinder.at/pv/penny/"),
    ("penny", "PENNY", "official-flyer", "PENNY Flugblaetter", "https://www.penny.at/angebote/flugblaetter"),
    ("penny", "PENNY", "official-site", "PENNY Angebote", "https://www.penny.at/angebote"),
    ("penny", "PENNY", "aggregator", "Marktguru PENNY Angebote", "https://www.marktguru.at/r/penny"),
    ("dm", "dm", "aggregator", "Aktionsfinder dm drogerie markt Aktionen", "https://www.aktionsfinder.at/pv/dm-drogerie-markt/"),
    ("dm", "dm", "official-site", "dm Startseite", "https://www.dm.at/"),
    ("dm", "dm", "aggregator", "Marktguru dm Angebote", "https://www.marktguru.at/r/dm"),
    ("dm", "dm", "aggregator", "wogibtswas dm Angebote", "https://www.wogibtswas.at/h/73424-dm"),
    ("pagro", "PAGRO", "aggregator", "Aktionsfinder PAGRO & LIBRO Aktionen", "https://www.aktionsfinder.at/pv/pagro-libro/"),
    ("pagro", "PAGRO", "aggregator", "Marktguru PAGRO Angebote", "https://www.marktguru.at/r/pagro"),
    ("bipa", "BIPA", "official-site", "BIPA Aktionen", "https://www.bipa.at/cp/aktionen"),
    ("bipa", "BIPA", "aggregator", "Aktionsfinder BIPA Aktionen", "https://www.aktionsfinder.at/pv/bipa/"),
    ("bipa", "BIPA", "aggregator", "Marktguru BIPA Angebote", "https://www.marktguru.at/r/bipa"),
)
# Crawl order of channels and of retailers (others 50).
CHANNEL_ORDER = {"official-site": 0, "official-flyer": 1, "aggregator": 2}
RETAILER_ORDER = {"spar": 0, "lidl": 1, "penny": 2, "dm": 3, "pagro": 4, "bipa": 5, "adeg": 6, "hofer": 7, "billa": 8, "billa-plus": 9}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{k}:{c}:{u}", k, n, c, label, u, True) for k, n, c, label, u in SOURCES], SCHEMA)


def upserted(stored: DataFrame, registry: DataFrame) -> DataFrame:
    """Stored rows with the registry's values; what the registry no longer has becomes inactive."""
    r = registry.select([F.col(c).alias(f"r_{c}") for c in registry.columns])
    both = stored.join(r, F.col("source_id") == F.col("r_source_id"), "full_outer")
    return both.select(*[(F.coalesce("r_active", F.lit(False)) if c == "active" else F.coalesce(f"r_{c}", c)).alias(c) for c in registry.columns])


def _order(c, table: dict[str, int], other: int):
    out = F.when(F.lit(False), 0)
    for k, n in table.items():
        out = out.when(c == k, n)
    return out.otherwise(other)


def crawl_order(registry: DataFrame, active_offers: DataFrame) -> DataFrame:
    """Active sources, those of poorly covered retailers first: fewest active offers, then retailer, channel, label."""
    counts = active_offers.groupBy("retailer_key").agg(F.count("*").alias("active_offers"))
    rows = registry.filter("active").join(counts, "retailer_key", "left").withColumn("active_offers", F.coalesce("active_offers", F.lit(0)))
    return rows.orderBy("active_offers", _order(F.col("retailer_key"), RETAILER_ORDER, 50), _order(F.col("channel"), CHANNEL_ORDER, 3), "label", "source_id")


#: Connectors by name: from landed rows to offers. normalize.py fills it.
CONNECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


# Connectors of official sources as (connector, retailer or none, channel or none, part of the address), the first that fits.
OFFICIAL = (
    ("hofer", "hofer", "official-flyer", ""),
    ("search", None, None, "billa.at/unsere-aktionen/aktionen"),
    ("penny", "penny", None, "penny.at/angebote"),
    ("official", "lidl", None, "lidl.at/c/flugblatt"),
    ("bipa", "bipa", None, "bipa.at/cp/aktionen"),
)


def connector_of(retailer: Column, channel: Column, url: Column) -> Column:
    """Which connector reads a source: an aggregator by its address, an official one by OFFICIAL; pages of others are evidence."""
    out = F.when(channel == "aggregator", F.when(url.contains("marktguru.at/"), "marktguru").when(url.contains("wogibtswas.at/"), "wogibtswas").otherwise("aktionsfinder"))
    for name, of, on, part in OFFICIAL:
        fits = url.contains(part)
        if of:
            fits = fits & (retailer == of)
        if on:
            fits = fits & (channel == on)
        out = out.when(fits, name)
    return out.otherwise("evidence")


def dispatched(landed: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """Landed rows (source_id and content) by connector, with their sources' columns. Rows of unknown or inactive sources are left out."""
    rows = landed.join(sources.filter("active").select("source_id", "retailer_key", "retailer_name", "channel", F.col("url").alias("source_url")), "source_id")
    rows = rows.withColumn("connector", connector_of(F.col("retailer_key"), F.col("channel"), F.col("source_url")))
    names = ["marktguru", "wogibtswas", "aktionsfinder", *(n for n, *_ in OFFICIAL), "evidence"]
    return {n: rows.filter(F.col("connector") == n).drop("connector") for n in names}


def offers_of(landed: DataFrame, connector: str) -> DataFrame:
    """Landed rows of one connector as promotion records."""
    from offerlens.operators import normalize  # fills CONNECTORS

    return (CONNECTORS or normalize.registry.CONNECTORS)[connector](landed)
