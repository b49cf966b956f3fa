"""Retailer coverage in full: offers with their sources and channels, the crawl log, status, priority and gap reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import numbers
from offerlens.operators import ranking
from offerlens.operators.metadata import coverage_target

#: Crawls of a retailer that count, and hours after which the last good one is old.
RECENT, FRESH_HOURS = 8, 72
# Crawl states that count as success.
GOOD = ("success", "partial")
# What a gap is called, in the order in which they are listed.
REASONS = {
    "none": "keine aktiven Offers erfasst",
    "far": "aktive Abdeckung deutlich unter Zielwert",
    "below": "aktive Abdeckung nur mittelmaessig",
    "single": "aktive Abdeckung haengt an nur einer Quelle",
    "dominant": "starke Abhaengigkeit von einer einzelnen Quelle",
    "inactive": "viele Gesamtangebote, aber sehr wenige aktive Offers",
    "stale": "kein frischer erfolgreicher Crawl",
    "failing": "wiederholte Crawl-Fehler",
    "yield": "wiederholt niedrige Crawl-Ausbeute",
    "unseen": "keine aktuellen Crawl-Runs vorhanden",
}


def per_source(offers: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per retailer and source with its counts, times and confidence sum.

    offers: retailer_key, retailer_name, source_id, is_active, comparison_safe, price, confidence, seen_at. sources:
    source_id, label, channel. A source that isn't listed has its id for a label and no channel.
    """
    active, safe = F.coalesce("is_active", F.lit(False)), F.coalesce("comparison_safe", F.lit(False))
    counted = offers.groupBy("retailer_key", "source_id").agg(
        F.count("*").alias("offer_count"), F.count_if(active).alias("active_count"), F.count_if(active & safe).alias("safe_count"), F.count_if(active & safe & numbers.truthy(F.col("price"), "number")).alias("usable_count"),
        F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"), F.max(F.struct("seen_at", "retailer_name")).alias("latest"), F.sum(F.coalesce("confidence", F.lit(0.0)).cast("decimal(18,6)")).alias("confidence"),
    )
    out = counted.join(sources.select("source_id", "label", "channel"), "source_id", "left")
    named = F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.col("source_id").cast("string"))
    return out.withColumns({"label": named, "channel": F.coalesce(F.trim("channel"), F.lit(""))})


def per_retailer(parts: DataFrame) -> DataFrame:
    """Sums of a retailer's sources, its sources by active offers, offers and label, and its channels (`other` where none) by
    active offers and name. A retailer has no more entries than sources, so its lists are made in one grouping of the parts."""
    entry = F.struct((-F.col("active_count")).alias("a"), (-F.col("offer_count")).alias("o"), "label", "source_id", "channel", "last_at")
    out = parts.groupBy("retailer_key").agg(
        *[F.sum(c).alias(c) for c in ("offer_count", "active_count", "safe_count", "usable_count", "confidence")], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("latest")["retailer_name"].alias("retailer_name"),
        F.collect_list(entry).alias("__e"), F.array_compact(F.collect_set(F.nullif("channel", F.lit("")))).alias("__channels"),
    )
    shown = lambda x: F.struct(x["source_id"].alias("source_id"), x["label"].alias("label"), x["channel"].alias("channel"), (-x["o"]).alias("offer_count"), (-x["a"]).alias("active_count"), x["last_at"].alias("last_at"))
    named = F.transform("__e", lambda x: F.struct(F.coalesce(F.nullif(x["channel"], F.lit("")), F.lit("other")).alias("channel"), x["a"].alias("a"), x["o"].alias("o")))
    total = lambda name, c: F.aggregate(F.filter("__named", lambda x: x["channel"] == name), F.lit(0).cast("long"), lambda acc, x: acc - x[c])
    by_channel = F.transform(F.array_distinct(F.transform("__named", lambda x: x["channel"])), lambda name: F.struct((-total(name, "a")).alias("a"), name.alias("channel"), total(name, "o").alias("n")))
    listed = F.transform(F.array_sort(by_channel), lambda x: F.struct(x["channel"].alias("channel"), x["n"].alias("offer_count"), (-x["a"]).alias("active_count")))
    known = F.array_sort(F.filter("__e", lambda x: x["source_id"].isNotNull()))
    return out.withColumn("__named", named).withColumns({"sources": F.transform(known, shown), "channels": listed, "source_count": F.size(known), "channel_count": F.size("__channels")}).drop("__e", "__named", "__channels")


def _varied(offers: DataFrame, sources: DataFrame) -> DataFrame:
    """source_count and channel_count where offers have evidence: its sources and channels count beside the offers' own.
    One more pass over the offers, reduced to distinct pairs before they are counted."""
    blank = F.lit("")
    own = F.struct(F.col("source_id").cast("string").alias("source"), F.lit(None).cast("string").alias("channel"), F.lit(True).alias("own"))
    told = F.transform("evidence", lambda e: F.struct(F.nullif(e["source_id"].cast("string"), blank).alias("source"), F.nullif(e["channel"], blank).alias("channel"), F.lit(False).alias("own")))
    pairs = offers.select("retailer_key", F.explode(F.concat(F.array(own), F.coalesce(told, F.slice(F.array(own), 1, 0)))).alias("p")).select("retailer_key", "p.source", "p.channel", "p.own").distinct()
    listed = sources.select(F.col("source_id").cast("string").alias("source"), F.nullif(F.trim("channel"), blank).alias("listed"))
    seen = pairs.join(listed, "source", "left")
    own_channel = F.when(F.col("own"), F.col("listed"))
    return seen.groupBy("retailer_key").agg(F.count_distinct("source").alias("source_count"), F.size(F.array_union(F.collect_set("channel"), F.collect_set(own_channel))).alias("channel_count"))


def crawls(jobs: DataFrame) -> DataFrame:
    """Per retailer, over its RECENT latest jobs: runs, good_runs, failed_runs, low_runs (good ones with few offers stored) and last_good_at.

    jobs: retailer_key, job_id, status, started_at, finished_at, offers_stored.
    """
    latest = ranking.top_per_group(jobs, ["retailer_key"], [F.desc("started_at"), F.desc("job_id")], RECENT)
    good = F.col("status").isin(*GOOD)
    low = F.coalesce("offers_stored", F.lit(0)) < F.greatest(F.lit(5), numbers.half_up(coverage_target(F.col("retailer_key")) * 0.2))
    return latest.groupBy("retailer_key").agg(
        F.count("*").alias("runs"), F.count_if(good).alias("good_runs"), F.count_if(F.col("status") == "failed").alias("failed_runs"), F.count_if(good & low).alias("low_runs"),
        F.max(F.when(good, F.col("finished_at"))).alias("last_good_at"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, numbers.once(part / whole, lambda x: numbers.fixed(x, 3))).otherwise(0.0)


def full(offers: DataFrame, sources: DataFrame, jobs: DataFrame, as_of: Column, known: DataFrame | None = None) -> DataFrame:
    """One row per retailer of the offers, the sources (source_id, retailer_key, label, channel) or known (retailer_key).

    Counts, shares with 3 decimals, sources and channels, crawl figures, signal, reasons, status and priority. Offers
    without a source count for the retailer, not for any source. Where offers have evidence (an array of structs with
    source_id and channel), its sources and channels count as the retailer's too. Without evidence the offers are read
    and shuffled once.
    """
    parts = per_source(offers, sources)
    keys = sources.select("retailer_key")
    keys = (keys.union(known.select("retailer_key")) if known is not None else keys).distinct()
    out = keys.join(per_retailer(parts), "retailer_key", "full").join(crawls(jobs), "retailer_key", "left")
    if "evidence" in offers.columns:
        out = out.drop("source_count", "channel_count").join(_varied(offers, sources), "retailer_key", "left")
    counts = ("offer_count", "active_count", "safe_count", "usable_count", "source_count", "channel_count", "runs", "good_runs", "failed_runs", "low_runs")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {"target": coverage_target(F.col("retailer_key"))})
    active, target = F.col("active_count"), F.col("target")
    out = out.withColumns({
        "confidence_average": _share(F.col("confidence").cast("double"), F.col("offer_count")), "safe_share": _share(F.col("safe_count"), active), "usable_share": _share(F.col("usable_count"), active),
        "coverage_ratio": _share(active, target), "stability": _share(F.col("good_runs"), F.col("runs")),
    }).drop("confidence")
    ratio, varied = F.col("coverage_ratio"), F.col("source_count") >= 2
    signal = F.when(active == 0, "empty").when((ratio >= 1) & varied, "strong").when(ratio >= 0.6, "medium").otherwise("weak")
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_good_at").cast("timestamp"))) / 3.6e9
    top = F.try_element_at("sources", F.lit(1))["active_count"]
    said = lambda holds, name: F.when(holds, REASONS[name])
    reasons = F.array_compact(F.array(
        said(active == 0, "none").when(ratio < 0.6, REASONS["far"]).when(ratio < 1, REASONS["below"]), said(~varied & (active > 0), "single"), said((active > 0) & (top / active >= 0.75), "dominant"),
        said((F.col("offer_count") >= F.greatest(F.lit(20), target)) & (active <= F.greatest(F.lit(5), numbers.half_up(F.col("offer_count") * 0.2))), "inactive"),
        said(hours.isNull() | (hours > FRESH_HOURS), "stale"), said(F.col("failed_runs") >= 2, "failing"), said(F.col("low_runs") >= 2, "yield"), said(F.col("runs") == 0, "unseen"),
    ))
    points = lambda holds, n: F.when(holds, n).otherwise(0)
    s = F.col("signal")
    priority = (
        F.when(s == "empty", 60).when(s == "weak", 40).when(s == "medium", 15).otherwise(0) + points(~varied, 20) + points(F.col("failed_runs") >= 2, 15) + points(F.col("low_runs") >= 2, 15)
        + F.when(hours.isNull(), 15).when(hours > FRESH_HOURS, 10).otherwise(0) + points(ratio < 0.35, 15)
    )
    status = F.when((s == "strong") & (F.col("stability") >= 0.66) & (F.size("reasons") == 0), "trusted").when(s.isin("empty", "weak"), "gap").otherwise("watch")
    return out.withColumns({"signal": signal, "reasons": reasons}).withColumns({"priority": priority, "status": status})


def summary(registry: DataFrame) -> DataFrame:
    """One row of the coverage table's own figures: retailers, and how many are trusted, watched and gaps."""
    return registry.agg(F.count("*").alias("retailers"), *[F.count_if(F.col("status") == s).alias(s) for s in ("trusted", "watch", "gap")])


def no_jobs(spark: SparkSession) -> DataFrame:
    """An empty crawl log."""
    return spark.createDataFrame([], "retailer_key string, job_id string, status string, started_at timestamp, finished_at timestamp, offers_stored long")


def no_sources(spark: SparkSession) -> DataFrame:
    """An empty table of sources."""
    return spark.createDataFrame([], "source_id string, retailer_key string, label string, channel string")
