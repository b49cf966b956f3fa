"""Crawl audits, quality snapshots and digests over offers, jobs and essences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.operators import ranking


def rejection_reasons(reasons: DataFrame) -> DataFrame:
    """(reason, count) rows summed by trimmed reason, those above 0, largest first."""
    rows = reasons.select(F.trim("reason").alias("reason"), "count").filter("count > 0 and reason <> ''")
    return rows.groupBy("reason").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "reason")


def job_summary(raw: DataFrame, stored: DataFrame, by: str = "source_id") -> DataFrame:
    """Per source: raw, stored and rejected rows, and the job's status (success with stored rows, else partial)."""
    r = raw.groupBy(by).agg(F.count("*").alias("raw_count"))
    s = stored.groupBy(by).agg(F.count("*").alias("stored_count"), F.count_if("needs_review").alias("review_count"))
    both = r.join(s, by, "left").withColumn("stored_count", F.coalesce("stored_count", F.lit(0)))
    return both.withColumns({"rejected_count": F.greatest(F.lit(0), F.col("raw_count") - F.col("stored_count")), "status": F.when(F.col("stored_count") > 0, "success").otherwise("partial")})


def mapping_counts(offers: DataFrame, by: list[str], samples: int = 3) -> DataFrame:
    """Per label: offers, active ones, retailers, the latest titles and the last update."""
    counts = offers.groupBy(*by).agg(F.count("*").alias("offer_count"), F.count_if("is_active").alias("active_count"), F.count_distinct("retailer_key").alias("retailer_count"), F.max("updated_at").alias("last_update"))
    latest = ranking.top_per_group(offers.select(*by, "updated_at", "title", "offer_id"), by, [F.desc("updated_at"), F.desc("offer_id")], samples, "n")
    titles = latest.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "title"))), lambda x: x["title"]).alias("samples"))
    return counts.join(titles, by)


def searched(offers: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Offers of which a column holds the text, case aside; the text is no pattern."""
    if not query:
        return offers
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lit(query.lower()))
    return offers.filter(hit)


def latest_essences(jobs: DataFrame, most: int = 24) -> DataFrame:
    """One line of the first essence of each retailer among the latest successful jobs."""
    recent = jobs.filter("status = 'success'").orderBy(F.desc("started_at"), F.desc("job_id")).limit(most)
    first = recent.groupBy("retailer_key").agg(F.max(F.struct("started_at", "job_id", "essence")).alias("m"))
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("retailer_key", F.col("m.essence").alias("essence")))), lambda x: x["essence"]), "\n").alias("digest"))


def kpis(offers: DataFrame, as_of: Column) -> DataFrame:
    """The dashboard's counts in one pass."""
    valid = F.coalesce(F.col("valid_from") <= as_of, F.lit(False)) & F.coalesce(F.col("valid_to") >= as_of, F.lit(False))
    return offers.agg(
        F.count("*").alias("offers"), F.count_if("is_active").alias("active_by_status"), F.count_if(valid).alias("active_by_date"), F.count_if("comparison_safe").alias("comparable"),
        F.count_if(F.size("issues") > 0).alias("with_issues"), F.count_distinct("retailer_key").alias("retailers"), F.max("updated_at").alias("last_update"),
    )


# Groups of the shopping client, as (group, parts of category labels), first hit.
CLIENT_GROUPS = (
    ("Wein", ("weisswein", "rotwein", "rose", "wein", "schaumwein", "perlwein", "sekt", "dessertwein", "portwein")), ("Bier", ("bier", "flaschenbier", "dosenbier", "radler", "weizenbier", "helles")),
    ("Spirituosen", ("aperitif", "digestif", "schnaps", "vodka", "gin", "likor", "cognac", "whiskey", "alkohol")), ("Kaffee", ("kaffee", "ganze bohne", "gemahlen", "eiskaffee", "loslich", "kapseln", "pads", "espresso")),
    ("Mehl", ("weizenmehl", "dinkelmehl", "mehl")), ("Baby & Kind", ("windeln", "babynahrung", "glaschen", "baby")), ("Tierbedarf", ("katze", "katzepflege", "hund", "tier")),
)


def client_group(label: Column, rules=CLIENT_GROUPS) -> Column:
    """The first group of which a part occurs in the folded label, else the label."""
    t = text.match_title(label)
    out = F.when(t == "", "")
    for name, parts in rules:
        out = out.when(F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(t, p)), name)
    return out.otherwise(label)


def reliable_saving(saving: Column, current: Column, reference: Column, estimated: Column) -> Column:
    return F.when(saving > 0, saving).when(~F.coalesce(estimated, F.lit(False)) & (reference > current), reference - current)


def directly_comparable(safe: Column, group: Column, unit_price: Column) -> Column:
    return F.coalesce(safe & (group != "") & unit_price.isNotNull(), F.lit(False))


def stable_id(*candidates: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def shopping_list(entries: DataFrame) -> DataFrame:
    """Per retailer: entries, open ones, total, savings and the titles in order."""
    line = F.struct("title", "quantity")
    return entries.groupBy("retailer_key").agg(
        F.count("*").alias("entries"), F.count_if(~F.col("done")).alias("open"), F.sum((F.col("price") * F.col("quantity")).cast("decimal(18,2)")).alias("total"), F.max(F.greatest(F.coalesce("saving", F.lit(0.0)), F.lit(0.0))).alias("strongest_saving"),
        F.array_sort(F.collect_list(line)).alias("lines"),
    )
