"""Manual rules on stored offers: ignore, move an article, move a subcategory; the most specific and latest rule wins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import text
from offerlens.sources import versions

RULE_SCHEMA = "rule_id long, kind string, retailer_key string, title_normalized string, from_sub string, to_primary string, to_sub string, updated_at timestamp"


def ignored(offers: DataFrame, rules: DataFrame) -> DataFrame:
    """Offers that no ignore rule names; a rule without retailer holds for all."""
    r = rules.filter("kind = 'ignore'").select(F.col("title_normalized").alias("r_title"), F.col("retailer_key").alias("r_retailer"))
    match = (F.col("title_normalized") == F.col("r_title")) & ((F.col("r_retailer") == "") | (F.col("r_retailer") == F.col("retailer_key")))
    return offers.join(r, match, "left_anti")


def applied(offers: DataFrame, rules: DataFrame, key: str = "offer_id") -> DataFrame:
    """Adds rule_id, and puts the category of the winning rule: article rules before subcategory rules, a rule for the
    retailer before one for all, later before earlier. Rules are few and small; Spark decides whether to broadcast them."""
    kept = ignored(offers, rules)
    a = rules.filter("kind = 'article'").select("rule_id", "to_primary", "to_sub", "updated_at", F.col("title_normalized").alias("r_title"), F.col("retailer_key").alias("r_retailer"))
    hit = kept.select(key, "title_normalized", "retailer_key").join(a, (F.col("title_normalized") == F.col("r_title")) & ((F.col("r_retailer") == "") | (F.col("r_retailer") == F.col("retailer_key"))))
    hit = hit.select(key, "rule_id", "to_primary", "to_sub", F.lit(0).alias("rank"), F.when(F.col("r_retailer") == "", 1).otherwise(0).alias("wild"), "updated_at")
    s = rules.filter("kind = 'subcategory'").select("rule_id", "to_primary", "to_sub", "updated_at", F.col("from_sub").alias("r_sub"))
    moved = kept.select(key, "category_secondary").join(s, F.col("category_secondary") == F.col("r_sub")).select(key, "rule_id", "to_primary", "to_sub", F.lit(1).alias("rank"), F.lit(1).alias("wild"), "updated_at")
    order = Window.partitionBy(key).orderBy("rank", "wild", F.desc("updated_at"), F.desc("rule_id"))
    best = hit.unionByName(moved).withColumn("n", F.row_number().over(order)).filter("n = 1").select(key, "rule_id", "to_primary", "to_sub")
    out = kept.join(best, key, "left").withColumn("category_primary", F.coalesce("to_primary", "category_primary")).withColumn("category_secondary", F.coalesce("to_sub", "category_secondary"))
    return out.withColumn("category_key", text.slug(F.coalesce(F.nullif(F.col("category_secondary"), F.lit("")), F.col("category_primary")), "unkategorisiert")).drop("to_primary", "to_sub")


# ---- changes of rules, and the stored offers they reach

#: What tells two rules apart, by kind.
_IDENTITY = ("kind", "retailer_key", "title_normalized", "from_key")
#: Columns that a rule can change.
_CHANGED = ("rule_id", "category_primary", "category_secondary", "category_key", "main_category_key", "search_text")


def _rule(rules: DataFrame, kind: str, as_of: Column, **given: Column) -> DataFrame:
    """One new rule, with the next number."""
    of = {"kind": F.lit(kind), "retailer_key": F.lit(""), "title_normalized": F.lit(""), "from_sub": F.lit(""), "to_primary": F.lit(None), "to_sub": F.lit(None), "updated_at": as_of} | given
    row = rules.agg((F.coalesce(F.max("rule_id"), F.lit(0)) + 1).alias("rule_id"))
    return row.select("rule_id", *(of[f.name].cast(f.dataType).alias(f.name) for f in rules.schema.fields if f.name != "rule_id"))


def subcategory_rule(rules: DataFrame, label: str, to_primary: str, as_of: Column) -> DataFrame:
    """All offers of a subcategory go to a main category."""
    clean = text.squeezed(F.lit(label))
    return _rule(rules, "subcategory", as_of, from_sub=clean, to_primary=text.squeezed(F.lit(to_primary)), to_sub=clean)


def _article(title: str, display: str) -> Column:
    return F.coalesce(F.nullif(text.squeezed(F.lit(title)), F.lit("")), text.match_title(F.lit(display)))


def article_rule(rules: DataFrame, to_primary: str, to_sub: str, as_of: Column, title: str = "", display: str = "", retailer: str = "") -> DataFrame:
    """An article, by its match title or as displayed, goes to a main and subcategory; without retailer, everyone's."""
    return _rule(rules, "article", as_of, title_normalized=_article(title, display), retailer_key=text.squeezed(F.lit(retailer)), to_primary=text.squeezed(F.lit(to_primary)), to_sub=text.squeezed(F.lit(to_sub)))


def ignore_rule(rules: DataFrame, as_of: Column, title: str = "", display: str = "", retailer: str = "") -> DataFrame:
    """An article is no offer at all."""
    return _rule(rules, "ignore", as_of, title_normalized=_article(title, display), retailer_key=text.squeezed(F.lit(retailer)))


def with_rules(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Rules with the changes put over them: one of the same kind, article and retailer, or subcategory, keeps its number."""
    key = lambda df: df.withColumn("from_key", text.slug(F.col("from_sub")))
    old, new = key(rules), key(changes)
    known = old.select(*_IDENTITY, F.col("rule_id").alias("__known"))
    again = new.join(known, list(_IDENTITY), "left").withColumn("rule_id", F.coalesce("__known", "rule_id")).select(*rules.columns)
    return old.join(new.select(*_IDENTITY), list(_IDENTITY), "left_anti").select(*rules.columns).unionByName(again)


def reached(offers: DataFrame, changes: DataFrame) -> DataFrame:
    """Offers that a changed rule speaks of: by article, and by subcategory whatever the case of its letters."""
    c = changes.select("kind", F.col("retailer_key").alias("c_retailer"), F.col("title_normalized").alias("c_title"), F.lower("from_sub").alias("c_sub"))
    article = c.filter("kind in ('article', 'ignore')")
    on = (F.col("title_normalized") == F.col("c_title")) & ((F.col("c_retailer") == "") | (F.col("c_retailer") == F.col("retailer_key")))
    by_title = offers.join(article, on, "left_semi")
    by_sub = offers.join(c.filter("kind = 'subcategory'"), F.lower("category_secondary") == F.col("c_sub"), "left_semi")
    return by_title.unionByName(by_sub.join(article, on, "left_anti"))


def reapplied(offers: DataFrame, rules: DataFrame, changes: DataFrame, key: str = "offer_id") -> DataFrame:
    """Offers with all rules applied anew to those that a changed rule reaches; ignored ones go, others stay as they are.
    Keys and search text follow the category, where offers have them."""
    hit = reached(offers, changes)
    done = applied(hit.drop("rule_id"), rules, key)
    if "main_category_key" in offers.columns:
        done = done.withColumn("main_category_key", text.slug(F.col("category_primary"), "unkategorisiert"))
    if "search_text" in offers.columns:
        done = done.withColumn("search_text", text.match_title(F.concat_ws(" ", *(c for c in ("title", "brand", "category_primary", "category_secondary", "retailer_name", "conditions") if c in offers.columns))))
    # a rule that speaks no longer of a row leaves its mark
    done = done.withColumn("rule_id", F.coalesce("rule_id", F.lit(None).cast("long"))) if "rule_id" in offers.columns else done.drop("rule_id")
    return offers.join(hit.select(key), key, "left_anti").unionByName(done.select(*offers.columns))


def _stored(df: DataFrame, root: str, name: str) -> DataFrame:
    """Written and read again: rules are a few rows, but what made them would be planned anew at each of their uses."""
    path = f"{root}/{name}/{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def change_stored(spark: SparkSession, root: str, rules: DataFrame, changes: DataFrame, key: str = "offer_id") -> tuple[DataFrame, dict[str, int]]:
    """Upsert rules and carry the change to the offers stored at root (sources.versions), whose parts without a reached
    offer keep their files. Returns all rules, and how many offers were matched, modified and deleted.

    The driver sees one row for each part; a writer that was overtaken gets versions.Conflict and starts again.
    """
    base = versions.state(spark, root)
    stored = versions.read(spark, root, at=base)
    rules = _stored(with_rules(rules, changes), root, "rules")
    changes = _stored(changes, root, "rule-changes")
    hit = reached(stored, changes).withColumn(versions.PART, versions.part_of(F.col(base.by), base.n_parts))
    per_part = {r[versions.PART]: r["n"] for r in hit.groupBy(versions.PART).agg(F.count("*").alias("n")).collect()}  # n_parts rows at most
    if not per_part:
        return rules, {"matched": 0, "modified": 0, "deleted": 0}
    before = versions.read(spark, root, per_part, base)
    new = versions.rewrite(reapplied(before, rules, changes, key), root, per_part, base)
    after = versions.read(spark, root, per_part, new)
    changed = [c for c in _CHANGED if c in before.columns]
    pairs = before.select(key, *changed).join(after.select(key, *(F.col(c).alias(f"new_{c}") for c in changed), F.lit(True).alias("there")), key, "left")
    differs = F.lit(False)
    for c in changed:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    counts = pairs.agg(F.count(F.when(F.col("there").isNull(), 1)).alias("deleted"), F.count(F.when(F.col("there") & differs, 1)).alias("modified")).first()
    return rules, {"matched": sum(per_part.values()), "modified": counts["modified"] + counts["deleted"], "deleted": counts["deleted"]}
