"""Registered queries that change stored tables and read them back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from offerlens.functions import numbers, sparse
from offerlens.operators import overrides
from offerlens.plans.offers import as_of, table
from offerlens.plans.queries import _RULES_SQL, QUERIES, SQL, _articles, query
from offerlens.sources import memo, paged, shared, versions


@query(f"""WITH {_RULES_SQL} SELECT offer_id, retailer_key,
 CASE WHEN title = n1 AND retailer_key = 'Brand#11' THEN 3 WHEN title = n1 THEN 2 WHEN sub = s2 THEN 4 END::BIGINT AS rule_id,
 CASE WHEN title = n1 AND retailer_key = 'Brand#11' THEN 'Tierbedarf' WHEN title = n1 THEN 'Getraenke' WHEN sub = s2 THEN 'Haushalt' ELSE main END AS category_primary,
 CASE WHEN title = n1 AND retailer_key = 'Brand#11' THEN 'Hundefutter' WHEN title = n1 THEN 'Wasser' ELSE sub END AS category_secondary
 FROM kept, (SELECT lower(p_name) AS n1 FROM names WHERE i = 1), (SELECT string_split(p_name, ' ')[-1] AS s2 FROM names WHERE i = 2)""")
def q_override_changes(spark, d):
    """Articles stored by retailer, then four changes of rules, each of which rewrites the parts it reaches: one article
    ignored, one moved (twice: the second change replaces the first), one retailer's article moved, a subcategory moved."""
    names = [r[0].lower() for r in table(spark, d, "part").select("p_name").distinct().orderBy("p_name").limit(3).collect()]
    root, now = shared.new_path(spark, "override-changes"), as_of()
    versions.write(_articles(spark, d).withColumn("rule_id", F.lit(None).cast("long")), root, "retailer_key", 16)
    rules = spark.createDataFrame([], overrides.RULE_SCHEMA)
    for rule in (
        lambda r: overrides.ignore_rule(r, now, title=names[2]), lambda r: overrides.article_rule(r, "Haushalt", "Papierwaren", now, title=names[0]), lambda r: overrides.article_rule(r, "Getraenke", "Wasser", now, display=names[0].upper()),
        lambda r: overrides.article_rule(r, "Tierbedarf", "Hundefutter", now, title=names[0], retailer="Brand#11"), lambda r: overrides.subcategory_rule(r, names[1].split(" ")[-1], "Haushalt", now),
    ):
        rules, _ = overrides.change_stored(spark, root, rules, rule(rules))
    return versions.read(spark, root).select("offer_id", "retailer_key", "rule_id", "category_primary", "category_secondary")


PAGE = 25


@query(f"""WITH c AS (SELECT c_custkey, c_name, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, c_custkey % 8 AS s, c_custkey // 8 // {PAGE} AS page, c_custkey // 8 % {PAGE} AS place FROM customer),
landed AS (SELECT * FROM c WHERE NOT (s % 5 = 1 AND page = 1 AND place = {PAGE - 1}) AND NOT (s % 5 = 2 AND page = 1)), pages AS (SELECT DISTINCT s, page FROM c),
n AS (SELECT p.s, p.page, count(c_custkey) AS n FROM pages p LEFT JOIN landed l ON l.s = p.s AND l.page = p.page GROUP BY ALL), ends AS (SELECT s, min(page) AS last FROM n WHERE n < {PAGE} GROUP BY s)
SELECT CAST(l.s AS VARCHAR) AS source_id, CAST(l.page AS BIGINT) AS page, CAST(l.place AS BIGINT) AS place, c_custkey AS id, c_name AS name, cents FROM landed l LEFT JOIN ends e ON e.s = l.s WHERE l.page <= coalesce(e.last, l.page)""")
def q_paged_items(spark, d):
    """Customers landed as JSON pages of eight offset sources; in some a page is short or broken, and what follows doesn't count."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select((k % 8).alias("source_id"), F.floor(F.floor(k / 8) / PAGE).alias("page"), (F.floor(k / 8) % PAGE).alias("place"), F.struct(k.alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).alias("item"))
    entries = F.transform(F.array_sort(F.collect_list(F.when(~((F.col("source_id") % 5 == 1) & (F.col("page") == 1) & (F.col("place") == PAGE - 1)), F.struct("place", "item")))), lambda x: x["item"])
    bodies = rows.groupBy("source_id", "page").agg(entries.alias("results"))  # PAGE entries
    totals = rows.groupBy("source_id").agg(F.count("*").alias("totalResults"))
    bodies = bodies.join(totals, "source_id")
    root = shared.new_path(spark, "paged-items")
    body = F.when((F.col("source_id") % 5 == 2) & (F.col("page") == 1), '{"results": [').otherwise(F.to_json(F.struct("results", "totalResults")))
    # a file each: what costs time is their number, not their size, by which Spark would put all of them into one task
    spread = bodies.select("source_id", "page", body.alias("value")).repartition(4 * spark.sparkContext.defaultParallelism, "source_id", "page")
    spread.write.partitionBy("source_id", "page").text(root)
    item = F.from_json("item", "id long, name string, balance double")
    found = paged.offset_items(spark, root, PAGE).withColumn("item", item)
    return found.select("source_id", F.col("page").cast("long").alias("page"), F.col("place").cast("long").alias("place"), "item.id", "item.name", numbers.cents(F.col("item.balance")).alias("cents"))


@query("""WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS title FROM customer)
SELECT k AS id, '{"title":"' || title || '","long":"' || substr(repeat(n || '-', 30), 1, 240) || '","active":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"count":' || k % 5 || CASE WHEN k % 4 = 0 THEN '' ELSE ',"missing":"m"' END
  || ',"tags":["a","' || repeat('t', 120) || '","b","c","d"]' || ',"items":[{"name":"x ' || k || '","n":' || k || '}],"inner":{' || CASE WHEN k % 7 = 0 THEN '' ELSE '"code":"' || s || '",' END || '"flag":false},"by_key":{"s":"' || s || '"}}' AS compact,
 '{' || array_to_string(list_filter([CASE WHEN title <> '' THEN '"title":"  ' || title || ' "' END, CASE WHEN k % 2 = 0 THEN '"active":true' END, '"count":' || k % 5, CASE WHEN k % 4 <> 0 THEN '"missing":"m"' END], lambda x: x IS NOT NULL), ',') || '}' AS sparse
FROM c""")
def q_sparse_payload(spark, d):
    """Payloads of customers, compacted and without empty entries, as JSON."""
    k, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    title = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("  "), name, F.lit(" ")))
    missing, active, count = F.when(k % 4 != 0, "m"), k % 2 == 0, (k % 5).cast("int")
    deep = F.struct(F.lit("z").alias("z"))
    payload = F.struct(
        title.alias("title"), F.repeat(F.concat(name, F.lit("-")), 30).alias("long"), active.alias("active"), count.alias("count"), missing.alias("missing"), F.array(F.lit(" "), F.lit("a"), F.lit("t" * 130), F.lit(None), F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e")).alias("tags"),
        F.array(F.lit(1), k).alias("numbers"), F.array().cast("array<string>").alias("none"), F.array(F.struct(F.concat(F.lit("x "), k).alias("name"), deep.alias("deep"), k.alias("n")), F.lit(None)).alias("items"),
        F.struct(F.when(k % 7 != 0, segment).alias("code"), F.lit(False).alias("flag"), deep.alias("deep")).alias("inner"), F.struct(deep.alias("deep")).alias("bare"), F.struct(F.lit(None).cast("string").alias("x")).alias("hollow"), F.create_map(F.lit("s"), segment).alias("by_key"),
    )
    rows = table(spark, d, "customer").select(k.alias("id"), payload.alias("payload"), F.struct(title.alias("title"), active.alias("active"), count.alias("count"), missing.alias("missing")).alias("facts"))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select("id", F.to_json(sparse.compacted(F.col("payload"), kind["payload"])).alias("compact"), F.to_json(sparse.without_empty(F.col("facts"), kind["facts"])).alias("sparse"))


@query(SQL["q_topk_ranking"])
def q_ranking_memo(spark, d):
    """A ranking asked twice in other words: the second answer is the kept one."""
    kept, now = memo.Memo(spark, shared.new_path(spark, "ranking-memo")), datetime(2025, 5, 10, 12)
    make = lambda: QUERIES["q_topk_ranking"](spark, d)
    kept.remember("1", "top", {"q": " Milch ", "retailers": "spar,billa", "public": "true"}, make, now)
    return kept.get("1", "top", {"public": True, "retailers": ["billa", "spar"], "q": "milch"}, now)
