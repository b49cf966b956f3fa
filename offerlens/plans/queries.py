"""The engine's queries over the star tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.functions import dates, numbers, promotions, text, units
from offerlens.operators import classify, compare, dedupe, metadata, overrides, ranking
from offerlens.plans.offers import AS_OF, OFFERS_SQL, as_of, cents_sql, money_sql, offer_view, table
from offerlens.sources import pages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        SQL[run.__name__] = sql
        return run

    return add


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- scans and filters


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'R' AND l_quantity >= 25")
def q_scan_project_filter(spark, d):
    return table(spark, d, "lineitem").filter("l_linestatus = 'F' and l_returnflag <> 'R' and l_quantity >= 25").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"WITH {OFFERS_SQL} SELECT status, count(*) AS n, count(*) FILTER (is_active AND comparison_safe) AS n_safe, count(*) FILTER (NOT program_required) AS n_public FROM offers GROUP BY status")
def q_status_counts(spark, d):
    return offer_view(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("is_active") & F.col("comparison_safe")).alias("n_safe"), F.count_if(~F.col("program_required")).alias("n_public"))


@query(f"SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '{AS_OF}' AND l_shipdate >= TIMESTAMP '{AS_OF}'")
def q_validity_active(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.filter(dates.valid_at(F.col("o_orderdate"), F.col("l_shipdate"), F.lit(False), as_of())).select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


def _some(spark, d, n):
    """The first retailer names, so that the query doesn't hang on how they are spelt."""
    return [r[0] for r in table(spark, d, "supplier").orderBy("s_suppkey").limit(n).select("s_name").collect()]


@query(f"""WITH {OFFERS_SQL}, chosen AS (SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 6)), own AS (SELECT s_name FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 3))
SELECT offer_id, retailer_key, price FROM offers WHERE retailer_key IN (SELECT s_name FROM chosen) AND (NOT program_required OR retailer_key IN (SELECT s_name FROM own))""")
def q_in_list_program(spark, d):
    names = _some(spark, d, 6)
    return offer_view(spark, d).filter(ranking.filters(retailers=names, programs=names[:3])).select("offer_id", "retailer_key", "price")


# ---- aggregates


@query("SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type")
def q_group_count(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"))


@query(f"""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum({cents_sql('l_extendedprice')}) AS BIGINT) AS sum_cents, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_quantity,
max(l_shipdate) AS last_ship, count(*) FILTER (l_discount > 0.05) AS n_discounted FROM lineitem GROUP BY 1, 2""")
def q_multi_agg(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(numbers.cents(F.col("l_extendedprice"))).alias("sum_cents"), F.sum(F.col("l_quantity").cast("long")).alias("sum_quantity"), F.max("l_shipdate").alias("last_ship"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"),
    )


@query("""WITH latest AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 250)
SELECT event_type, count(*) AS runs, count(DISTINCT user_id) AS users, max(ts) AS last_ts FROM latest GROUP BY event_type""")
def q_latest_n_then_group(spark, d):
    latest = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(250)
    return latest.groupBy("event_type").agg(F.count("*").alias("runs"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("last_ts"))


@query("""WITH w AS (SELECT unnest(list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS word FROM documents)
SELECT word, count(*) AS n_docs FROM w GROUP BY word ORDER BY n_docs DESC, word LIMIT 25""")
def q_explode_sum(spark, d):
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "), lambda x: x != "")
    counted = table(spark, d, "documents").select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n_docs"))
    return counted.orderBy(F.desc("n_docs"), "word").limit(25)


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def q_json_extract(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS nation, coalesce(r_name, 'unknown') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def q_join_left_lookup(spark, d):
    nations = table(spark, d, "nation").filter("n_nationkey % 5 <> 0")
    out = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("s_suppkey", "s_name", F.coalesce("n_name", F.lit("unknown")).alias("nation"), F.coalesce("r_name", F.lit("unknown")).alias("region"))


@query("""WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS custkey, a.k IS NOT NULL AS in_registry, coalesce(b.n, 0) AS n_orders FROM a FULL OUTER JOIN b ON a.k = b.k""")
def q_full_outer_keys(spark, d):
    a = table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("a"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("b")).agg(F.count("*").alias("n"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("custkey"), F.col("a").isNotNull().alias("in_registry"), F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"))


@query("""SELECT c_custkey, coalesce(n, 0) AS open_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) ON c_custkey = o_custkey ORDER BY open_orders DESC, c_custkey LIMIT 100""")
def q_left_join_counts_sorted(spark, d):
    n = table(spark, d, "orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    out = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("open_orders"))
    return out.orderBy(F.desc("open_orders"), "c_custkey").limit(100)


# ---- override rules


def _rules(spark, d):
    """Five rules over the first part names."""
    names = [r[0] for r in table(spark, d, "part").select("p_name").distinct().orderBy("p_name").limit(3).collect()]
    t = lambda day: datetime(2024, 1, day)
    rows = [
        (1, "article", "", names[0].lower(), "", "Haushalt", "Papierwaren", t(1)), (2, "article", "", names[0].lower(), "", "Getraenke", "Wasser", t(2)), (3, "article", "Brand#11", names[0].lower(), "", "Tierbedarf", "Hundefutter", t(1)),
        (4, "subcategory", "", "", names[1].split(" ")[-1], "Haushalt", "Deko & Wohnen", t(3)), (5, "ignore", "", names[2].lower(), "", "", "", t(1)),
    ]
    return spark.createDataFrame(rows, overrides.RULE_SCHEMA)


def _articles(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("offer_id"), F.col("p_brand").alias("retailer_key"), F.lower("p_name").alias("title_normalized"), F.col("p_type").alias("category_primary"), F.element_at(F.split("p_name", " "), -1).alias("category_secondary"))


_RULES_SQL = """names AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS i FROM (SELECT DISTINCT p_name FROM part)),
articles AS (SELECT p_partkey AS offer_id, p_brand AS retailer_key, lower(p_name) AS title, p_type AS main, string_split(p_name, ' ')[-1] AS sub FROM part),
kept AS (SELECT * FROM articles WHERE title <> (SELECT lower(p_name) FROM names WHERE i = 3))"""


@query(f"""WITH {_RULES_SQL} SELECT offer_id,
 CASE WHEN title = n1 AND retailer_key = 'Brand#11' THEN 3 WHEN title = n1 THEN 2 WHEN sub = s2 THEN 4 END::BIGINT AS rule_id,
 CASE WHEN title = n1 AND retailer_key = 'Brand#11' THEN 'Tierbedarf' WHEN title = n1 THEN 'Getraenke' WHEN sub = s2 THEN 'Haushalt' ELSE main END AS category_primary,
 CASE WHEN title = n1 AND retailer_key = 'Brand#11' THEN 'Hundefutter' WHEN title = n1 THEN 'Wasser' WHEN sub = s2 THEN 'Deko & Wohnen' ELSE sub END AS category_secondary
 FROM kept, (SELECT lower(p_name) AS n1 FROM names WHERE i = 1), (SELECT string_split(p_name, ' ')[-1] AS s2 FROM names WHERE i = 2)""")
def q_override_rules(spark, d):
    return overrides.applied(_articles(spark, d), _rules(spark, d)).select("offer_id", "rule_id", "category_primary", "category_secondary")


@query(f"WITH {_RULES_SQL} SELECT offer_id, title FROM kept")
def q_ignore_anti(spark, d):
    return overrides.ignored(_articles(spark, d), _rules(spark, d)).select("offer_id", F.col("title_normalized").alias("title"))


# ---- joins


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def q_semi_filter(spark, d):
    chosen = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(chosen, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


def _wishes(spark, d):
    names = [r[0] for r in table(spark, d, "part").select("p_name").distinct().orderBy("p_name").limit(2).collect()]
    return [names[0], names[1].split(" ")[0]]


@query("""WITH names AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS i FROM (SELECT DISTINCT p_name FROM part)),
w AS (SELECT 0 AS item_no, p_name AS item FROM names WHERE i = 1 UNION ALL SELECT 1, string_split(p_name, ' ')[1] FROM names WHERE i = 2),
p AS (SELECT p_partkey, p_retailprice, lower(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))) AS t FROM part),
q AS (SELECT item_no, item, trim(regexp_replace(lower(item), '[^a-z0-9]+', ' ', 'g')) AS ph FROM w),
s AS (SELECT item_no, item, p_partkey, p_retailprice, (CASE WHEN contains(' ' || t || ' ', ' ' || ph || ' ') THEN 135 ELSE 0 END) + 24 * len(list_filter(string_split(ph, ' '), lambda x: contains(' ' || t || ' ', ' ' || x || ' '))) AS score FROM p, q)
SELECT item_no, item, p_partkey, CAST(score AS INTEGER) AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, p_retailprice, p_partkey) AS rank FROM s WHERE score > 0) WHERE rank <= 3""")
def q_theta_basket(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("offer_id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("unit_price"))
    out = ranking.basket(parts, _wishes(spark, d), {"title": "title"})
    return out.select("item_no", "item", F.col("offer_id").alias("p_partkey"), "score", *_long("rank"))


@query("SELECT o_custkey, o_orderkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_date FROM orders")
def q_next_page_date(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.lead("o_orderdate").over(w).alias("next_date"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), e AS (SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0), f AS (SELECT p_size AS size, min(p_partkey) AS p FROM part WHERE p_size % 2 = 0 GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(e.p_partkey, f.p) AS matched, CASE WHEN e.p_partkey IS NOT NULL THEN 'exact' WHEN f.p IS NOT NULL THEN 'fallback' ELSE 'none' END AS how
FROM l LEFT JOIN e ON l_partkey = e.p_partkey LEFT JOIN f ON e.p_partkey IS NULL AND f.size = l_suppkey % 50""")
def q_fallback_match(spark, d):
    exact = table(spark, d, "part").filter("p_size % 2 = 0")
    other = exact.groupBy(F.col("p_size").alias("size")).agg(F.min("p_partkey").alias("p"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    both = lines.join(exact.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left").join(other, F.col("p_partkey").isNull() & (F.col("size") == F.col("l_suppkey") % 50), "left")
    how = F.when(F.col("p_partkey").isNotNull(), "exact").when(F.col("p").isNotNull(), "fallback").otherwise("none")
    return both.select("l_orderkey", "l_linenumber", F.coalesce("p_partkey", "p").alias("matched"), how.alias("how"))


# ---- duplicates


@query(f"""WITH {OFFERS_SQL}, r AS (SELECT dedupe_key, offer_id, is_active, price, count(*) OVER (PARTITION BY dedupe_key) AS n_merged, min(valid_from) OVER (PARTITION BY dedupe_key) AS first_seen, max(valid_to) OVER (PARTITION BY dedupe_key) AS last_seen,
 row_number() OVER (PARTITION BY dedupe_key ORDER BY is_active DESC, comparison_safe DESC, size DESC, confidence DESC, quantity DESC, channel_no, valid_from, offer_id) AS n FROM offers)
SELECT dedupe_key, offer_id, is_active, price, n_merged, first_seen, last_seen FROM r WHERE n = 1""")
def q_canonical_dedupe(spark, d):
    channel = F.when(F.col("channel_no") == 0, "official-flyer").when(F.col("channel_no") == 1, "official-site").otherwise("aggregator")
    offers = offer_view(spark, d).select(  # what the winner shows and is chosen by, as a whole row goes through the shuffle
        "dedupe_key", "offer_id", "is_active", "price", "comparison_safe", "confidence", "source_id", channel.alias("channel"), F.col("size").alias("completeness"), F.col("quantity").alias("filled"), F.col("valid_from").alias("created_at"), F.col("valid_to").alias("updated_at"),
    )
    return dedupe.canonical(offers).select("dedupe_key", "offer_id", "is_active", "price", "n_merged", "first_seen", "last_seen")


@query("SELECT doc_id, lang, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def q_first_wins(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", text.digest(F.col("text")).alias("h"))
    return dedupe.first_wins(docs, ["h"], ["doc_id"]).drop("h")


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS kinds, count(*) AS n FROM events GROUP BY user_id")
def q_array_union_merge(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("kinds"), F.count("*").alias("n"))


# ---- ranking


@query(f"WITH {OFFERS_SQL} SELECT * FROM (SELECT category_primary, offer_id, unit_price, row_number() OVER (PARTITION BY category_primary ORDER BY unit_price, offer_id) AS rank FROM offers WHERE is_active) WHERE rank <= 4")
def q_rank_in_group(spark, d):
    active = offer_view(spark, d, active=True).select("category_primary", "offer_id", "unit_price")
    return ranking.top_per_group(active, ["category_primary"], ["unit_price", "offer_id"], 4).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {OFFERS_SQL}, e AS (SELECT *, min(unit_price) OVER (PARTITION BY category_primary) AS best_price, max(unit_price) OVER (PARTITION BY category_primary) AS worst_price FROM offers WHERE is_active)
SELECT offer_id, category_primary, unit_price, best_price, worst_price, CASE WHEN best_price > 0 THEN (unit_price - best_price) / best_price * 100 END AS gap_to_best, CASE WHEN worst_price > best_price THEN (unit_price - best_price) / (worst_price - best_price) * 100 ELSE 0.0 END AS relative_position FROM e""")
def q_gap_to_best(spark, d):
    active = offer_view(spark, d, active=True).select("offer_id", "category_primary", "unit_price")
    return ranking.with_gaps(active, ["category_primary"], "unit_price", []).select("offer_id", "category_primary", "unit_price", "best_price", "worst_price", "gap_to_best", "relative_position")


@query("SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q_latest_per_key(spark, d):
    last = F.max(F.struct("ts", "event_id", "event_type")).alias("m")
    return table(spark, d, "events").groupBy("user_id").agg(last).select("user_id", "m.event_id", "m.event_type", "m.ts")


_SCORE_SQL = """(CASE WHEN is_active THEN 100 ELSE 0 END) + (CASE WHEN comparison_safe THEN 50 ELSE 0 END) + (CASE WHEN NOT program_required THEN 20 ELSE 0 END) + 10 + (CASE WHEN quantity <= 1 THEN 10 ELSE 0 END)
 + floor(confidence * 10 + 0.5) + greatest(0, 20 - least(20, floor(unit_price + 0.5)))"""
_CONSUMER_SQL = f"""CAST({_SCORE_SQL} + (CASE WHEN is_active THEN 1000 ELSE 0 END) + (CASE WHEN comparison_safe THEN 500 ELSE 0 END) + greatest(0, 200 - least(200, floor(unit_price * 10 + 0.5)))
 + (CASE WHEN quantity <= 1 THEN 100 ELSE 0 END) + (CASE WHEN NOT program_required THEN 80 ELSE 0 END) + 60 AS BIGINT)"""


def _scores():
    none = F.lit("")
    base = numbers.sort_score(F.col("is_active"), F.col("comparison_safe"), F.col("program_required"), none, F.col("quantity"), F.col("confidence"), F.col("unit_price"))
    return base, numbers.consumer_score(base, F.col("is_active"), F.col("comparison_safe"), F.col("unit_price"), F.col("quantity") <= 1, F.col("program_required"), none)


@query(f"WITH {OFFERS_SQL} SELECT offer_id, title, unit_price, {_CONSUMER_SQL} AS consumer_score FROM offers WHERE is_active ORDER BY consumer_score DESC, unit_price, title, offer_id LIMIT 30")
def q_topk_ranking(spark, d):
    out = offer_view(spark, d, active=True).select("offer_id", "title", "unit_price", _scores()[1].cast("long").alias("consumer_score"))
    return out.orderBy(F.desc("consumer_score"), "unit_price", "title", "offer_id").limit(30)


@query(f"WITH {OFFERS_SQL} SELECT offer_id, CAST({_SCORE_SQL} AS BIGINT) AS sort_score, {_CONSUMER_SQL} AS consumer_score FROM offers")
def q_sort_scores(spark, d):
    base, consumer = _scores()
    return offer_view(spark, d).select("offer_id", base.cast("long").alias("sort_score"), consumer.cast("long").alias("consumer_score"))


def _compare_sql(keys: str) -> str:
    return f"""WITH {OFFERS_SQL}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, dedupe_key ORDER BY unit_price, offer_id) AS n FROM offers WHERE is_active AND unit_price > 0) WHERE n = 1),
g AS (SELECT {keys}, count(DISTINCT retailer_key) AS retailer_count, count(*) AS offer_count, min(unit_price) AS best_price, max(unit_price) AS worst_price FROM one GROUP BY ALL),
b AS (SELECT {keys}, offer_id, retailer_key FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY unit_price, offer_id) AS k FROM one) WHERE k = 1)
SELECT {keys}, retailer_count, offer_count, least(offer_count, 4) AS shown_count, best_price, worst_price, CASE WHEN best_price > 0 THEN (worst_price - best_price) / best_price * 100 END AS spread_percent, b.offer_id AS best_offer_id, b.retailer_key AS best_retailer
FROM g JOIN b USING ({keys}) WHERE retailer_count >= 2 AND offer_count >= 2"""


@query(_compare_sql("brand, title"))
def q_compare_exact(spark, d):
    return compare.comparison(offer_view(spark, d, active=True).filter("unit_price > 0"), ["brand", "title"])


@query(_compare_sql("category_key, unit"))
def q_compare_category(spark, d):
    return compare.comparison(offer_view(spark, d, active=True).filter("unit_price > 0"), ["category_key", "unit"])


@query(f"""WITH {OFFERS_SQL}, base AS (SELECT * FROM offers WHERE is_active AND unit_price > 0)
SELECT 'offers' AS facet, count(*) AS n FROM base UNION ALL SELECT 'products', count(*) FROM (SELECT DISTINCT brand, title FROM base) UNION ALL SELECT 'categories', count(*) FROM (SELECT DISTINCT category_key FROM base)""")
def q_facet_counts(spark, d):
    base = offer_view(spark, d, active=True).filter("unit_price > 0")
    one = base.agg(F.count("*").alias("offers"), F.count_distinct("brand", "title").alias("products"), F.count_distinct("category_key").alias("categories"))
    return one.unpivot([], ["offers", "products", "categories"], "facet", "n")


# ---- aggregate tables


@query(f"""WITH {OFFERS_SQL}, g AS (SELECT region AS retailer_key, count(*) AS offer_count, count(*) FILTER (is_active) AS active_count, count(*) FILTER (is_active AND comparison_safe AND price > 0) AS usable_count, count(DISTINCT source_id) AS source_count, 25 AS target FROM offers GROUP BY region),
r AS (SELECT *, floor(active_count / target * 1000 + 0.5) / 1000 AS coverage_ratio FROM g), s AS (SELECT *, CASE WHEN active_count = 0 THEN 'empty' WHEN coverage_ratio >= 1 AND source_count >= 2 THEN 'strong' WHEN coverage_ratio >= 0.6 THEN 'medium' ELSE 'weak' END AS signal FROM r),
t AS (SELECT *, concat_ws('|', CASE WHEN active_count = 0 THEN 'no-active-offers' WHEN coverage_ratio < 0.6 THEN 'far-below-target' WHEN coverage_ratio < 1 THEN 'below-target' END, CASE WHEN source_count <= 1 THEN 'single-source' END,
 CASE WHEN offer_count >= greatest(20, target) AND active_count <= greatest(5, floor(offer_count * 0.2 + 0.5)) THEN 'mostly-inactive' END) AS reasons FROM s)
SELECT retailer_key, offer_count, active_count, usable_count, source_count, target, coverage_ratio, signal, reasons,
 CAST((CASE signal WHEN 'empty' THEN 60 WHEN 'weak' THEN 40 WHEN 'medium' THEN 15 ELSE 0 END) + (CASE WHEN source_count <= 1 THEN 20 ELSE 0 END) + (CASE WHEN coverage_ratio < 0.35 THEN 15 ELSE 0 END) AS BIGINT) AS priority,
 CASE WHEN signal = 'strong' AND reasons = '' THEN 'trusted' WHEN signal IN ('empty', 'weak') THEN 'gap' ELSE 'watch' END AS status FROM t""")
def q_retailer_coverage(spark, d):
    out = metadata.coverage(offer_view(spark, d).withColumn("retailer_key", F.col("region")))
    return out.select("retailer_key", "offer_count", "active_count", "usable_count", "source_count", "target", "coverage_ratio", "signal", F.array_join("reasons", "|").alias("reasons"), *_long("priority"), "status")


@query(f"""WITH {OFFERS_SQL}, s AS (SELECT main_key, sub_key, count(*) AS active FROM offers WHERE is_active GROUP BY 1, 2)
SELECT main_key, CAST(sum(active) AS BIGINT) AS active_count, string_agg(sub_key || ':' || active, '|' ORDER BY active DESC, sub_key) AS subs FROM s GROUP BY main_key""")
def q_category_tree(spark, d):
    tree = metadata.category_tree(offer_view(spark, d, active=True))
    return tree.select("main_key", "active_count", F.array_join(F.transform("subs", lambda s: F.concat_ws(":", s["sub_key"], s["active"].cast("string"))), "|").alias("subs"))


@query(f"WITH {OFFERS_SQL} SELECT retailer_key, main_key, sub_key, count(*) AS offer_count, count(*) FILTER (is_active) AS active_count, max(valid_to) AS last_to FROM offers GROUP BY 1, 2, 3")
def q_cube(spark, d):
    return metadata.cube(offer_view(spark, d))


@query(f"""WITH {OFFERS_SQL}, s AS (SELECT main_key, sub_key, count(*) AS offers, count(*) FILTER (is_active) AS active FROM offers GROUP BY 1, 2)
SELECT main_key, CAST(sum(offers) AS BIGINT) AS offer_count, CAST(sum(active) AS BIGINT) AS active_count, count(*) FILTER (active > 0) AS active_subs FROM s GROUP BY 1""")
def q_rollup_main(spark, d):
    return metadata.roll_up(metadata.cube(offer_view(spark, d)))


@query(f"WITH {OFFERS_SQL} SELECT retailer_key, count(*) AS n, min(unit_price) AS best_price FROM offers WHERE is_active GROUP BY retailer_key")
def q_retailer_distribution(spark, d):
    return offer_view(spark, d, active=True).groupBy("retailer_key").agg(F.count("*").alias("n"), F.min("unit_price").alias("best_price"))


# ---- quality, audit, digests


@query("""WITH j AS (SELECT lang, source, doc_id, quality, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) AS k FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 0) AS n_bad, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id DESC) FILTER (k <= 3) AS samples FROM j GROUP BY 1, 2""")
def q_quality_mapping(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    counts = j.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("n_bad"))
    top = ranking.top_per_group(j.select("lang", "source", "doc_id"), ["lang", "source"], [F.desc("doc_id")], 3, "k")
    samples = top.groupBy("lang", "source").agg(F.array_join(F.reverse(F.array_sort(F.collect_list("doc_id"))), "|").alias("samples"))
    return counts.join(samples, ["lang", "source"])


@query("SELECT count(*) AS n, count(*) FILTER (quality IS NULL) AS unlabelled, count(*) FILTER (quality = 0 OR toxic = 1) AS flagged, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources FROM documents LEFT JOIN labels USING (doc_id)")
def q_kpi_row(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("flagged"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"))


@query("""WITH j AS (SELECT source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) SELECT source, count(*) AS raw_count, count(*) FILTER (quality = 1 AND toxic = 0) AS stored_count,
greatest(0, count(*) - count(*) FILTER (quality = 1 AND toxic = 0)) AS rejected_count, count(*) FILTER (quality = 0) AS reason_quality, count(*) FILTER (toxic = 1) AS reason_toxic, count(*) FILTER (quality IS NULL) AS reason_unlabelled FROM j GROUP BY source""")
def q_rejection_audit(spark, d):
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")
    g = j.groupBy("source").agg(F.count("*").alias("raw_count"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("stored_count"), F.count_if(F.col("quality") == 0).alias("reason_quality"), F.count_if(F.col("toxic") == 1).alias("reason_toxic"), F.count_if(F.col("quality").isNull()).alias("reason_unlabelled"))
    return g.withColumn("rejected_count", F.greatest(F.lit(0), F.col("raw_count") - F.col("stored_count")).cast("long"))


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 14 DAY AND ts <= TIMESTAMP '2024-01-25 00:00:00'")
def q_retention(spark, d):
    now = F.lit("2024-01-25 00:00:00").cast("timestamp")
    return table(spark, d, "events").filter((F.col("ts") > now - F.expr("interval 14 days")) & (F.col("ts") <= now)).select("event_id", "ts")


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || left(trim(text), 80), chr(10) ORDER BY turn) AS digest FROM conversations GROUP BY conv_id")
def q_conversation_digest(spark, d):
    line = F.concat(F.col("role"), F.lit(": "), text.shortened(F.col("text"), 80))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return g.select("conv_id", "turns", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("digest"))


@query(f"""WITH {OFFERS_SQL} SELECT retailer_key, count(*) AS n, CAST(sum({cents_sql('price')}) AS BIGINT) AS total_cents, count(*) FILTER (program_required) AS n_program,
max(greatest(0, {cents_sql('greatest(0, reference - price)')})) AS strongest_saving_cents FROM offers WHERE is_active GROUP BY retailer_key""")
def q_wishlist_summary(spark, d):
    saving = F.greatest(F.lit(0), numbers.cents(F.col("reference") - F.col("price")))
    return offer_view(spark, d, active=True).groupBy("retailer_key").agg(F.count("*").alias("n"), F.sum(numbers.cents(F.col("price"))).alias("total_cents"), F.count_if("program_required").alias("n_program"), F.max(saving).cast("long").alias("strongest_saving_cents"))


# ---- text, numbers, units, promotions


_FOLD_SQL = "strip_accents(lower(trim(regexp_replace(p, '\\s+', ' ', 'g'))))"


@query(f"WITH t AS (SELECT doc_id, left(text, 400) AS p FROM documents) SELECT doc_id, trim(regexp_replace({_FOLD_SQL}, '[^a-z0-9]+', ' ', 'g')) AS match_title, trim(regexp_replace({_FOLD_SQL}, '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t".replace("left(text, 400)", "text"))
def q_text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.match_title(F.col("text")).alias("match_title"), text.slug(F.col("text")).alias("slug"))


@query("""WITH l AS (SELECT doc_id, replace(replace(replace(replace(lower(coalesce(text, '')), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS p FROM documents),
c AS (SELECT doc_id, array_to_string(list_transform(string_split(p, ''), lambda x: CASE WHEN strip_accents(x) <> x THEN strip_accents(x) || ' ' ELSE x END), '') AS p FROM l), w AS (SELECT doc_id, trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')) AS words FROM c)
SELECT doc_id, len(words) AS n_chars, sha256(words) AS words_sha256, contains(' ' || words || ' ', ' cafe ') AS has_cafe FROM w""")
def q_search_marks(spark, d):
    words = table(spark, d, "documents").select("doc_id", text.search_words(F.col("text")).alias("words"))
    return words.select("doc_id", F.length("words").cast("long").alias("n_chars"), text.digest(F.col("words")).alias("words_sha256"), text.has_phrase(F.col("words"), F.lit("cafe")).alias("has_cafe"))


@query(f"WITH v AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 10 + l_linenumber) / 1000 AS exact FROM lineitem) SELECT l_orderkey, l_linenumber, {money_sql('exact')} AS rounded, {cents_sql('exact * 3')} AS cents FROM v")
def q_round_money(spark, d):
    exact = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) / 1000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.money(exact).alias("rounded"), numbers.cents(exact * 3).alias("cents"))


@query(f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + 13 AS b FROM orders), y AS (SELECT *, year(TIMESTAMP '{AS_OF}') AS y FROM o),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(a AS TIMESTAMP) ELSE make_timestamp(y, month(a), 1, 0, 0, 0) + to_days(CAST(day(a) - 1 AS INTEGER)) END AS f,
 CASE WHEN o_orderkey % 2 = 0 THEN CAST(b AS TIMESTAMP) ELSE make_timestamp(CASE WHEN month(b) < month(a) THEN y + 1 ELSE y END, month(b), 1, 0, 0, 0) + to_days(CAST(day(b) - 1 AS INTEGER)) END AS t FROM y)
SELECT o_orderkey, strftime(f + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M') AS valid_from, strftime(t + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M') AS valid_to FROM r""")
def q_date_range(spark, d):
    begin, end = F.col("o_orderdate").cast("date"), F.date_add(F.col("o_orderdate").cast("date"), 13)
    said = lambda pattern: F.concat(F.lit("Gültig "), F.date_format(begin, pattern), F.lit(" - "), F.date_format(end, pattern))
    printed = F.when(F.col("o_orderkey") % 2 == 0, said("dd.MM.yyyy")).otherwise(said("dd.MM."))
    a, b = dates.date_range(printed, as_of())
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return table(spark, d, "orders").select("o_orderkey", shown(a).alias("valid_from"), shown(b).alias("valid_to"))


_STOP_SQL = ", ".join(f"'{w}'" for w in text.SIGNATURE_STOPWORDS)


@query(f"""SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '\\b\\d+[.,]?\\d*\\b', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')), ' '), lambda x: len(x) > 2 AND x NOT IN ({_STOP_SQL}))[1:8], '-') AS signature FROM part""")
def q_tokens_signature(spark, d):
    return table(spark, d, "part").select("p_partkey", text.signature(F.col("p_name"), F.col("p_brand")).alias("signature"))


@query("""WITH n AS (SELECT min(p_name) AS q FROM part), p AS (SELECT p_partkey, ' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t, trim(regexp_replace(lower(q), '[^a-z0-9]+', ' ', 'g')) AS ph FROM part, n),
s AS (SELECT p_partkey, (CASE WHEN contains(t, ' ' || ph || ' ') THEN 135 ELSE 0 END) + 24 * len(list_filter(string_split(ph, ' '), lambda x: contains(t, ' ' || x || ' '))) AS score FROM p) SELECT p_partkey, CAST(score AS INTEGER) AS score FROM s WHERE score > 0""")
def q_search_score(spark, d):
    parts = table(spark, d, "part")
    wanted = parts.agg(F.min("p_name")).first()[0]
    return parts.select("p_partkey", ranking.relevance({"title": F.col("p_name")}, wanted).alias("score")).filter("score > 0")


@query("SELECT doc_id, sha256(text) AS hash, octet_length(encode(text)) AS n_bytes FROM documents")
def q_sha_len(spark, d):
    return table(spark, d, "documents").select("doc_id", text.digest(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT p_partkey, TRY_CAST(replace(regexp_replace(replace('EUR ' || CAST(p_size AS VARCHAR) || ',' || CAST(p_partkey % 90 + 10 AS VARCHAR), '.', ''), '[^0-9,.-]+', '', 'g'), ',', '.') AS DOUBLE) AS amount FROM part")
def q_parse_amount(spark, d):
    said = F.concat(F.lit("EUR "), F.col("p_size").cast("string"), F.lit(","), (F.col("p_partkey") % 90 + 10).cast("string"))
    return table(spark, d, "part").select("p_partkey", numbers.amount(said).alias("amount"))


@query(f"""WITH u AS (SELECT p_partkey, p_retailprice, p_size, CASE p_partkey % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' WHEN 2 THEN 'kg' ELSE 'Bund' END AS unit FROM part),
b AS (SELECT *, CASE WHEN unit IN ('g', 'ml') THEN p_size * 50 / 1000 ELSE CAST(p_size * 50 AS DOUBLE) END AS q, CASE unit WHEN 'g' THEN 'kg' WHEN 'ml' THEN 'l' ELSE unit END AS base_unit FROM u)
SELECT p_partkey, q AS quantity, base_unit AS base_unit, base_unit IN ('kg', 'l', 'Stk') AS comparable, CASE WHEN base_unit IN ('kg', 'l', 'Stk') THEN {money_sql('p_retailprice / q')} END AS unit_price FROM b""")
def q_unit_price(spark, d):
    unit = F.when(F.col("p_partkey") % 4 == 0, "g").when(F.col("p_partkey") % 4 == 1, "ml").when(F.col("p_partkey") % 4 == 2, "kg").otherwise("Bund")
    base = units.comparable((F.col("p_size") * 50).cast("double"), unit)
    return table(spark, d, "part").withColumn("b", base).select("p_partkey", F.col("b.quantity").alias("quantity"), F.col("b.unit").alias("base_unit"), F.col("b.comparable").alias("comparable"), units.unit_price(F.col("p_retailprice"), F.col("b"))["amount"].alias("unit_price"))


@query("""WITH t AS (SELECT p_partkey, p_name || ' ' || p_size || ' g 2 Stk' AS s FROM part) SELECT p_partkey, TRY_CAST(replace(regexp_extract(s, '(?i)(\\d+(?:[.,]\\d+)?)\\s*(kg|g|ml|cl|l|stk|stueck|stück)\\b', 1), ',', '.') AS DOUBLE) AS quantity, 'g' AS unit, CAST(2 AS DOUBLE) AS packs FROM t""")
def q_qty_from_text(spark, d):
    said = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("g 2 Stk"))
    q = units.quantities_in_text(said)
    return table(spark, d, "part").withColumn("q", q).select("p_partkey", F.col("q")[0]["quantity"].alias("quantity"), F.col("q")[0]["unit"].alias("unit"), F.col("q")[1]["quantity"].alias("packs"))


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS ref, {money_sql('l_extendedprice * (1 - l_discount)')} AS cur, CASE l_linenumber % 3 WHEN 0 THEN 3 ELSE 1 END AS req, CASE l_linenumber % 3 WHEN 0 THEN 2 END AS pay FROM lineitem),
t AS (SELECT *, {money_sql('ref * req')} AS tr, {money_sql('CASE WHEN pay IS NOT NULL AND cur >= ref THEN ref * pay ELSE cur * req END')} AS tc FROM b), s AS (SELECT *, {money_sql('greatest(0, tr - tc)')} AS saved FROM t)
SELECT l_orderkey, l_linenumber, tr AS reference_total, tc AS current_total, CASE WHEN saved > 0 THEN saved END AS savings_amount, CASE WHEN saved > 0 THEN {money_sql('saved / tr * 100')} END AS savings_percent FROM s""")
def q_promo_savings(spark, d):
    title = F.when(F.col("l_linenumber") % 3 == 0, "Aktion 2+1").otherwise("Aktion")
    none = F.lit(None)
    needs = promotions.requirement(title, F.lit(""), none.cast("array<string>"), none.cast("int"), F.lit("unknown"))
    cur = numbers.money(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cur.alias("cur"), F.col("l_extendedprice").alias("ref"), needs.alias("needs"))
    s = promotions.savings(F.col("cur"), F.col("ref"), none.cast("double"), F.lit(False), F.col("needs"))
    return rows.withColumn("s", s).select("l_orderkey", "l_linenumber", "s.reference_total", "s.current_total", F.col("s.amount").alias("savings_amount"), F.col("s.percent").alias("savings_percent"))


# ---- classification and enrichment


def _classify_sql() -> str:
    hits = lambda p: f"(CASE WHEN regexp_matches(t, '{p}') THEN 4 ELSE 0 END)"
    over = " ".join(f"WHEN regexp_matches(t, '{p}') THEN {{'m': '{m}', 's': '{s}', 'c': 0.98::DOUBLE}}" for p, m, s in classify.OVERRIDES)
    subs = " ".join(f"WHEN regexp_matches(t, '{p}') THEN {{'m': '{m}', 's': '{s}', 'c': 0.88::DOUBLE}}" for m, s, p in classify.SUB_RULES)
    mains = " ".join(f"WHEN {hits(p)} > 0 THEN {{'m': '{m}', 's': '{m}', 'c': least(1.0::DOUBLE, 0.52::DOUBLE + 4 * 0.06::DOUBLE)}}" for m, p, _ in classify.TAXONOMY)
    return f"CASE {over} {subs} {mains} ELSE {{'m': 'Lebensmittel', 's': 'Lebensmittel', 'c': 0.35::DOUBLE}} END"


_PRODUCTS = ("Bio Milch 1 l", "Toilettenpapier 3-lagig", "Smart TV 55 Zoll", "Hundefutter Rind", "Apfel rot", "Blumenerde 40 l", "Kugelschreiber blau", "Irgendwas", "Kinder Spiel", "Waschmittel Tabs")


@query(f"""WITH x AS (SELECT p_partkey, (['{"','".join(_PRODUCTS)}'])[CAST(p_partkey % {len(_PRODUCTS)} AS INTEGER) + 1] || ' ' || p_name AS title FROM part), t AS (SELECT p_partkey, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t FROM x), d AS (SELECT p_partkey, {_classify_sql()} AS hit FROM t)
SELECT p_partkey, hit.m AS category_primary, hit.s AS category_secondary, hit.c AS confidence FROM d""")
def q_classify_rules(spark, d):
    title = F.concat_ws(" ", F.element_at(F.array(*[F.lit(p) for p in _PRODUCTS]), (F.col("p_partkey") % len(_PRODUCTS) + 1).cast("int")), "p_name")
    return table(spark, d, "part").select("p_partkey", classify.classified(title).alias("c")).select("p_partkey", F.col("c.primary").alias("category_primary"), F.col("c.secondary").alias("category_secondary"), "c.confidence")


@query(f"""WITH {OFFERS_SQL} SELECT offer_id, concat_ws('|', CASE WHEN coalesce(title, '') = '' THEN 'missing-title' END, CASE WHEN price IS NULL OR price <= 0 THEN 'missing-current-price' END, CASE WHEN confidence < 0.95 THEN 'parser-low-confidence' END,
 CASE WHEN quantity IS NULL OR quantity <= 1 THEN 'missing-quantity' END, CASE WHEN valid_to IS NULL THEN 'validity-incomplete' END, CASE WHEN discount = 0 THEN 'action-price-only' END) AS reasons,
 (confidence < 0.95 OR quantity <= 1 OR price <= 0) AS needs_review FROM offers""")
def q_enrich_flags(spark, d):
    from offerlens.operators import enrich

    reasons = enrich.review_reasons(F.col("title"), F.col("price"), F.col("confidence"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.when(F.col("quantity") > 1, F.col("quantity")), F.col("valid_to"), F.lit(False), F.col("discount") == 0, parser_limit=0.95)
    return offer_view(spark, d).select("offer_id", reasons.alias("r")).select("offer_id", F.array_join("r", "|").alias("reasons"), enrich.needs_review(F.col("r")).alias("needs_review"))


# ---- pages


@query("""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href, unnest(range(1, len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) + 1)) AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href END AS link, pos FROM a), u AS (SELECT page_id, link, min(pos) AS pos FROM r WHERE link IS NOT NULL AND link LIKE 'http%' GROUP BY 1, 2)
SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS rank FROM u QUALIFY rank <= 25""")
def q_links(spark, d):
    return pages.links(table(spark, d, "pages")).select("page_id", "link", *_long("rank"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, octet_length(encode(html)) AS n_bytes FROM pages")
def q_page_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.octet_length("html").cast("long").alias("n_bytes"))


@query("SELECT sha256(html) AS hash, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1")
def q_hash_dedupe_pages(spark, d):
    return table(spark, d, "pages").groupBy(text.digest(F.col("html")).alias("hash")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))
