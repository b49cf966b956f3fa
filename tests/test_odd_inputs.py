"""Registered queries against their SQL on small tables of what the smallest ones lack."""

import os
import time
from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from offerlens.functions import text
from offerlens.plans import catalog, changes, landed, offers  # noqa: F401 - they register their queries
from offerlens.plans import queries as plans
from offerlens.sources import nested, paged


def compared(spark, folder, name, **tables):
    """A query's rows over the tables, which must be those of its SQL."""
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t, rows in tables.items():
        pq.write_table(rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows), f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = plans.QUERIES[name](spark, str(folder))
    rel = con.sql(plans.SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    return got


def test_cut_off_and_other_entities_stay_in_headings(spark, tmp_path):
    page = '<!DOCTYPE html><html lang="de"><head><title>{0}</title></head><body><nav><ul><li><a href="/a,">a</a></li></ul></nav><div class="ad">x</div><article><h1>{0}</h1><p>x</p></article></body></html>'
    heads = ["a&amp; b&amp", "A &amp;lt; B &lt; &#39;c&#39; &quot", "&eacute; &copy &#38; &", "AT&T &amp"]
    got = compared(spark, tmp_path, "q_page_elements", pages=[{"page_id": i, "html": page.format(h)} for i, h in enumerate(heads)])
    assert got[0][5] == "a& b&amp"


def test_marks_part_words_in_any_text_without_asking_each_character_for_each_mark(spark):
    every = [c for c in map(chr, range(0xA0, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c]
    df = spark.createDataFrame([(c, f"x{c}y") for c in every], "c string, t string")
    words = {r.c: r.w for r in df.select("c", text.search_words(F.col("t")).alias("w")).collect()}
    plain = dict(zip(text.ACCENTED, text.PLAIN)) | dict(zip("äöüß", ("ae", "oe", "ue", "ss")))
    assert words == {c: f"x{plain[c]} y" if c in text.MARKED and c not in "äöüß" else f"x{plain[c]}y" if c in plain else "x y" for c in every}

    long = spark.range(8).select(F.concat(F.repeat(F.lit("ein Wort da "), 30000), F.repeat(F.lit("а"), 30000), F.col("id").cast("string")).alias("t")).cache()

    def best(c):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            long.agg(F.sum(F.length(c))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    rest = F.trim(F.regexp_replace(F.translate(text.ascii_lower(F.col("t")), text.ACCENTED, text.PLAIN), "[^a-z0-9]+", " "))
    assert best(text.search_words(F.col("t"))) < 5 * best(rest)


def test_promotions_cut_payloads_once_and_sections_are_no_fallbacks(spark):
    section = '{"title":"Beliebte Aktionen bei R","x":1}'
    assert nested.fallback_of(f"1:{section}", nested.SECTION, "Beliebte Aktionen bei R") == [None]
    assert nested.fallback_of('{"title":"open",{' + section, nested.SECTION, "Beliebte Aktionen bei R") == [section]
    assert nested.fallback_of(None, nested.SECTION, "R") == nested.fallback_of(section[:-1], nested.SECTION, "Beliebte Aktionen bei R") == []
    df = spark.createDataFrame([("s", "R", 0, section)], "source_id string, retailer_name string, record int, payload string")
    plan = nested.promotions(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.count("try_parse_json") <= 4  # once for sections and groups, once for fallbacks


def test_many_small_pages_share_tasks(spark, tmp_path):
    for k in range(2 * paged.TASKS + 1):
        os.makedirs(f"{tmp_path}/l/source_id=a/page={k}")
        open(f"{tmp_path}/l/source_id=a/page={k}/part-0.txt", "w").write(f'{{"results": [{k}], "totalResults": {2 * paged.TASKS + 1}}}')
    found = paged.offset_items(spark, f"{tmp_path}/l", 1)
    assert sorted((r.page, r.item) for r in found.collect()) == [(k, str(k)) for k in range(2 * paged.TASKS + 1)]
    assert paged.pages(spark, f"{tmp_path}/l", limit=1).rdd.getNumPartitions() <= paged.TASKS


def planned(spark, df):
    """The physical plan where nothing is small enough to be sent to all tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


SF = "/root/testdata/sf0.001"


def test_lines_meet_orders_and_parts_without_being_sorted(spark):
    plan = planned(spark, lambda: plans.QUERIES["q_cube"](spark, SF))
    assert plan.count("ShuffledHashJoin") == 2  # before, all joins were by sorting


def test_active_offers_are_chosen_before_the_shuffle(spark):
    every, active = offers.offer_view(spark, SF), offers.offer_view(spark, SF, active=True)
    assert sorted(r[0] for r in active.select("offer_id").collect()) == sorted(r[0] for r in every.filter("is_active").select("offer_id").collect())
    for name in ("q_gap_to_best", "q_ranking_summary"):  # F6, F8
        scans = [line for line in planned(spark, lambda: plans.QUERIES[name](spark, SF)).splitlines() if "FileScan" in line and "l_shipdate" in line]
        assert scans and all("1998-06-01" in line for line in scans)


def test_active_offers_may_lack_a_date(spark, tmp_path):
    day = lambda m: datetime(1998, m, 1)
    dates = [(None, None), (None, day(7)), (None, day(5)), (day(5), None), (day(7), None), (day(5), day(7)), (day(7), day(8)), (day(6), day(6))]
    for t in ("nation", "supplier", "part"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    numbered = [(i, *d) for i, d in enumerate(dates)]
    one = spark.read.parquet(f"{SF}/lineitem.parquet").limit(1)
    one.drop("l_orderkey", "l_shipdate").crossJoin(spark.createDataFrame([(n[0], n[2]) for n in numbered], "l_orderkey long, l_shipdate timestamp")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(n[0], n[1]) for n in numbered], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    ids = lambda df: sorted(r[0] // 10 for r in df.select("offer_id").collect())
    assert ids(offers.offer_view(spark, str(tmp_path), active=True)) == ids(offers.offer_view(spark, str(tmp_path)).filter("is_active")) == [1, 3, 5, 7]


def test_cache_filter_reads_a_stored_cache(spark):
    plan = planned(spark, lambda: plans.QUERIES["q_offer_cache_filter"](spark, SF))
    assert "l_orderkey" not in plan and "rangepartitioning" not in plan  # before, the offers were joined and sorted again for each use


def test_only_what_canonical_offers_show_is_shuffled(spark):
    plan = planned(spark, lambda: plans.QUERIES["q_canonical_dedupe"](spark, SF))
    assert "category_key" not in plan  # before, all columns of an offer


def test_only_cells_multiply_by_level(spark):
    plan = plans.QUERIES["q_category_totals"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Expand") :]  # F11
