"""Normalization, enrichment, overrides, duplicates, storage, streaming and the served queries."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from offerlens.operators import audit, dedupe, enrich, normalize, overrides, ranking
from offerlens.plans import offers as view
from offerlens.plans import served
from offerlens.sources import pages, registry, store
from offerlens.streaming import ingest

SF = "/root/testdata/sf0.001"
def as_of():
    return F.lit("2024-05-15").cast("timestamp")


def promotion_row(**given):
    row = dict(source_id="s1", retailer_key="spar", retailer_name="Spar", region="at", title="Frische Milch", description="", brand="Hof", price="1,99", old_price="2,49", percent=None, minimum=None, tags=None, quantity=500.0, unit="ml", packs=None, pack_unit=None, pack_unit_type=None, source_category=None, valid_from=datetime(2024, 5, 1), valid_to=datetime(2024, 6, 1), snapshot=False, url="u", channel="official-flyer")
    return row | given


def test_normalized_offer(spark):
    rows = [promotion_row(), promotion_row(title=" "), promotion_row(price="0"), promotion_row(title="Bier 2+1 gratis", quantity=None, unit=None)]
    out = {r.title: r for r in normalize.offers(spark.createDataFrame(rows, normalize.PROMOTION), as_of()).collect()}
    assert set(out) == {"Frische Milch", "Bier 2+1 gratis"}
    milk = out["Frische Milch"]
    assert (milk.price, milk.reference, milk.unit_price.amount, milk.unit_price.unit, milk.status, milk.category_secondary) == (1.99, 2.49, 3.98, "l", "active", "Milchprodukte")
    assert milk.comparison_group == "hof-frische-milch::0.5-l" and milk.savings.amount == 0.5 and milk.issues == []
    assert milk.dedupe_key.startswith("spar::milchprodukte::hof-frische-milch::0.5-l::") and milk.completeness == 1.0
    assert out["Bier 2+1 gratis"].comparison_group == "" and out["Bier 2+1 gratis"].discount_type == "multi-buy"


def test_enrichment_flags_price_only_offers(spark):
    offer = dict(title="Offer", price=1.99, reference=None, reference_source="", category_primary="Lebensmittel", category_secondary="Kaese", channel="official-flyer", source_type="flyer", source_url="u", parsing_confidence=0.8, quantity=None, valid_to=None, snapshot=False)
    kinds = "title string, price double, reference double, reference_source string, category_primary string, category_secondary string, channel string, source_type string, source_url string, parsing_confidence double, quantity double, valid_to timestamp, snapshot boolean"
    r = enrich.enriched(spark.createDataFrame([offer], kinds)).first()
    assert r.savings.display_type == "action-price-only" and r.savings.action_price_only and not r.savings.prospect and r.needs_review
    assert r.review_reasons == ["missing-quantity", "validity-incomplete", "action-price-only"]
    assert (round(r.category_confidence, 9), round(r.subcategory_confidence, 9), r.source_confidence) == (0.78, 0.73, 0.9)


@pytest.mark.parametrize("decides", range(7))
def test_canonical_order(spark, decides):
    a = dict(dedupe_key="k", offer_id=1, is_active=True, comparison_safe=True, completeness=0.5, confidence=0.5, filled=3, channel="official-site", source_id="a", created_at=datetime(2024, 1, 2), updated_at=datetime(2024, 1, 2))
    key, worse = [("is_active", False), ("comparison_safe", False), ("completeness", 0.1), ("confidence", 0.1), ("filled", 1), ("channel", "aggregator"), ("created_at", datetime(2024, 1, 3))][decides]
    b = a | {"offer_id": 0, "source_id": "b", key: worse}
    out = dedupe.canonical(spark.createDataFrame([a, b])).collect()
    assert [(r.offer_id, r.n_merged, r.seen_in) for r in out] == [(1, 2, ["a", "b"])]


def test_evidence_keeps_first_of_each(spark):
    e = lambda s, at: f"named_struct('source_id', '{s}', 'channel', 'c', 'url', 'u', 'retailer', 'r', 'kind', 'k', 'at', {at})"
    lists = F.expr(f"array(array({e('a', 1)}, {e('b', 2)}), array({e('a', 3)}))")
    assert [(x.source_id, x.at) for x in spark.range(1).select(dedupe.merged_evidence(lists).alias("x")).first().x] == [("a", 1), ("b", 2)]


def test_eligibility(spark):
    df = spark.createDataFrame([(True, "a"), (True, "b"), (False, "b")], "program_required boolean, retailer_key string")
    count = lambda **k: df.filter(ranking.filters(**k)).count()
    assert (count(), count(programs=["a"]), count(programs=["a"], only_public=True), count(retailers=["a"], programs=["a"])) == (1, 2, 1, 1)


def test_relevance(spark):
    df = spark.createDataFrame([("Apfel Saft",), ("Apfelmus",), ("Saft",)], "title string")
    got = {r.title: r.s for r in df.select("title", ranking.relevance({"title": F.col("title")}, "Apfel Saft").alias("s")).collect()}
    assert got == {"Apfel Saft": 120 + 15 + 48, "Apfelmus": 0, "Saft": 24}
    assert df.select(ranking.relevance({"title": F.col("title")}, " ").alias("s")).distinct().first().s == 1


@pytest.fixture(scope="module")
def offers(spark):
    o = view.offer_view(spark, SF)
    return o.withColumns({"updated_at": F.col("valid_from"), "issues": F.array().cast("array<string>")}).cache()


def test_ranking(offers):
    out = served.offer_ranking(offers, limit=7)
    rows = out["items"].collect()
    assert len(rows) == 7 and [-r.consumer_score for r in rows] == sorted(-r.consumer_score for r in rows)
    assert rows[0].best_unit_price == rows[0].unit_price and rows[0].gap_to_best == 0
    assert sum(r.n for r in out["retailers"].collect()) == 7 and [u.unit for u in out["units"].collect()] == ["kg"]
    word = rows[0].title.split()[0]
    assert all(word in r.title for r in served.offer_ranking(offers, q=word)["items"].collect())
    assert served.parse_limit("all") is None and served.parse_limit(1) == 5 and served.parse_limit("x") == 30


def test_ranking_order_and_defaults(spark):
    titles = ["Zebra", "Öl", "Obst", "obst", "äpfel", "Apfel", "Äpfel", "apfel"]
    rows = [(i, t, "r", 2.0, "kg", True) for i, t in enumerate(titles)] + [(20, "Tee", "s", 1.0, "l", True), (21, "Tee alt", "s", 0.5, "l", False), (22, "Ohne Preis", "s", None, None, True)]
    df = spark.createDataFrame(rows, "offer_id long, title string, retailer_key string, unit_price double, unit string, is_active boolean").withColumn("status", F.when(F.col("is_active"), "active"))
    out = served.offer_ranking(df, limit=50)
    assert [(r.title, r["rank"], r.rank_in_unit) for r in out["items"].collect()] == [
        ("Tee", 1, 1), ("apfel", 2, 1), ("Apfel", 3, 2), ("äpfel", 4, 3), ("Äpfel", 5, 4), ("obst", 6, 5), ("Obst", 7, 6), ("Öl", 8, 7), ("Zebra", 9, 8), ("Ohne Preis", 10, 1)]
    assert [(r.unit, r.n) for r in out["groups"].collect()] == [("l", 1), ("kg", 8), ("unbekannt", 1)] and [(r.retailer_key, r.n, r.best_price) for r in out["retailers"].collect()] == [("r", 8, 2.0), ("s", 2, 1.0)]
    first = out["items"].first()
    assert (first.retailer_name, first.effective_discount_type, first.source_types, first.minimum_purchase_qty, first.gap_to_best) == ("s", "unknown", [], 1, 0.0)
    compared = df.withColumn("comparable_unit", F.when(F.col("title") == "Zebra", "l"))
    assert [r.title for r in served.offer_ranking(compared, unit="l")["items"].collect()] == ["Tee", "Zebra"]
    assert [u.unit for u in served.offer_ranking(compared, unit="l")["units"].collect()] == ["kg", "l"]
    twice = df.unionByName(df.withColumn("offer_id", F.col("offer_id") + 100))
    assert served.offer_ranking(twice, limit="all")["summary"].first().result_count == 10
    none = served.offer_ranking(df.filter("false"))
    assert none["items"].count() == 0 and none["summary"].first().result_count == 0 and none["groups"].count() == 0


def test_coverage_reads_the_offers_once(spark):
    import io
    from contextlib import redirect_stdout

    from offerlens.plans import catalog

    shown = io.StringIO()
    with redirect_stdout(shown):
        catalog._coverage(spark, SF).explain("simple")
    assert shown.getvalue().count("lineitem.parquet") == 1


def test_basket_comparison_quality_dashboard(offers):
    title = offers.filter("is_active and comparison_safe and not program_required").first().title
    basket = served.basket_suggestions(offers, f"{title}, nothing like this")
    assert {r.item for r in basket["matches"].collect()} == {title}
    assert basket["mix"].first().n == 1
    exact = served.comparisons(offers)["exact"].collect()
    assert exact and all(r.retailer_count >= 2 and r.best_price <= r.worst_price for r in exact)
    quality = served.quality_snapshot(offers, q=title[:4].upper(), limit=5)
    assert quality["offers"].count() <= 5 and quality["subcategories"].first().samples
    k = served.dashboard_snapshot(offers, view.as_of())["kpis"].first()
    assert k.offers == 6000 and k.active_by_status == k.active_by_date == 1608
    assert served.filter_retailers(offers, view.as_of()).count() == 10 and served.filter_categories(offers).count() == 6


def test_audit(spark):
    reasons = spark.createDataFrame([(" a ", 2), ("a", 1), ("b", 0), ("", 5)], "reason string, count long")
    assert [(r.reason, r["count"]) for r in audit.rejection_reasons(reasons).collect()] == [("a", 3)]
    jobs = spark.createDataFrame([(1, "r", "success", 1, "old"), (2, "r", "success", 2, "new"), (3, "s", "failed", 3, "no")], "job_id long, retailer_key string, status string, started_at long, essence string")
    assert audit.latest_essences(jobs).first().digest == "new"
    raw = spark.createDataFrame([("a",), ("a",), ("b",)], "source_id string")
    stored = spark.createDataFrame([("a", True)], "source_id string, needs_review boolean")
    assert sorted((r.source_id, r.raw_count, r.stored_count, r.rejected_count, r.status) for r in audit.job_summary(raw, stored).collect()) == [("a", 2, 1, 1, "success"), ("b", 1, 0, 1, "partial")]


def test_registry(spark):
    all_ = registry.sources(spark)
    assert all_.count() == 30 and all_.select("source_id").distinct().count() == 30
    stored = all_.limit(2).withColumn("label", F.lit("old")).unionByName(spark.createDataFrame([("gone", "x", "X", "aggregator", "l", "u", True)], registry.SCHEMA))
    out = registry.upserted(stored, all_)
    assert out.count() == 31 and not out.filter("source_id = 'gone'").first().active and out.filter("label = 'old'").count() == 0
    order = registry.crawl_order(all_, spark.createDataFrame([("spar",)] * 3, "retailer_key string")).collect()
    assert order[0].retailer_key == "lidl" and order[-1].retailer_key == "spar"
    connector = registry.connector_of(F.col("retailer_key"), F.col("channel"), F.col("url"))
    got = {}
    for r in all_.select("label", connector.alias("c")).collect():
        got.setdefault(r.c, set()).add(r.label)
    assert {k: len(v) for k, v in got.items()} == {"aktionsfinder": 9, "marktguru": 9, "wogibtswas": 1, "hofer": 1, "search": 2, "penny": 2, "official": 1, "bipa": 1, "evidence": 4}
    assert got["search"] == {"BILLA Aktionen", "BILLA PLUS Aktionen"} and got["penny"] == {"PENNY Flugblaetter", "PENNY Angebote"} and got["official"] == {"Lidl Flugblatt"} and got["bipa"] == {"BIPA Aktionen"}
    assert got["hofer"] == {"HOFER aktuelle Flugblaetter und Broschueren"} and got["evidence"] == {"SPAR Aktionen", "BILLA Flugblatt", "BILLA PLUS Flugblatt", "dm Startseite"}
    landed = all_.select("source_id", F.lit("x").alias("html"))
    parts = registry.dispatched(landed, all_)
    assert {k: v.count() for k, v in parts.items()} == {k: len(v) for k, v in got.items()}


def test_addresses(spark):
    base = "https://h.at/a/b/page.html?q=1#top"
    wanted = {"https://x.at/y": "https://x.at/y", "//x.at/y": "https://x.at/y", "/z": "https://h.at/z", "x.html": "https://h.at/a/b/x.html", "../x": "https://h.at/a/x", "./x?y=../z": "https://h.at/a/b/x?y=../z", "../../../x": "https://h.at/x",
              "?p=2": "https://h.at/a/b/page.html?p=2", "#end": "https://h.at/a/b/page.html?q=1#end", "mailto:a@b": "mailto:a@b", "..": "https://h.at/a/", "": base}
    df = spark.createDataFrame([(h, base) for h in wanted], "href string, base string")
    assert {r.href: r.link for r in df.select("href", pages.absolute(F.col("href"), F.col("base")).alias("link")).collect()} == wanted
    assert df.limit(1).select(pages.absolute(F.lit("x"), F.lit("https://h.at")).alias("link")).first().link == "https://h.at/x"


def test_ingest_end_to_end(spark, tmp_path):
    from offerlens.plans import ingest as etl

    cards = [("s1", "penny", "PENNY", "official-site", {"title": "Frische Milch 1 l", "price": "1,49", "old_price": "1,99", "link": "https://p.at/1"}), ("s2", "penny", "PENNY", "aggregator", {"title": "Frische Milch 1 l", "price": "1,49", "old_price": "1,99", "link": "https://m.at/1"}),
             ("s1", "penny", "PENNY", "official-site", {"title": "Brot", "price": "", "link": "u"}), ("s1", "penny", "PENNY", "official-site", {"title": "Zeitung", "price": "2", "link": "u"})]
    landed = spark.createDataFrame(cards, "source_id string, retailer_key string, retailer_name string, channel string, fields map<string,string>")
    hits = spark.sql("select 's3' source_id, 'dm' retailer_key, 'dm' retailer_name, 'official-site' channel, 'https://dm.at' source_url, named_struct('name', 'Seife', 'packageLabel', '2 Stk', 'volumeLabelShort', '', 'descriptionShort', '', 'descriptionLong', '', 'brand', named_struct('name', 'B'), 'category', '', 'price', named_struct('regular', named_struct('value', 250, 'tags', array('x')), 'crossed', 300, 'discountPercentage', 0.0D)) hit")
    rules = spark.createDataFrame([(1, "ignore", "", "zeitung", None, None, None, None), (2, "article", "", "seife", None, "Drogerie", "Seifen", None), (3, "article", "", "b seife", None, "Drogerie", "Seifen", None)], overrides.RULE_SCHEMA)
    etl.run({"cards": landed, "search": hits}, rules, f"{tmp_path}/v", as_of())
    rows = {r.title: r for r in store.current(spark, f"{tmp_path}/v", "offers").collect()}
    assert set(rows) == {"Frische Milch 1 l", "Seife"}
    milk = rows["Frische Milch 1 l"]
    assert (milk.n_merged, milk.source_id, milk.price, milk.promotion_savings.amount, milk.unit_price.amount) == (2, "s1", 1.49, 0.5, 1.49)
    assert [e.source_id for e in milk.evidence] == ["s1", "s2"]
    assert (rows["Seife"].category_secondary, rows["Seife"].price, rows["Seife"].unit_price.amount) == ("Seifen", 2.5, 1.25) and "seifen" in rows["Seife"].search_text
    assert {r.retailer_key: r.active_count for r in store.current(spark, f"{tmp_path}/v", "coverage").collect()} == {"penny": 1, "dm": 1}
    covered = {r.retailer_key: (r.source_count, r.channel_count) for r in store.current(spark, f"{tmp_path}/v", "coverage").collect()}
    assert covered == {"penny": (2, 2), "dm": (1, 1)}  # the merged milk's evidence has a second source and channel
    assert store.current(spark, f"{tmp_path}/v", "main_categories").count() == 2
    ranked = served.offer_ranking(served.flat(store.current(spark, f"{tmp_path}/v", "offers")), limit="all")
    first = ranked["items"].first()
    assert ranked["items"].columns == list(ranking.SHOWN) and (first.title, first.unit_price, first.rank, first.validity_label) == ("Frische Milch 1 l", 1.49, None, "aktuell verfuegbar, Enddatum nicht erkannt")  # the soap has conditions
    assert {(r.title, r.savings_amount) for r in ranked["items"].collect()} == {("Seife", 0.5), ("Frische Milch 1 l", 0.5)}
    assert ranked["summary"].first().asDict() == {"result_count": 2, "displayed_count": 2, "requested_display": "all", "complete_result_set_visible": True, "best_unit_price": 1.49, "worst_unit_price": 1.25, "spread_percent": -16.11}


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, v int")
    path = f"{tmp_path}/t"
    store.replace_partitions(df, path)
    store.replace_partitions(spark.createDataFrame([("b", 3), ("b", 4)], "source_id string, v int"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 3, 4]
    first = store.publish({"x": df}, f"{tmp_path}/v")
    second = store.publish({"x": df.filter("v = 1")}, f"{tmp_path}/v")
    assert first != second and store.current(spark, f"{tmp_path}/v", "x").count() == 1
    merged = store.upsert(df, spark.createDataFrame([("b", 9), ("c", 5)], "source_id string, v int"), ["source_id"])
    assert sorted((r.source_id, r.v) for r in merged.collect()) == [("a", 1), ("b", 9), ("c", 5)]
    rows = store.landing_rows(spark.read.parquet(f"{SF}/pages.parquet"), as_of())
    assert rows.filter("length(title) > 180 or length(snippet) > 220").count() == 0
    assert store.retained(rows, as_of() + F.expr("interval 15 days")).count() == 0 and store.retained(rows, as_of()).count() == rows.count()
    assert store.compacted({"a": "x" * 300, "b": [1] * 9, "c": {"d": {"e": {"f": 1}}}}) == {"a": "x" * 240, "b": [1] * 5, "c": {"d": {}}}


def test_pages(spark):
    html = '<a href="/x">x</a><script>{"data":{"offers":{"results":[1]}}}</script> initial={"a":{"b":"}"}} initial={broken'
    df = spark.createDataFrame([(1, "https://h.at/p", html + '<a class="k" href="/flugblatt.pdf">x</a><a class="k" href="/flugblatt.pdf">x</a>'), (2, "u", None)], "page_id long, url string, html string")
    assert [r.json for r in pages.marked_json(df, "initial=").collect()] == ['{"a": {"b": "}"}}']
    assert [(r.link, r.type) for r in pages.links(df, only_relevant=True).collect()] == [("https://h.at/flugblatt.pdf", "pdf")]
    assert df.select(pages.embedded_payload(F.col("html")).alias("p")).first().p == '{"data":{"offers":{"results":[1]}}}'
    a, b = (spark.createDataFrame(r, "source_id string, v int") for r in ([("s", 1)], [("s", 2), ("t", 3)]))
    assert sorted(r.v for r in pages.first_non_empty([a, b]).collect()) == [1, 3]


def test_streaming_ingest(spark, tmp_path):
    rows = spark.createDataFrame([promotion_row(), promotion_row(source_id="s2", title="Brot")], normalize.PROMOTION)
    rows.write.parquet(f"{tmp_path}/landed")
    landed = ingest.read_landed(spark, f"{tmp_path}/landed", rows.schema)
    to_offers = lambda df: normalize.offers(df, as_of()).select("source_id", "title", "price")
    for _ in range(2):
        q = ingest.start(landed, to_offers, f"{tmp_path}/offers", f"{tmp_path}/state")
        assert q.awaitTermination(120)
    assert sorted(r.title for r in spark.read.parquet(f"{tmp_path}/offers").collect()) == ["Brot", "Frische Milch"]


def test_event_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    q = ingest.event_counts(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName("event_counts").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.sql("select sum(n) as n from event_counts").first().n == events.count()
