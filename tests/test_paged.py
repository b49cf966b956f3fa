import json
import os

from pyspark.sql import functions as F

from offerlens.sources import paged


def land(root, source, *bodies):
    for k, body in enumerate(bodies):
        folder = f"{root}/source_id={source}/page={k}"
        os.makedirs(folder)
        open(f"{folder}/part-0.txt", "w").write(body if isinstance(body, str) else json.dumps(body))


def body(*entries, total=None, name="results"):
    return {name: list(entries)} | ({"totalResults": total} if total is not None else {})


def ids(df):
    return sorted((r.source_id, r.page, r.place, r.item) for r in df.collect())


def test_offset_sources_end_at_a_short_page(spark, tmp_path):
    root = f"{tmp_path}/l"
    land(root, "a", body(1, 2, total=5), body(3, 4, total=5), body(5, total=5))
    land(root, "b", body(1, 2, total=9), body(3, total=9), body(4, 5, total=9))  # short in between
    land(root, "c", body(1, 2, total=9), '{"results": [', body(4, 5, total=9))  # broken
    land(root, "d", body(1, 2, total=2), body(3, 4, total=2))  # beyond the total
    land(root, "e", body(1, 2, total=9), body(total=9), body(4, 5, total=9))  # empty
    land(root, "f", {"results": "none", "totalResults": 4}, body(1, 2))
    land(root, "x%2Fy", body("é", total=1))
    got = ids(paged.offset_items(spark, root, 2))
    want = [("a", 0, 0, "1"), ("a", 0, 1, "2"), ("a", 1, 0, "3"), ("a", 1, 1, "4"), ("a", 2, 0, "5"), ("b", 0, 0, "1"), ("b", 0, 1, "2"), ("b", 1, 0, "3"), ("c", 0, 0, "1"), ("c", 0, 1, "2"), ("d", 0, 0, "1"), ("d", 0, 1, "2"), ("e", 0, 0, "1"), ("e", 0, 1, "2"), ("x/y", 0, 0, '"é"')]
    assert got == want
    assert paged.pages(spark, root, limit=2).rdd.getNumPartitions() == 16  # a page each


def test_numbered_sources_end_at_the_greatest_page(spark, tmp_path):
    root = f"{tmp_path}/l"
    land(root, "a", *(body(2 * k, 2 * k + 1, name="hits") for k in range(5)))
    land(root, "b", body(1, name="hits"), body(2, 3, name="hits"))
    assert ids(paged.numbered_items(spark, root, 2, 3)) == [("a", k // 2, k % 2, str(k)) for k in range(6)] + [("b", 0, 0, "1")]


def test_filters_choose_pages(spark, tmp_path):
    root = f"{tmp_path}/l"
    land(root, "a", body(1, 2, total=6), body(3, 4, total=6), body(5, 6, total=6))
    land(root, "b", body(1, total=1))
    every = paged.pages(spark, root, limit=2)
    spark.conf.set(paged.PUSHDOWN, "true")
    try:
        df = paged.pages(spark, root, limit=2)
        chosen = df.filter("source_id = 'a' and page >= 1 and page <= 1 and n = 2")
        assert ids(chosen) == ids(every.filter("source_id = 'a' and page = 1")) and chosen.rdd.getNumPartitions() == 1
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        assert "BatchScan paged_json" in plan and "(source_id#" not in plan and "(page#" not in plan and "(n#" in plan  # Spark filters by n alone
        assert df.filter("source_id in ('b', 'z')").rdd.getNumPartitions() == 1 and df.filter("source_id = 'z'").count() == 0
    finally:
        spark.conf.unset(paged.PUSHDOWN)


def test_slugs(spark):
    df = spark.createDataFrame([("https://h.at/R/Hofer?x=1",), ("https://h.at/r/billa-plus/",), ("https://h.at/",)], "u string")
    assert [r.s for r in df.select(paged.retailer_slug(F.col("u")).alias("s")).collect()] == ["hofer", "billa-plus", None]


def test_api_config(spark):
    script = lambda x: f'<script type="application/json">{x}</script>'
    rows = [("a", script("{") + script('{"config":{"apiKey":"k"}}') + script('{"config":{"apiHostAddress":"h.at","apiKey":"k2"}}') + script('{"config":{"apiHostAddress":"later","apiKey":"x"}}')), ("b", '<script>{"config":{"apiHostAddress":"h","apiKey":"k"}}</script>'), ("c", None)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i string, html string").select("i", paged.api_config(F.col("html")).alias("c")).collect()}
    assert tuple(got["a"]) == ("h.at", "k2") and got["b"] is None and got["c"] is None
