import json
from datetime import date

from pyspark.sql import functions as F

from offerlens.functions import sparse


def rewritten(spark, f, schema, *rows):
    df = spark.createDataFrame([(r,) for r in rows], f"v struct<{schema}>")
    return [None if r.j is None else json.loads(r.j) for r in df.select(F.to_json(f(F.col("v"), df.schema["v"].dataType)).alias("j")).collect()]


def test_without_empty(spark):
    schema = "s: string, b: boolean, n: int, d: double, l: array<int>, m: string"
    assert rewritten(spark, sparse.without_empty, schema, ("", False, 0, 0.0, [], None), ("x", True, None, 1.5, [1], " "), None) == [{"n": 0, "d": 0.0, "l": []}, {"s": "x", "b": True, "d": 1.5, "l": [1], "m": " "}, None]


def test_compacted(spark):
    schema = "t: string, d: date, tags: array<string>, n: array<int>, items: array<struct<a: string, b: array<int>>>, only: array<struct<b: array<int>>>, in: struct<a: string, n: int, x: struct<y: int>>, m: map<string,string>, mm: map<string,array<int>>"
    full = (" " + "x" * 300 + " ", date(2025, 5, 1), ["", " a ", None, "b" * 130, "c", "d", "e", "f"], [1], [("y" * 130, [1]), None, (None, None)], [([1],)], (" z ", 0, (1,)), {"k": "v" * 130}, {"k": [1]})
    got = rewritten(spark, sparse.compacted, schema, full, ("", None, [" "], [], [], None, (None, None, (1,)), {}, None), None)
    assert got == [{"t": "x" * 240, "d": "2025-05-01", "tags": ["a", "b" * 120, "c", "d", "e"], "items": [{"a": "y" * 120}, {}], "in": {"a": "z", "n": 0}, "m": {"k": "v" * 120}}, {"t": ""}, None]
    assert rewritten(spark, sparse.compacted, "n: array<int>", ([1],)) == [None]
