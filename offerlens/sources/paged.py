"""Paged JSON sources as landed: pages spread over partitions, conditions on source and page pushed down, a stop rule.

A landing folder holds source_id=<id>/page=<k>/ with one response body each, as df.write.partitionBy("source_id",
"page").text() leaves them. A source by offset tells its total on its first page, and pages beyond it aren't read; a
numbered one is read to a greatest page. Like a client that asks page by page, `items` ends at the first page that
has fewer entries than a full one; broken and empty pages have none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThanOrEqual

SCHEMA = "source_id string, page int, place int, n int, total long, item string"
#: Partitions at most: up to so many pages each has its own, then they share alike, as a page costs less than a task.
TASKS = 192
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    where = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)


class SomePages(InputPartition):
    """Pages (source_id, page, folder) that one task reads, one after the other."""

    def __init__(self, pages: list[tuple[str, int, str]]):
        super().__init__(len(pages))
        self.pages = pages


class PagedReader(DataSourceReader):
    def __init__(self, path: str, entries: str, limit: int, most: int | None):
        self.path, self.entries, self.limit, self.most = path, entries, limit, most
        self.sources: set[str] | None = None
        self.first, self.last = 0, None

    def _entries(self, where: fs.FileSystem, folder: str) -> tuple[list, int | None]:
        """A page's entries, and the total it tells; none for a broken one."""
        body = b""
        for f in where.get_file_info(fs.FileSelector(folder)):
            if f.is_file and not f.base_name.startswith((".", "_")):
                with where.open_input_stream(f.path, compression=None) as source:
                    body += source.read()
        try:
            said = json.loads(body)
        except ValueError:
            return [], None
        found = said.get(self.entries) if isinstance(said, dict) else None
        total = said.get("totalResults") if isinstance(said, dict) else None
        found = found if isinstance(found, list) else []
        return found, total if isinstance(total, int) else len(found)

    def partitions(self) -> list[SomePages]:
        where, folder = _folder(self.path)
        out = []
        for source in sorted((f for f in where.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("source_id=")), key=lambda f: f.base_name):
            source_id = unquote(source.base_name[len("source_id=") :])
            if self.sources is not None and source_id not in self.sources:
                continue
            known = {int(f.base_name[5:]): f.path for f in where.get_file_info(fs.FileSelector(source.path)) if re.fullmatch(r"page=\d+", f.base_name)}
            end = self.most
            if end is None and 0 in known:
                total = self._entries(where, known[0])[1]
                end = -(-total // self.limit) if total is not None else 1
            out += [(source_id, k, known[k]) for k in sorted(known) if k >= self.first and (end is None or k < end) and (self.last is None or k <= self.last)]
        each = max(1, -(-len(out) // TASKS))
        return [SomePages(out[i : i + each]) for i in range(0, len(out), each)] or [SomePages([])]

    def read(self, partition: SomePages) -> Iterator[pa.RecordBatch]:
        where = _folder(self.path)[0]
        for source_id, page, folder in partition.pages:
            found, total = self._entries(where, folder)
            rows = max(1, len(found))  # a page without entries is a row too, for the stop rule
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([source_id] * rows), pa.array([page] * rows, pa.int32()), pa.array(range(rows) if found else [None], pa.int32()), pa.array([len(found)] * rows, pa.int32()), pa.array([total] * rows, pa.int64()),
                    pa.array([json.dumps(x, ensure_ascii=False) for x in found] or [None], pa.string()),
                ],
                names=["source_id", "page", "place", "n", "total", "item"],
            )


class ChoosingPagedReader(PagedReader):
    """For sessions that push filters into Python's data sources."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            of = getattr(f, "attribute", None)
            if of == ("source_id",) and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sources = wanted if self.sources is None else self.sources & wanted
            elif of == ("page",) and isinstance(f, LessThanOrEqual):
                self.last = f.value if self.last is None else min(self.last, f.value)
            elif of == ("page",) and isinstance(f, GreaterThanOrEqual):
                self.first = max(self.first, f.value)
            elif not (of in (("source_id",), ("page",)) and isinstance(f, IsNotNull)):
                yield f


class PagedJson(DataSource):
    """Options: path, entries (the list's name), limit (of a full page), most (pages of a numbered source), choosing."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        o = self.options
        kind = ChoosingPagedReader if o.get("choosing") == "true" else PagedReader
        return kind(o["path"], o.get("entries", "results"), int(o.get("limit", "100")), int(o["most"]) if o.get("most") else None)


def pages(spark: SparkSession, path: str, entries: str = "results", limit: int = 100, most: int | None = None) -> DataFrame:
    """SCHEMA: the entries of all pages there are, as JSON; without `most` up to the total that a first page tells."""
    spark.dataSource.register(PagedJson)
    reader = spark.read.format("paged_json").option("entries", entries).option("limit", limit).option("choosing", spark.conf.get(PUSHDOWN, "false").lower())
    return (reader.option("most", most) if most is not None else reader).load(path)


def until_short(found: DataFrame, limit: int) -> DataFrame:
    """Entries of each source's pages up to and with its first short one; what a source was asked for after it doesn't count."""
    ends = found.filter(F.col("n") < limit).groupBy("source_id").agg(F.min("page").alias("__end"))
    return found.join(ends, "source_id", "left").filter((F.col("page") <= F.coalesce("__end", "page")) & F.col("item").isNotNull()).drop("__end", "n", "total")


def offset_items(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """An offset source's entries (results), 100 to a page."""
    return until_short(pages(spark, path, "results", limit), limit)


def numbered_items(spark: SparkSession, path: str, limit: int = 500, most: int = 3) -> DataFrame:
    """A page-numbered search index's entries (hits), 3 pages of 500 at most, as the source is asked."""
    return until_short(pages(spark, path, "hits", limit, most), limit)


def retailer_slug(url: Column) -> Column:
    """What an aggregator calls the retailer: /r/<slug>."""
    return F.nullif(F.lower(F.regexp_extract(url, "(?i)/r/([^/?#]+)", 1)), F.lit(""))


def api_config(html: Column) -> Column:
    """struct(host, key) of the first of a page's JSON scripts that has both in its config; null without one."""
    bodies = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    said = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.config.apiHostAddress").alias("host"), F.get_json_object(b, "$.config.apiKey").alias("key")))
    return F.get(F.filter(said, lambda c: (F.coalesce(c["host"], F.lit("")) != "") & (F.coalesce(c["key"], F.lit("")) != "")), F.lit(0))
