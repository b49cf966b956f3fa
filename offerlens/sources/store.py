"""Storage: partition-wise replacement, versioned tables swapped as a whole, upserts, retention and landing rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.functions import text


def replace_partitions(df: DataFrame, path: str, by: str = "source_id") -> None:
    """Replace just the partitions that df has rows for, in one commit."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(by).mode("overwrite").parquet(path)


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables under a new version and then point to it: readers see all of the old or all of the new."""
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    # a rising number says which one is the last, whatever the files' times
    spark.createDataFrame([(_last(spark, root)["n"] + 1, version)], "n long, version string").coalesce(1).write.mode("append").json(f"{root}/pointer")
    return version


def _last(spark: SparkSession, root: str) -> dict:
    """The pointer with the greatest number; number 0 without a version where nothing was published yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {"n": 0, "version": None}
    return spark.read.schema("n long, version string").json(f"{root}/pointer").orderBy(F.desc("n"), F.desc("version")).first().asDict()


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version published last."""
    return spark.read.parquet(f"{root}/versions/{_last(spark, root)['version']}/{name}")


def upsert(stored: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of stored with those of changes put over them by key; columns that changes lacks keep their values."""
    new = changes.select([F.col(c).alias(f"n_{c}") for c in changes.columns]).withColumn("__new", F.lit(True))
    on = [stored[k].eqNullSafe(new[f"n_{k}"]) for k in key]
    both = stored.withColumn("__old", F.lit(True)).join(new, on, "full_outer")
    return both.select(*[(F.when(F.col("__new"), F.col(f"n_{c}")).otherwise(F.col(c)) if c in changes.columns else F.col(c)).alias(c) for c in stored.columns])


def appended_sources(stored: Column, fresh: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(stored, F.array().cast("array<string>")), F.coalesce(fresh, F.array().cast("array<string>"))))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def retained(df: DataFrame, as_of: Column, days: int = 14, at: str = "fetched_at") -> DataFrame:
    return df.filter(F.col(at) > as_of - F.make_interval(days=F.lit(days)))


def landing_rows(pages: DataFrame, as_of: Column) -> DataFrame:
    """Compact raw documents: title to 180 and snippet to 220 characters, the whole page by hash."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    bare = text.squeezed(F.regexp_replace("html", "<[^>]+>", " "))
    return pages.select("page_id", "url", text.shortened(title, 180).alias("title"), text.shortened(bare, 220).alias("snippet"), text.digest(F.col("html")).alias("content_hash"), F.octet_length("html").alias("n_bytes"), as_of.alias("fetched_at"))


def preview(values: Column, limit: int = 5, length: int = 80) -> Column:
    """The first few non-empty values, shortened."""
    return F.slice(F.filter(F.transform(values, lambda v: text.shortened(v, length)), lambda v: v != ""), 1, limit)


def compacted(value, depth: int = 0):
    """A payload with long strings cut (240, nested 120), lists to 5 entries and what lies deeper than 3 left out."""
    if isinstance(value, str):
        return value[: 240 if depth <= 1 else 120]
    if isinstance(value, (list, dict)) and depth >= 3:
        return None
    if isinstance(value, list):
        return [x for x in (compacted(v, depth + 1) for v in value[:5]) if x is not None]
    if isinstance(value, dict):
        return {k: x for k, v in value.items() if (x := compacted(v, depth + 1)) is not None}
    return value


def as_documents(df: DataFrame) -> DataFrame:
    """Each row as a JSON document, without null fields."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("document"))
