"""A table of parts under versions: a change writes the parts it touches, readers see all of it or nothing.

Rows are dealt to `parts` parts by a hash of one column. Each version has a state file, which names for every part
the version whose files hold it; untouched parts keep theirs. State files are numbered and created only where none
is, so of two writers that start from one version the second fails and has to begin again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "__part"


class State(NamedTuple):
    """parts: for each part with rows, the version that holds it."""

    number: int
    version: str
    by: str
    n_parts: int
    parts: dict[int, str]
    schema: str


class Conflict(RuntimeError):
    """Someone else has published since the state was read."""


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    at, fs = _files(spark, f"{root}/states")
    return [int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")] if fs.exists(at) else []


def state(spark: SparkSession, root: str, number: int | None = None) -> State | None:
    """The last state, or the one of this number; none where nothing has been written."""
    known = _numbers(spark, root)
    if not known:
        return None
    (row,) = spark.read.text(f"{root}/states/{max(known) if number is None else number:012d}.json", wholetext=True).collect()
    said = json.loads(row[0])
    return State(**(said | {"parts": {int(k): v for k, v in said["parts"].items()}}))


def _publish(spark: SparkSession, root: str, new: State) -> None:
    """A hidden draft first: the numbered file appears at once and whole, or not at all."""
    at, fs = _files(spark, f"{root}/states/{new.number:012d}.json")
    draft, _ = _files(spark, f"{root}/states/_{new.version}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(new._asdict()).encode()))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise Conflict(f"version {new.number} of {root} is there already")


def part_of(c: Column, n_parts: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n_parts)).cast("int")


def _written(df: DataFrame, root: str, by: str, n_parts: int) -> tuple[str, set[int]]:
    """Writes df's parts under a new version; the parts that have rows."""
    version = uuid.uuid4().hex
    path = f"{root}/versions/{version}"
    df.withColumn(PART, part_of(F.col(by), n_parts)).write.partitionBy(PART).parquet(path)
    at, fs = _files(df.sparkSession, path)
    return version, {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.isDirectory() and "=" in f.getPath().getName()}


def write(df: DataFrame, root: str, by: str, n_parts: int = 64) -> State:
    """The whole table as a new version."""
    spark, last = df.sparkSession, state(df.sparkSession, root)
    version, found = _written(df, root, by, n_parts)
    new = State(last.number + 1 if last else 1, version, by, n_parts, {p: version for p in found}, df.schema.json())
    _publish(spark, root, new)
    return new


def read(spark: SparkSession, root: str, parts: Iterable[int] | None = None, at: State | None = None) -> DataFrame:
    """The table, or these parts of it, as of the last or the given state."""
    s = at or state(spark, root)
    schema = StructType.fromJson(json.loads(s.schema))
    wanted = sorted(s.parts if parts is None else set(parts) & s.parts.keys())
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root}/versions/{s.parts[p]}/{PART}={p}" for p in wanted))


def rewrite(df: DataFrame, root: str, touched: Iterable[int], base: State) -> State:
    """A new version in which df holds all rows of the touched parts; the other parts stay as they are."""
    touched = set(touched)
    if not touched:
        return base
    version, found = _written(df, root, base.by, base.n_parts)
    if not found <= touched:
        raise ValueError("rows of parts that aren't touched")
    kept = {p: v for p, v in base.parts.items() if p not in touched}
    new = State(base.number + 1, version, base.by, base.n_parts, kept | {p: version for p in found}, base.schema)
    _publish(df.sparkSession, root, new)
    return new
