"""Results kept by what they were asked for: by canonical parameters and the version of the data, for a time.

An entry is a Parquet table under <root>/<version>/<name>-<hash>/<time>. Another version has other entries, so
publishing or changing the data makes all results anew; `forget` deletes those of versions that are gone.
"""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.sources import shared

TTL = timedelta(hours=12)
PLACE = "__place"


def canonical(params: dict) -> str:
    """The same text for the same question: strings trimmed and in lower case, lists (or texts with commas) without order,
    blanks and repeats, booleans in any spelling, keys sorted."""

    def plain(v):
        if isinstance(v, str):
            s = v.strip().lower()
            return s == "true" if s in ("true", "false") else plain(s.split(",")) if "," in s else s
        if isinstance(v, (list, tuple, set)):
            return sorted({x for x in (plain(str(x)) for x in v) if x != ""}, key=str)
        return v

    return json.dumps({k: plain(v) for k, v in params.items()}, sort_keys=True, ensure_ascii=False, default=str)


class Memo:
    def __init__(self, spark: SparkSession, root: str, ttl: timedelta = TTL):
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, fs = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _entry(self, version: str, name: str, params: dict) -> str:
        return f"{self.root}/{version}/{name}-{hashlib.sha256(canonical(params).encode()).hexdigest()}"

    def get(self, version: str, name: str, params: dict, now: datetime) -> DataFrame | None:
        """The youngest whole entry that isn't too old at `now`, in its first order."""
        entry = self._entry(version, name, params)
        made = sorted((n for n in self._names(entry) if not n.startswith("_") and "_SUCCESS" in self._names(f"{entry}/{n}")), reverse=True)
        if not made or now - datetime.strptime(made[0][:20], "%Y%m%d%H%M%S%f") > self.ttl:
            return None
        return self.spark.read.parquet(f"{entry}/{made[0]}").orderBy(PLACE).drop(PLACE)

    def remember(self, version: str, name: str, params: dict, make: Callable[[], DataFrame], now: datetime) -> DataFrame:
        """The kept result, or make()'s, which is then kept. Results keep their order."""
        known = self.get(version, name, params, now)
        if known is not None:
            return known
        path = f"{self._entry(version, name, params)}/{now:%Y%m%d%H%M%S%f}-{uuid.uuid4().hex}"
        make().withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(path)
        return self.spark.read.parquet(path).orderBy(PLACE).drop(PLACE)

    def forget(self, current: str | None = None) -> int:
        """Delete all entries but the current version's; how many versions went."""
        gone = [n for n in self._names(self.root) if n != current]
        for n in gone:
            at, fs = self._fs(f"{self.root}/{n}")
            fs.delete(at, True)
        return len(gone)


def within(df: DataFrame, seconds: float, path: str | None = None) -> tuple[DataFrame, bool]:
    """df's rows and True, or, where they take longer than so many seconds, none of the same columns and False.

    The rows are written to a shared folder. When time is up, the jobs of this query, and no others, are cancelled and
    its files deleted. A failure within the time is raised.
    """
    spark = df.sparkSession
    sc, tag, path = spark.sparkContext, f"within-{uuid.uuid4().hex}", path or shared.new_path(spark, "within")
    failed: list[BaseException] = []
    late = threading.Event()

    def run() -> None:
        sc.addJobTag(tag)
        try:
            df.write.parquet(path)
        except Exception as e:
            failed.append(e)
        finally:
            sc.removeJobTag(tag)

    worker = InheritableThread(target=run)
    worker.start()
    worker.join(seconds)
    while worker.is_alive():  # a job that was still being planned starts later
        late.set()
        sc.cancelJobsWithTag(tag)
        worker.join(0.1)
    if late.is_set():
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        return spark.createDataFrame([], df.schema), False
    if failed:
        raise failed[0]
    return spark.read.schema(df.schema).parquet(path), True
