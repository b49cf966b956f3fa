"""Bounded training samples: the only rows that a classifier's fit brings to the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fitting(sizes: list[int], y: list[int], max_bytes: int) -> np.ndarray:
    """Which texts fit, in the given order: each label fills its half of the bytes, then all the bytes left; a text that doesn't fit is skipped."""
    taken, half = np.zeros(len(sizes), bool), [max_bytes // 2] * 2
    for i, (b, k) in enumerate(zip(sizes, y)):
        if b <= half[k]:
            taken[i] = True
            half[k] -= b
    left = max_bytes - sum(b for b, t in zip(sizes, taken) if t)
    for i, b in enumerate(sizes):
        if not taken[i] and b <= left:
            taken[i] = True
            left -= b
    return taken


def _labelled(labels: DataFrame, label: str, keep: Column | None) -> DataFrame:
    want = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    return (want if keep is None else want.filter(keep)).groupBy("doc_id").agg(F.max("y").alias("y"))


def shares(labels: DataFrame, label: str, keep: Column | None = None) -> tuple[int, int]:
    """How many documents have label 0 and 1."""
    n = _labelled(labels, label, keep).agg(F.count_if(F.col("y") == 0).alias("no"), F.count_if(F.col("y") == 1).alias("yes")).first()
    return n["no"], n["yes"]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, keep: Column | None = None, max_bytes: int = 48 << 20, least: int = 1) -> pd.DataFrame:
    """(doc_id, text, y) of at most per_class rows of each label 0 and 1, those with the smallest hash of the id.

    Both bounds are parameters: per_class bounds the rows, max_bytes the whole texts; texts that don't fit (see
    fitting) are left out of the fit (never cut), and the next ones follow. Of rows that share an id the least text counts. ValueError if that leaves fewer than least
    texts of a label that has as many. Null ids, labels and texts don't take part. Repeated label rows count once.
    """
    want = _labelled(labels, label, keep).withColumn("h", F.xxhash64("doc_id"))
    chosen = None
    for y in (0, 1):
        part = want.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.select("doc_id", "y", "h").toPandas()
    if ids.empty:
        return pd.DataFrame({"doc_id": [], "text": [], "y": []})
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(ids[["doc_id", "y"]]))  # at most 2 * per_class rows
    text = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sized = text.select("doc_id", "y", F.octet_length("text").alias("b")).toPandas()
    sized = sized.merge(ids[["doc_id", "h"]], on="doc_id").sort_values(["h", "doc_id"])
    if sized.empty:
        return pd.DataFrame({"doc_id": [], "text": [], "y": []})
    taken = fitting(sized.b.tolist(), sized.y.tolist(), max_bytes)
    for y in (0, 1):
        of = (sized.y == y).to_numpy()
        if of.sum() >= least > (of & taken).sum():
            raise ValueError(f"{label} {y}: only {(of & taken).sum()} of {of.sum()} labelled texts fit in {max_bytes} bytes, {least} are needed; raise max_bytes")
    sized = sized[taken]
    few = F.broadcast(spark.createDataFrame(sized[["doc_id"]]))
    return text.join(few, "doc_id").toPandas().sort_values("doc_id").reset_index(drop=True)
