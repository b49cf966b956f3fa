"""Operator 2, language identification by rank-order profiles.

A profile is the list of the most frequent letter 1-, 2- and 3-grams (words are bounded by a blank), by falling
count, ties by the gram. A text's distance to a language is the sum over the text's profile of how far each
gram is out of place in the language's profile, or the profile's length where it is missing there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.llm import common

PROFILE = 300
SAMPLE_PER_LANGUAGE = 400
UNKNOWN = "und"
#: Stands for the blank; no letter, and not 0, so that grams of different lengths differ.
BLANK = 1
_letters: np.ndarray | None = None


@dataclass
class LanguageModel:
    """grams ascending; ranks[g, l] is the gram's place in language l's profile, or size where it has none."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int


def letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> np.ndarray:
    """All 1-, 2- and 3-grams as integers of 21 bits a letter; blanks (BLANK) only at a gram's ends. Empty without a letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letter_table()[cp] if len(cp) else np.zeros(0, bool)
    if not letter.any():
        return cp[:0]
    cp = np.where(letter, cp, BLANK)
    keep = np.ones(len(cp), bool)
    keep[1:] = letter[1:] | letter[:-1]
    cp = cp[keep]
    cp = np.concatenate([[BLANK] if cp[0] != BLANK else [], cp, [BLANK] if cp[-1] != BLANK else []]).astype(np.int64)
    a, b, c = cp[:-2], cp[1:-1], cp[2:]
    return np.concatenate([cp[cp != BLANK], cp[:-1] << 21 | cp[1:], (a << 42 | b << 21 | c)[b != BLANK]])


def profile(text: str, size: int) -> np.ndarray:
    g = np.sort(grams(text))
    if not len(g):
        return g
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    count = np.diff(np.append(first, len(g)))
    if len(count) > size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        first, count = first[count >= least], count[count >= least]
    return g[first[np.argsort(-count, kind="stable")[:size]]]


def judge(model: LanguageModel, text: str | None) -> tuple[str, float]:
    top = profile(text, model.size) if text else np.zeros(0, np.int64)
    if not len(top) or not model.languages:
        return UNKNOWN, 0.0
    at = np.minimum(np.searchsorted(model.grams, top), len(model.grams) - 1)
    known = model.grams[at] == top
    out = np.abs(model.ranks[at] - np.arange(len(top))[:, None])
    out[~known] = model.size
    out[known] = np.where(model.ranks[at[known]] == model.size, model.size, out[known])
    distance = out.sum(0)
    best = int(distance.argmin())
    return model.languages[best], float(1 - distance[best] / (model.size * len(top)))


def fit(docs: DataFrame, keep: Column | None = None, sample_per_language: int = SAMPLE_PER_LANGUAGE, size: int = PROFILE) -> LanguageModel:
    """Profiles from at most sample_per_language texts of each language, those with the smallest hash of the id.

    Rows with a null id, text or lang don't take part, nor do those for which keep is false. Counting runs on the
    executors; the driver gets `size` grams of each language.
    """
    common.bound_batches(docs.sparkSession)
    rows = docs.filter("doc_id is not null and lang is not null and text is not null")
    if keep is not None:
        rows = rows.filter(keep)
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod(F.col("h"), F.lit(64)))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "doc_id"))).filter(F.col("n") <= sample_per_language)
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("n") <= sample_per_language)
    chosen = [r["doc_id"] for r in ids.select("doc_id").distinct().collect()]  # sample_per_language for each language
    if not chosen:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 0), np.int64), size)
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(x,) for x in chosen], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"))
    sample = rows.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(few, "doc_id").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                of.setdefault(lang, []).append(grams(text))
            for lang, parts in of.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    placed = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1).filter(F.col("rank") < size)
    rows = placed.select("lang", "gram", "rank").collect()  # size for each language
    languages = sorted({r["lang"] for r in rows})
    table = np.array(sorted({r["gram"] for r in rows}), np.int64)
    ranks = np.full((len(table), len(languages)), size, np.int64)
    for r in rows:
        ranks[np.searchsorted(table, r["gram"]), languages.index(r["lang"])] = r["rank"]
    return LanguageModel(languages, table, ranks, size)


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, lang_pred and score (1: every gram in place, 0: all missing).

    Null texts, texts without a letter and all texts under an empty model are `und` with score 0. Equal distances go
    to the language that sorts first. Repeated rows are each judged; an empty table gives none.
    """
    common.bound_batches(docs.sparkSession)
    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [judge(model, t.as_py()) for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, f"{head}, lang_pred string, score double")
