"""Operator 7, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates and the L1 term leave few weights other than 0; these (indices and values) travel to
the tasks. A document's features are the set of its hashed 1-grams, 2-grams and 1-skip-2-grams, lower-cased,
with outer punctuation cut from each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import common, sampling

BITS = 20
SHIFT = np.uint64(64 - BITS)
SAMPLE_PER_CLASS = 3000
THRESHOLD = 0.5
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.0, 3
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@dataclass
class ToxicityModel:
    """score = sigmoid(bias + sum of values over the features of a text); index is ascending."""

    index: np.ndarray
    values: np.ndarray
    bias: float


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features with repeats, and the texts' numbers."""
    starts, ends, doc = common.words_of(data, at)
    outer = _PUNCTUATION[data] if len(data) else np.zeros(0, bool)
    for _ in range(3):  # up to three marks on either side
        starts = starts + ((ends - starts > 1) & outer[starts])
        ends = ends - ((ends - starts > 1) & outer[ends - 1])
    w = common.word_hashes(data, starts, ends)
    parts, docs = [w], [doc]
    for gap, seed in ((1, 0x2545F4914F6CDD1D), (2, 0xD6E8FEB86659FD93)):
        together = doc[:-gap] == doc[gap:]
        parts.append(common.mixed(w[:-gap] * np.uint64(common.BASE) + w[gap:] * np.uint64(seed))[together])
        docs.append(doc[:-gap][together])
    return (np.concatenate(parts) >> SHIFT).astype(np.int64), np.concatenate(docs)


def scores(model: ToxicityModel | None, table: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    if model is None:
        return np.zeros(n)
    idx, doc = features(data, at)
    hit = np.flatnonzero(table[idx])
    key = np.unique(doc[hit] << BITS | idx[hit])
    s = model.bias + np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)], minlength=n)
    return 1 / (1 + np.exp(-np.clip(s, -35, 35)))


def dense(model: ToxicityModel | None) -> np.ndarray:
    table = np.zeros(1 << BITS, np.float32)
    if model is not None:
        table[model.index] = model.values
    return table


def fit_texts(texts: list[str], y: np.ndarray, epochs: int = EPOCHS) -> ToxicityModel | None:
    """FTRL-proximal, one text at a time in an order fixed by a seed. None without both labels."""
    y = np.asarray(y, float)
    if len(set(y.tolist())) < 2:
        return None
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        rows.append(np.unique(features(raw, np.array([0, len(raw)]))[0]))
    z, g2, zb, gb = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0

    def weights(zz, gg):
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(gg)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx = rows[i]
            w = weights(z[idx], g2[idx])
            b = -zb * ALPHA / (BETA + np.sqrt(gb))
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y[i]
            root = np.sqrt(g2[idx])
            z[idx] += g - (np.sqrt(g2[idx] + g * g) - root) / ALPHA * w
            g2[idx] += g * g
            sigma = (np.sqrt(gb + g * g) - np.sqrt(gb)) / ALPHA
            zb += g - sigma * b
            gb += g * g
    w = weights(z, g2)
    index = np.flatnonzero(w)
    return ToxicityModel(index.astype(np.int32), w[index].astype(np.float32), float(-zb * ALPHA / (BETA + np.sqrt(gb))))


def fit(docs: DataFrame, labels: DataFrame, keep=None, sample_per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel | None:
    """Fit on at most sample_per_class rows of either label that satisfy keep (see sampling.labelled_sample)."""
    rows = sampling.labelled_sample(docs, labels, "toxic", sample_per_class, keep)
    return fit_texts(rows.text.tolist(), rows.y.to_numpy()) if len(rows) else None


def toxicity(docs: DataFrame, model: ToxicityModel | None, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Score every whole text: the columns in keep, score (double) and predicted (int, 1 from threshold on).

    Null and empty texts have no features and score sigmoid(bias); without a model (no labels of both kinds)
    every score is 0. Repeated rows each get a score; an empty table gives none; other columns are left out.
    """
    common.bound_batches(docs.sparkSession)
    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = dense(model)
        for batch in batches:
            parts = [scores(model, lookup, data, at) for _, _, data, at in common.text_blocks(batch, "__text")]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, f"{head}, score double, predicted int")
