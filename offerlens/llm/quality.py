"""Operator 5, quality rules: text statistics with fixed limits, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word 1- and 2-grams and character 3- and 5-grams (each
family's relative frequencies), fitted on a bounded labelled sample and calibrated on the part of it
that the fit didn't see, weighed to the shares that the labels have among all labelled rows. Texts are
scored whole, in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import common, sampling

BITS = 16
FAMILIES = 4
SCALE = 40.0
SEEDS = [np.uint64(x | 1) for x in (0x8F3A1C5D9E2B4710, 0x51ED270B7C14F9A2, 0xC2B2AE3D27D4EB4E, 0x165667B19E3779F8)]
SHIFT = np.uint64(64 - BITS)
SAMPLE_PER_CLASS = 1500
LEAST_PER_CLASS = 5
#: Documents whose calibrated probability of being good lies under this are rejected.
MIN_GOOD = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass
class QualityModel:
    """weights has FAMILIES rows of 2**BITS; good = sigmoid(slope * score + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def features(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: hashed n-grams of all texts of a block, and the texts' numbers."""
    n = len(at) - 1
    starts, ends, doc = common.words_of(data, at)
    w = common.word_hashes(data, starts, ends)
    out = [((w * SEEDS[0]) >> SHIFT, doc)]
    pair = doc[:-1] == doc[1:]
    out.append((((w[:-1] * np.uint64(common.BASE) + w[1:])[pair] * SEEDS[1]) >> SHIFT, doc[:-1][pair]))
    raw = data.tobytes()
    chars = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(chars) == len(data):
        edge = at
    else:
        edge = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    of = np.repeat(np.arange(n), np.diff(edge))
    b = chars.astype(np.uint64)
    for k, seed in ((3, SEEDS[2]), (5, SEEDS[3])):
        m = len(b) - k + 1
        if m < 1:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        g = b[:m].copy()
        for j in range(1, k):
            g *= np.uint64(common.BASE)
            g += b[j : m + j]
        g *= seed
        g >>= SHIFT
        inside = of[:m] == of[k - 1 :]
        out.append((g, of[:m]) if inside.all() else (g[inside], of[:m][inside]))
    return out


def raw_scores(model: QualityModel, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    score = np.full(n, model.bias)
    for f, (idx, doc) in enumerate(features(data, at)):
        total = np.bincount(doc, weights=model.weights[f][idx.astype(np.int64)], minlength=n)
        score += SCALE * total / np.maximum(1, np.bincount(doc, minlength=n))
    return score


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_arrays(texts: list[str], y: np.ndarray, shares: tuple[int, int] | None = None, epochs: int = 12, rate: float = 0.05, l2: float = 1e-6) -> QualityModel | None:
    """Adagrad on four fifths of the rows, Platt's scaling on the others. None without both classes.

    shares: how many rows have label 0 and 1 where y is a sample of them; the scaling weighs its rows accordingly.
    """
    y = np.asarray(y, float)
    if len(set(y.tolist())) < 2 or min((y == 0).sum(), (y == 1).sum()) < LEAST_PER_CLASS:
        return None
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
        idx, val = [], []
        for f, (g, _) in enumerate(features(raw, np.array([0, len(raw)]))):
            u, c = np.unique(g.astype(np.int64), return_counts=True)
            idx.append((u + (f << BITS)).astype(np.int32))
            val.append((SCALE * c / max(1, c.sum())).astype(np.float32))
        rows.append((np.concatenate(idx), np.concatenate(val)))
    held = np.arange(len(rows)) % 5 == 4
    fit, rest = np.flatnonzero(~held), np.flatnonzero(held)
    w, g2, bias, b2 = np.zeros(FAMILIES << BITS), np.full(FAMILIES << BITS, 1e-4), 0.0, 1e-4
    weight = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * len(fit)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            idx = np.concatenate([rows[i][0] for i in part])
            val = np.concatenate([rows[i][1] for i in part])
            of = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            p = _sigmoid(np.bincount(of, weights=w[idx] * val, minlength=len(part)) + bias)
            err = (p - y[part]) * weight[part] / len(part)
            at, inv = np.unique(idx, return_inverse=True)
            grad = np.bincount(inv, weights=val * err[of]) + l2 * w[at]
            g2[at] += grad * grad
            w[at] -= rate * grad / np.sqrt(g2[at])
            b2 += err.sum() ** 2
            bias -= rate * err.sum() / np.sqrt(b2)
    s = np.array([w[rows[i][0]] @ rows[i][1] + bias for i in rest])
    of = shares or ((y == 0).sum(), (y == 1).sum())
    weighed = np.where(y == 1, of[1] / (y == 1).sum(), of[0] / (y == 0).sum()) * len(y) / sum(of)
    slope, shift = _platt(s, y[rest], weighed[rest])
    return QualityModel(w.reshape(FAMILIES, -1).astype(np.float32), bias, slope, shift)


def _platt(s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b, ridge = 1.0, 0.0, 1.0  # the ridge towards slope 1 and shift 0 keeps separable samples from a step function
    for _ in range(100):
        p = _sigmoid(a * s + b)
        d, v = (p - target) * weight, np.maximum(p * (1 - p), 1e-9) * weight
        h = np.array([[(v * s * s).sum() + ridge, (v * s).sum()], [(v * s).sum(), v.sum() + ridge]])
        step = np.linalg.solve(h, [(d * s).sum() + ridge * (a - 1), d.sum() + ridge * b])
        a, b = a - float(step[0]), b - float(step[1])
        if abs(step).max() < 1e-9:
            break
    return (a, b) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS) -> QualityModel | None:
    """Fit on at most sample_per_class labelled rows of either class (see sampling.labelled_sample), calibrated to the
    shares of all of them."""
    rows = sampling.labelled_sample(docs, labels, "quality", sample_per_class, least=LEAST_PER_CLASS)
    return fit_arrays(rows.text.tolist(), rows.y.to_numpy(), sampling.shares(labels, "quality")) if len(rows) else None


_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def base_counts(text: bytes, n_chars: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, 0 if not text else len(text) - len(text.translate(None, _SYMBOLS)), 0, 0
    chars = n_chars - (len(text) - len(text.translate(None, _SPACE)))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    dup, seen = 0, set()
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            till = 0
            for i, x in enumerate(windows):
                if often[x] > 1:
                    repeat += i + 3 - max(i, till)
                    till = i + 3
    return n, chars, symbols, dup, repeat


def quality_rules(docs: DataFrame, model: QualityModel | None, min_good: float = MIN_GOOD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics and verdict of every text.

    Columns: those in keep, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed,
    kept (boolean), good (double, the calibrated probability; null without a model). A null text has no words and
    so fails; an empty table gives no rows; repeated rows each get their own verdict; other columns are left out.
    Without a model (no labelled rows of both classes) the base limits alone decide.
    """
    common.bound_batches(docs.sparkSession)
    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, good double"
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, good = [], []
            for _, _, data, at in common.text_blocks(batch, "__text"):
                raw = data.tobytes()
                length = np.add.reduceat(np.concatenate([(data & 0xC0) != 0x80, [False]]).astype(np.int64), at[:-1]) * (np.diff(at) > 0)
                edges = at.tolist()
                base += [base_counts(raw[a:b], c) for a, b, c in zip(edges, edges[1:], length.tolist())]
                if model is not None:
                    good.append(_sigmoid(model.slope * raw_scores(model, data, at) + model.shift))
            x = np.array(base, np.int64).reshape(-1, 5)
            p = np.concatenate(good) if good else np.ones(len(x))
            failed = (x[:, 0] < MIN_WORDS) | (100 * x[:, 4] > MAX_REPEAT_PERCENT * x[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(x[:, j]) for j in range(5)] + [pa.array(failed), pa.array(~failed & (p >= min_good)), pa.array(p if model is not None else [None] * len(x), pa.float64())],
                names=[*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "good"],
            )

    return source.mapInArrow(run, f"{head}, {schema}")
