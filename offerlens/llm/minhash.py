"""Operator 6, document fingerprints: MinHash of word shingles.

PERMUTATIONS universal hashes a*x + b (modulo 2**64, a odd) are applied to the 64-bit hashes of a text's shingles,
a block of texts at a time; a fingerprint keeps 16 mixed bits of each minimum, as hexadecimal. The likeness of two
fingerprints is the share of equal minima, an estimate of the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import common, jaccard

PERMUTATIONS = 128
WORDS = 5
SEED = 6
FIRST_ID = -(1 << 63)


def coefficients(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minima(shingles: np.ndarray, doc: np.ndarray, n_docs: int, permutations: int = PERMUTATIONS) -> np.ndarray:
    """n_docs x permutations uint16; a text without shingles has all bits set."""
    out = np.full((n_docs, permutations), 0xFFFF, np.uint16)
    if not len(shingles):
        return out
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    has = doc[first]
    a, b = coefficients(permutations)
    v = np.empty_like(shingles)
    for k in range(permutations):
        np.multiply(shingles, a[k], out=v)
        v += b[k]
        out[has, k] = common.mixed(np.minimum.reduceat(v, first)) >> np.uint64(48)
    return out


def signatures(data: np.ndarray, at: np.ndarray, words: int = WORDS, permutations: int = PERMUTATIONS) -> np.ndarray:
    starts, ends, doc = common.words_of(data, at)
    h, of = common.shingle_hashes(common.word_hashes(data, starts, ends), doc, len(at) - 1, words)
    return minima(h, of, len(at) - 1, permutations)


def _hex(signature: np.ndarray) -> list[str]:
    raw = signature.astype(">u2").tobytes().hex()
    n = 4 * signature.shape[1]
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def _edges(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, permutations: int = PERMUTATIONS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and fingerprint (string) of every whole text.

    Null and empty texts, and texts without a word, share the fingerprint of the empty set; shorter texts than a
    shingle count as one. Equal texts have equal fingerprints. Repeated rows each get one; an empty table gives none.
    """
    common.bound_batches(docs.sparkSession)
    source = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, at in common.text_blocks(batch, "__text"):
                out += _hex(signatures(data, at, words, permutations))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(out, pa.string())], names=[*keep, "fingerprint"])

    return source.mapInArrow(run, f"{head}, fingerprint string")


def with_successor(docs: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, ahead, id, text) rows: ids in buckets of neighbouring ids, and behind each bucket, marked ahead, the
    row that follows its last one (after the last bucket: the very first row). Only the buckets' bounds and first
    ids, a few numbers for each shuffle partition, pass through the driver.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("id")
    bounds = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("b")).first()["b"]
    if bounds is None:
        return rows.select(F.lit(0).alias("bucket"), F.lit(0).alias("ahead"), "id", "text"), n
    cuts = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))])
    bucket = F.size(F.filter(cuts, lambda b: b < F.col("id")))
    firsts = {r["bucket"]: r["id"] for r in ids.groupBy(bucket.alias("bucket")).agg(F.min("id").alias("id")).collect()}
    order = sorted(firsts)
    behind = spark.createDataFrame([(b, firsts[order[(i + 1) % len(order)]]) for i, b in enumerate(order)], "bucket int, id long")
    head = rows.join(F.broadcast(behind.select("id").distinct()), "id").groupBy("id").agg(F.min("text").alias("text"))
    ahead = head.join(F.broadcast(behind), "id").select("bucket", F.lit(1).alias("ahead"), "id", "text")
    return rows.select(bucket.alias("bucket"), F.lit(0).alias("ahead"), "id", "text").unionByName(ahead), n


def edited_fingerprints(docs: DataFrame, part: int = 4, words: int = WORDS, permutations: int = PERMUTATIONS) -> DataFrame:
    """Fingerprints of every text and of its edited form: the last n_chars // part characters give way to the first
    as many (or all) of the next document, by ascending doc_id (equal ids by text; null counts as the least id).

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text
    is empty; a single row is its own successor; an empty table gives no rows; other columns are left out.
    """
    common.bound_batches(docs.sparkSession)
    rows, n = with_successor(docs)
    dealt = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "ahead", "id", "text")

    def work(own: list[bytes], ids: list, ahead: list) -> pa.RecordBatch | None:
        """All rows but the last, against the row after each."""
        emit = [i for i in range(len(own) - 1) if not ahead[i]]
        sig = signatures(np.frombuffer(b"".join(own), np.uint8), _edges(own), words, permutations)
        chars, edited = [], []
        for i in emit:
            t, follow = own[i].decode(), own[i + 1].decode()
            k = len(t) // part
            chars.append(len(t))
            edited.append((t[: len(t) - k] + follow[:k]).encode())
        if not emit:
            return None
        other = signatures(np.frombuffer(b"".join(edited), np.uint8), _edges(edited), words, permutations)
        mine, after = sig[emit], sig[[i + 1 for i in emit]]
        return pa.RecordBatch.from_arrays(
            [pa.array([None if ids[i] == FIRST_ID else ids[i] for i in emit], pa.int64()), pa.array(chars, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in edited]), pa.array(_hex(mine)), pa.array(_hex(other)), pa.array((mine == other).mean(1)), pa.array((mine == after).mean(1))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ([], [], [])
        for batch in batches:
            for first, stop, _, _ in common.text_blocks(batch, "text"):
                part_ = batch.slice(first, stop - first)
                own = held[0] + [t.encode() for t in part_.column("text").to_pylist()]
                ids, ahead = (h + part_.column(c).to_pylist() for h, c in zip(held[1:], ("id", "ahead")))
                done = work(own, ids, ahead)
                if done is not None:
                    yield done
                held = (own[-1:], ids[-1:], ahead[-1:])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


BANDS, ROWS = 25, 5


def band_keys(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, f): one row for each signature band of every text with a word; f is its shingle set's fingerprint."""
    source = docs.select(F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in common.text_blocks(batch, "__text"):
                n = len(at) - 1
                starts, ends, doc = common.words_of(data, at)
                h, of = common.shingle_hashes(common.word_hashes(data, starts, ends), doc, n, words)
                sig = minima(h, of, n, bands * rows).astype(np.uint64).reshape(n, bands, rows)
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64) * common.MIX_2, (n, bands)).copy()
                for j in range(rows):
                    key = common.mixed(key * np.uint64(common.BASE) + sig[:, :, j])
                edge = np.searchsorted(of, np.arange(n + 1))
                f = np.array([jaccard.mark(np.unique(h[a:b])) for a, b in zip(edge, edge[1:])], np.int64)
                has = np.diff(edge) > 0
                yield pa.RecordBatch.from_arrays([pa.array(key[has].reshape(-1).astype(np.int64)), pa.array(np.repeat(f[has], bands))], names=["key", "f"])

    return source.mapInArrow(run, "key long, f long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id of its near-duplicate class) of every document.

    Signature bands propose, Spark joins them, and the exact Jaccard similarity of the shingle sets decides. Texts
    that share a band get one of them as pivot, so a band that very many share costs one row for each, not pairs; the
    exact step is the Jaccard join's. Nulls, empty texts, repeated rows and empty tables are as in the Jaccard join.
    """
    common.bound_batches(docs.sparkSession)
    return jaccard.classes_of(docs, words, percent, band_keys(docs, words))
