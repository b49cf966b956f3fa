"""Shared plumbing of the corpus operators: tables, shared storage, Arrow text blocks, word hashing.

Texts reach Python as Arrow string arrays. ``text_blocks`` cuts a batch into runs of whole documents
of about one megabyte, as views of the Arrow buffers; numpy then works on bytes, so memory follows the
block and the longest document, not the batch.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
#: An odd 64-bit base for polynomial hashes, and the finaliser's multipliers.
BASE = 0x9E3779B97F4A7C55
MIX_1, MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33 = np.uint64(33)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by size as well as by rows, so that long texts don't make huge ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        known = spark.sparkContext.getCheckpointDir()
        if known is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="offerlens-"))
            known = spark.sparkContext.getCheckpointDir()
        where = known
    return where.rstrip("/")


_made: dict[str, list[str]] = {}
_tag = "query"


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, which the next stage deletes."""
    path = f"{shared_dir(spark)}/offerlens/{name}-{uuid.uuid4().hex}"
    _made.setdefault(_tag, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no unfinished query reads, and let Spark drop the shuffles behind them."""
    for t in tables:
        _delete(t.sparkSession, t.stored_at)
        for paths in _made.values():
            if t.stored_at in paths:
                paths.remove(t.stored_at)
    if tables:
        spark = tables[0].sparkSession
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def begin_stage(spark: SparkSession, tag: str = "stage") -> None:
    """Tables of earlier stages go: their results have been written by now. Later ones bear this tag."""
    global _tag
    _tag = tag
    for path in _made.pop(tag, []):
        _delete(spark, path)
    bound_batches(spark)


def end_stage() -> None:
    global _tag
    _tag = "query"


def id_fold(doc_id, mod: int):
    """crc32 of the id's decimal text, modulo mod."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def text_blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts; a run holds at least one text."""
    data, at = utf8(batch.column(column))
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; grown when a longer block comes."""
    global _powers, _inverse
    if len(_powers) < n:
        m = 1 << max(10, (n - 1).bit_length())
        up, down = np.full(m, BASE, np.uint64), np.full(m, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers, _inverse = np.cumprod(up), np.cumprod(down)
    return _powers, _inverse


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of h."""
    h = (h ^ (h >> S33)) * MIX_1
    h = (h ^ (h >> S33)) * MIX_2
    return h ^ (h >> S33)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words [^\\x20\\x09-\\x0D]+ and each one's text number; words don't cross texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z lower-cased if asked."""
    up, down = powers(len(data) + 1)
    v = (_LOWER[data] if lower else data).astype(np.uint64)
    v += np.uint64(1)
    v *= up[: len(v)]
    total = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word shingles and their text numbers; a text of 1 to k-1 words gives its whole sequence as one."""
    count = np.bincount(doc, minlength=n_docs)
    at = np.zeros(n_docs + 1, np.int64)
    np.cumsum(count, out=at[1:])
    m = len(words)
    if m >= k:
        h = words[: m - k + 1].copy()
        for j in range(1, k):
            h *= np.uint64(BASE)
            h += words[j : m - k + 1 + j]
        whole = doc[: m - k + 1] == doc[k - 1 :]
        h, d = mixed(h[whole]), doc[: m - k + 1][whole]
    else:
        h, d = words[:0], doc[:0]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, t in enumerate(short.tolist()):
            s = 0
            for x in words[at[t] : at[t + 1]].tolist():
                s = (s * BASE + x) & 0xFFFFFFFFFFFFFFFF
            extra[i] = (s + 0x632BE59BD9B4E019 * int(count[t])) & 0xFFFFFFFFFFFFFFFF
        h, d = np.concatenate([h, mixed(extra)]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d
