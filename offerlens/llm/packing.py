"""Operator 9, best-fit packing: a configuration linear program over the histogram of piece lengths.

Multiplicative weights solve the covering program min sum(x) with A x >= n, one variable for each way to
fill a sequence. Pricing is a knapsack dynamic program over capacities; one table prices, for every length,
the best sequence that contains it. The fractional solution is rounded pattern by pattern and what remains
goes by best fit decreasing, still on the histogram. All of this sees at most `capacity` counts, whatever the
corpus holds; the pieces themselves get their place by rank within their length, in Spark.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlens.llm import common

CAPACITY = 2048
END_ID = 0
ROUNDS = 60
CACHE_WORDS = 300_000


# ---- tokens


class WordTokenizer:
    """The tokenizer's ids of whole texts, as little-endian uint32 bytes, with the ids of frequent words remembered.

    No token of this vocabulary spans white space, so a text's ids are its words' ids in order. Texts where that
    may differ (special tokens, controls 1C-1F, letters whose lower case hangs on their neighbours) go to the
    tokenizer whole. The memory of words has two generations of at most CACHE_WORDS.
    """

    _MARKS = ".,;:!?*$%&#|"
    _WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "Σ", "İ")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _packed(ids) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _letters(self, words: list[str]) -> None:
        """Many words of letters in one call: each is one unit of the tokenizer, whose last token bears the end mark."""
        for k in range(0, len(words), 4000):
            part = words[k : k + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(part):
                raw, a = ids.tobytes(), 0
                for w, b in zip(part, ends):
                    self.young[w] = raw[4 * a : 4 * b]
                    a = b
            else:
                self._others(part)

    def _others(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.young[w] = self._packed(e.ids)

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words: of letters, of letters with marks after them, of anything else."""
        young, old = self.young, self.old
        letters, others, marked = set(), set(), []
        for w in words:
            known = old.get(w)
            if known is not None:
                young[w] = known
            elif w.isalpha():
                letters.add(w)
            elif (core := w.rstrip(self._MARKS)).isalpha():
                tail = w[len(core) :]
                marked.append((w, core, tail))
                if core not in young:
                    letters.add(core)
                if tail not in young:
                    others.add(tail)
            else:
                others.add(w)
        self._letters(list(letters))
        self._others(list(others))
        for w, core, tail in marked:
            young[w] = young[core] + young[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts: list[list[str] | bytes] = []
        for t in texts:
            if any(x in t for x in self._WHOLE):
                parts.append(self._packed(self.tokenizer.encode(t, add_special_tokens=False).ids))
            else:
                parts.append((t if t.isascii() else unicodedata.normalize("NFC", t)).lower().split())
        words = set().union(*(p for p in parts if isinstance(p, list)))
        need = words - self.young.keys()
        if len(self.young) + 2 * len(need) > CACHE_WORDS:
            self.old, self.young, need = self.young, {}, words
        if need:
            self._learn(need)
        get = self.young.__getitem__
        return [p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One per Python worker: what it remembers serves later tasks too."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with END_ID after them, cut at capacity."""
    common.bound_batches(docs.sparkSession)
    source = docs.select("doc_id", F.col("text").cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("__text")
            row, piece, start, length, crc = [], [], [], [], []
            for first, stop, _, _ in common.text_blocks(batch, "__text"):
                for i, ids in enumerate(tokenizer.encode([x or "" for x in texts.slice(first, stop - first).to_pylist()]), first):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# ---- the plan, from the histogram alone


def price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most worth that fits into c, each length any number of times; choice[c]: a length's index, or -1 to leave one unit free."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            v = worth[:k] + best[c - lengths[:k]]
            j = int(v.argmax())
            if v[j] > best[c] + 1e-15:
                best[c], choice[c] = v[j], j
    return best, choice


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = 2.0) -> Counter:
    """Patterns (sorted tuples of length indices) of the fractional covering, with their amounts."""
    x: Counter = Counter()
    cover = np.zeros(len(lengths))
    for r in range(rounds):
        short = cover / counts
        worth = lengths / capacity * np.exp(-step * (short - short.min()))
        best, choice = price(lengths, worth, capacity)
        total = worth + best[capacity - lengths]
        level = short.min() + 1.0 / rounds
        for j in np.argsort(-total):
            if cover[j] >= level * counts[j] and r:
                continue
            pattern, c = [int(j)], capacity - int(lengths[j])
            while c > 0:
                k = int(choice[c])
                if k < 0:
                    c -= 1
                    continue
                pattern.append(k)
                c -= int(lengths[k])
            of = Counter(pattern)
            amount = min(counts[k] / m for k, m in of.items()) / rounds
            amount = max(amount, min((level * counts[j] - cover[j]) / of[int(j)], amount))
            x[tuple(sorted(pattern))] += amount
            for k, m in of.items():
                cover[k] += m * amount
    scale = max(1e-12, (cover / counts).min())
    return Counter({p: v / scale for p, v in x.items()})


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(number of sequences, ((length, times), ...)) that hold exactly the histogram's pieces."""
    full = histogram.get(capacity, 0)
    rest = {n: c for n, c in histogram.items() if 0 < n < capacity and c > 0}
    out = [(full, ((capacity, 1),))] if full else []
    if not rest:
        return out
    lengths = np.array(sorted(rest), np.int64)
    left = np.array([rest[n] for n in lengths.tolist()], np.int64)
    x = solve(lengths, left.astype(float), capacity, rounds)
    waste = {p: capacity - int(lengths[list(p)].sum()) for p in x}
    carried = 0.0
    for p, v in sorted(x.items(), key=lambda e: (waste[e[0]], -e[1], e[0])):
        of = Counter(p)
        carried += v
        fits = min(int(left[k]) // m for k, m in of.items())
        times = min(fits, int(np.floor(v + 0.5)) if v >= 1 else int(carried >= 1 or waste[p] == 0))
        if times > 0:
            carried = max(0.0, carried - times)
            out.append((times, tuple((int(lengths[k]), m) for k, m in sorted(of.items(), reverse=True))))
            for k, m in of.items():
                left[k] -= m * times
    return out + best_fit({int(n): int(c) for n, c in zip(lengths, left) if c}, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit decreasing by runs: equal sequences are kept as one entry with a count."""
    free: dict[int, list[list]] = {}
    order: list[int] = []

    def put(room: int, count: int, content: tuple) -> None:
        if room not in free:
            free[room] = []
            bisect.insort(order, room)
        for e in free[room]:
            if e[1] == content:
                e[0] += count
                return
        free[room].append([count, content])

    for n in sorted(histogram, reverse=True):
        todo = histogram[n]
        while todo:
            i = bisect.bisect_left(order, n)
            if i == len(order):
                each = min(capacity // n, todo)
                m = todo // each
                put(capacity - n * each, m, ((n, each),))
                todo -= m * each
                continue
            room = order[i]
            entry = free[room][-1]
            each = min(room // n, todo)
            m = min(entry[0], todo // each)
            todo -= m * each
            entry[0] -= m
            if not entry[0]:
                free[room].pop()
                if not free[room]:
                    del free[room]
                    order.pop(i)
            put(room - n * each, m, (*entry[1], (n, each)))
    return [(count, content) for entries in free.values() for count, content in entries]


def slots(sequences: list[tuple[int, tuple[tuple[int, int], ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 40 | first rank), then for each: the first sequence, the stride of ranks within a sequence, the first offset.

    A run of `count` sequences with `times` pieces of a length takes count*times successive ranks of it: rank
    first + q*times + t lies in sequence base + q, at offset + t*length.
    """
    used: Counter = Counter()
    key, base, stride, offset, at = [], [], [], [], 0
    for count, content in sequences:
        o = 0
        for n, times in content:
            key.append(n << 40 | used[n])
            base.append(at)
            stride.append(times)
            offset.append(o)
            used[n] += count * times
            o += n * times
        at += count
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return tuple(np.array(v, np.int64)[order] for v in (key, base, stride, offset))


# ---- pieces to places


def ranked(parts: DataFrame) -> DataFrame:
    """Adds rank, from 0, of each piece among those of its length. Ids are dealt to buckets first, so one frequent length is many groups."""
    spark = parts.sparkSession
    buckets = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")))
    return inner.join(before, ["bucket", "length"]).withColumn("rank", F.col("before") + F.col("nth") - 1)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id END_ID; every row of docs is packed, repeated ones each for itself;
    an empty table packs into nothing; other columns of docs are left out.
    """
    spark = docs.sparkSession
    parts = common.materialize(pieces(docs, tokenizer_path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(slots(plan(histogram, capacity, rounds)))
    kind = parts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, stride, offset = places.value
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(key, n << 40 | rank, "right") - 1
            nth = rank - (key[i] & ((1 << 40) - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(base[i] + nth // stride[i]), pa.array(offset[i] + nth % stride[i] * n)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    wanted = ranked(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return wanted.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
