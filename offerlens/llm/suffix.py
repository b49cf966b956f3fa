"""Operator 1, suffix-array deduplication of exact passages.

Removes every byte that lies in a `length`-byte string which also starts earlier (in an earlier document, or before
in the same one), judged on the input. Strings meet in Spark by content, and are told apart by suffix arrays:

1. Each window of `length` bytes is anchored at its least-hashed GRAM-byte string; neighbouring windows with the same
   anchor form a segment. Equal windows have equal anchors, so all copies of a window lie in segments of one anchor.
2. Anchors seen once hold no repeats. Segments alike in every byte are one entry; all but the first repeat wholly.
3. Where an anchor has different segments, the first of each kind brings its bytes, and a suffix array over all
   segments of a task finds their equal windows. It is built by bucket-pointer refinement: buckets of equal 8-byte
   strings, then buckets of twice that depth by sorting each bucket on the bucket numbers of the suffixes that
   start where the known prefix ends, using the numbers just renewed, up to the depth `length`.
4. An anchor with more than HOT kinds of segments (the ends of a passage that very many documents hold) would be one
   task's work; its windows are spread out by a 128-bit hash of their bytes instead, and counted there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm import common

LENGTH = 100
GRAM = 32
HOT = 2000
INDEX_BITS = 24
SLICE = 1 << 22
ARRAY_BYTES = 1 << 20
FIRST_ID = -(1 << 63)


# ---- anchors


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position on (positions too near the end hash what follows as well)."""
    n = len(data)
    out = np.zeros(n, np.uint64)
    piece, size, done = data.astype(np.uint64) + np.uint64(1), 1, 0
    while True:
        if k & size:
            m = n - done
            if m > 0:
                out[:m] = out[:m] * np.uint64(pow(common.BASE, size, 1 << 64)) + piece[done:]
            done += size
        if done == k:
            return common.mixed(out)
        factor = np.uint64(pow(common.BASE, size, 1 << 64))
        longer = piece * factor
        longer[: n - size] += piece[size:] if n > size else 0
        piece, size = longer, 2 * size


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one stretch of bytes (at most 2**INDEX_BITS): first window, number of windows, anchor hash, content hash of each segment."""
    n = len(data) - length + 1
    if n < 1:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    full = gram_hashes(data, gram)[: n + length - gram]
    low = np.uint64((1 << INDEX_BITS) - 1)
    v = (full & ~low) | np.arange(len(full), dtype=np.uint64)
    size, w = 1, length - gram + 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < w:
        v = np.minimum(v[: len(v) - (w - size)], v[w - size :])
    start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    count = np.diff(np.append(start, n))
    anchor = (v[start] & low).astype(np.int64)
    up, down = common.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    content = (total[start + count + length - 1] - total[start]) * down[start]
    shape = (count.astype(np.uint64) << np.uint64(32)) + (anchor - start).astype(np.uint64)
    return start, count, full[anchor], common.mixed(content + shape * common.MIX_1)


def _slices(at: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(text, from, to) of stretches of at most SLICE windows; the cuts of a longer text lose no window."""
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        while b - a >= length:
            end = min(b, a + SLICE + length - 1)
            yield i, a, end
            a = end - length + 1


def _joined(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Segments of all texts of a block: text, first window in the text, windows, anchor hash, content hash."""
    parts = []
    for i, a, b in _slices(at, length):
        s, c, h, k = segments(data[a:b], length, gram)
        parts.append((np.full(len(s), i), s + (a - at[i]), c, h, k))
    return [np.concatenate(x) for x in zip(*parts)] if parts else None


BLOOM_BITS = 26
OTHER_BASE = 0xD1342543DE82EF95


def numbered(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The columns in keep, __text and a document's number: __id, and __v, a hash of the text where rows share an id (else 0);
    and the same with each number once."""
    rows = docs.select(*keep, F.coalesce(F.expr("try_cast(doc_id as bigint)"), F.lit(FIRST_ID)).alias("__id"), F.col("text").cast("string").alias("__text"))
    again = common.materialize(rows.groupBy("__id").count().filter("count > 1").select(F.col("__id").alias("__again")), "again")
    if again.isEmpty():
        rows = rows.withColumn("__v", F.lit(0).cast("long"))
        return rows, rows
    known = rows.join(again, F.col("__id") == F.col("__again"), "left")
    known = known.withColumn("__v", F.when(F.col("__again").isNull(), F.lit(0)).otherwise(F.xxhash64("__text"))).drop("__again")
    return known, known.dropDuplicates(["__id", "__v"])


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """h: the anchor hash of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in common.text_blocks(batch, "__text"):
                found = _joined(data, at, length, gram)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found[3].astype(np.int64))], names=["h"])

    return docs.select("__text").mapInArrow(run, "h long")


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - BLOOM_BITS)
    return ((h * common.MIX_1) >> top).astype(np.int64), ((h * common.MIX_2) >> top).astype(np.int64)


def repeated_filter(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """A Bloom filter of the anchors that occur more than once: 2**BLOOM_BITS bits, however large the corpus.

    It only spares the next step rows; what passes by chance is dropped there, so a full filter costs time, not results.
    """
    again = anchors(docs, length, gram).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.concatenate(_bits(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)))
            word, at = np.unique(bit >> 6, return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, at, np.uint64(1) << (bit & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.astype(np.int64))], names=["word", "mask"])

    words = again.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return out


def repeated_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, k, id, v, at) of segments whose anchor passes the filter; at holds the first window << 8 | windows."""
    passing = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, length, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = passing.value
        for batch in batches:
            ids, vs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__id", "__v"))
            for first, _, data, at in common.text_blocks(batch, "__text"):
                found = _joined(data, at, length, gram)
                if not found:
                    continue
                text, start, count, h, k = found
                one, two = _bits(h)
                on = ((seen[one >> 6] >> (one & 63).astype(np.uint64)) & (seen[two >> 6] >> (two & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[on].astype(np.int64)), pa.array(k[on].astype(np.int64)), pa.array(ids[first + text[on]]), pa.array(vs[first + text[on]]), pa.array(start[on] << 8 | count[on])],
                    names=["h", "k", "id", "v", "at"],
                )

    return docs.select("__id", "__v", "__text").mapInArrow(run, "h long, k long, id long, v long, at long")


# ---- suffix arrays


def buckets(data: np.ndarray, depth: int) -> np.ndarray:
    """Bucket pointers of all suffixes: equal exactly where the first `depth` bytes are (as far as data goes).

    A pointer is the place of the bucket's first suffix in suffix order. Buckets of one suffix are final.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    known = min(8, depth)
    for j in range(known):
        key = key << np.uint64(8) | padded[j : n + j]
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    size = np.diff(np.append(head, n)).astype(np.int32)
    pointer = np.empty(n, np.int32)
    pointer[order] = np.repeat(head.astype(np.int32), size)
    open_ = order[np.repeat(size, size) > 1].astype(np.int32)  # in suffix order, buckets of more than one
    del key, order
    while known < depth and len(open_):
        step = min(known, depth - known)
        later = np.where(open_ + step < n, pointer[np.minimum(open_ + step, n - 1)], np.int32(-1))
        own = pointer[open_]
        order = np.lexsort((later, own))
        open_, own, later = open_[order], own[order], later[order]
        bucket = np.concatenate([[True], own[1:] != own[:-1]])
        head = np.flatnonzero(bucket | np.concatenate([[True], later[1:] != later[:-1]]))
        size = np.diff(np.append(head, len(open_)))
        base = np.flatnonzero(bucket)
        first = base[np.searchsorted(base, head, "right") - 1]
        pointer[open_] = np.repeat(own[head] + head - first, size)  # renewed in place: the next pass sorts on these
        open_ = open_[np.repeat(size, size) > 1]
        known += step
    return pointer


def later_windows(texts: list[bytes], ids: np.ndarray, vs: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(id, v, from, to) of runs of windows in the given segments that equal a window of an earlier place in them."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    windows = size - length + 1
    of = np.repeat(np.arange(len(texts), dtype=np.int32), windows)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    bucket = buckets(data, length)[begin[of] + inner]
    where = starts[of] + inner
    order = np.lexsort((where, vs[of], ids[of], bucket))
    b = bucket[order]
    later = np.zeros(len(of), bool)
    later[order[1:]] = b[1:] == b[:-1]
    hit = np.flatnonzero(later)
    if not len(hit):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    return ids[of[hit[first]]], vs[of[hit[first]]], where[hit[first]], where[hit[last]] + length


def by_suffix_array(kinds: DataFrame, length: int) -> DataFrame:
    """(id, v, a, b) of repeated runs among segments (h, id, v, start, bytes); whole anchors share a task and an array."""
    dealt = kinds.repartition("h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def solve(rows):
            ids, vs, starts = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in later_windows([r[4] for r in rows], ids, vs, starts, length)], names=["id", "v", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "id", "v", "start", "bytes"))):
                if size > ARRAY_BYTES and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    return dealt.mapInArrow(run, "id long, v long, a long, b long")


def _hash_with(data: np.ndarray, base: int, length: int) -> np.ndarray:
    """Hash of each window of `length` bytes."""
    up, down = np.full(len(data) + 1, base, np.uint64), np.full(len(data) + 1, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return common.mixed((total[length:] - total[:-length]) * down[: len(data) - length + 1])


def by_window_hash(kinds: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many kinds of segments: their windows meet by hash, all over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vs, starts, texts = (batch.column(c).to_pylist() for c in ("id", "v", "start", "bytes"))
            for lo in range(0, len(texts), 2048):
                part = texts[lo : lo + 2048]
                size = np.array([len(t) for t in part], np.int64)
                data = np.frombuffer(b"".join(part), np.uint8)
                windows = size - length + 1
                inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                at = np.repeat(np.cumsum(size) - size, windows) + inner
                one, two = (_hash_with(data, base, length)[at].astype(np.int64) for base in (common.BASE, OTHER_BASE))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two)] + [pa.array(np.repeat(np.array(x[lo : lo + 2048], np.int64), windows) + (inner if x is starts else 0)) for x in (ids, vs, starts)],
                    names=["one", "two", "id", "v", "a"],
                )

    rows = kinds.mapInArrow(run, "one long, two long, id long, v long, a long")
    first = rows.groupBy("one", "two").agg(F.min(F.struct("id", "v", "a")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("one", "two", "first")
    first = common.materialize(first, "windows")
    met = rows.join(first, ["one", "two"]).filter("first <> struct(id, v, a)")
    return met.select("id", "v", "a", (F.col("a") + length).alias("b"))


# ---- the whole


def packed_texts(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns in keep, __id, __v and the text as zstandard bytes, which make half the shuffle that strings make."""
    source = docs.select(*keep, "__id", "__v", "__text")
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            out = [squeeze((t or "").encode()) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*keep, "__id", "__v")] + [pa.array(out, pa.binary())], names=[*keep, "__id", "__v", "z"])

    return source.mapInArrow(run, f"{head}__id long, __v long, z binary")


def kinds_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, many, id, v, start, bytes) of the wanted segments (h, many, id, v, at)."""
    asked = wanted.groupBy("id", "v").agg(F.collect_list(F.struct("h", "many", "at")).alias("asked"))
    asked = common.materialize(asked, "asked")
    both = packed_texts(docs, ()).join(asked, (F.col("__id") == F.col("id")) & (F.col("__v") == F.col("v"))).select("id", "v", "z", F.col("asked.h").alias("h"), F.col("asked.many").alias("many"), F.col("asked.at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for row in range(batch.num_rows):
                text = zstandard.ZstdDecompressor().decompress(batch.column("z")[row].as_py())
                h, many, at = (batch.column(c)[row].values for c in ("h", "many", "at"))
                at = at.to_numpy(zero_copy_only=False)
                start, size = at >> 8, (at & 255) + length - 1
                parts = [text[a : a + b] for a, b in zip(start.tolist(), size.tolist())]
                fit = np.array([len(p) == b for p, b in zip(parts, size.tolist())], bool)
                yield pa.RecordBatch.from_arrays(
                    [h.filter(pa.array(fit)), many.filter(pa.array(fit)), *(pa.array([batch.column(c)[row].as_py()] * int(fit.sum()), pa.int64()) for c in ("id", "v")), pa.array(start[fit]), pa.array([p for p, ok in zip(parts, fit) if ok], pa.binary())],
                    names=["h", "many", "id", "v", "start", "bytes"],
                )

    return both.mapInArrow(run, "h long, many boolean, id long, v long, start long, bytes binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, v, a, b): byte ranges of numbered documents that repeat earlier strings; they may overlap."""
    met = common.materialize(repeated_segments(docs, length, gram), "segments")
    entries = common.materialize(met.groupBy("h", "k").agg(F.min(F.struct("id", "v", "at")).alias("first"), F.count("*").alias("n")), "entries")
    twice = entries.filter("n > 1").select("h", "k", "first")
    whole = met.join(common.materialize(twice, "twice"), ["h", "k"]).filter("first <> struct(id, v, at)")
    whole = whole.select("id", "v", F.shiftright("at", 8).alias("a"), (F.shiftright("at", 8) + F.col("at").bitwiseAND(255) + (length - 1)).alias("b"))
    several = entries.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    several = common.materialize(several, "several")
    wanted = entries.join(several, "h").select("h", (F.col("kinds") > hot).alias("many"), "first.id", "first.v", "first.at")
    kinds = common.materialize(kinds_of(docs, wanted, length), "kinds")
    common.discard(several)
    by_array = by_suffix_array(kinds.filter("not many").select("h", "id", "v", "start", "bytes"), length)
    by_hash = by_window_hash(kinds.filter("many").select("id", "v", "start", "bytes"), length)
    return whole.unionByName(by_array).unionByName(by_hash)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep, n_bytes (long), kept (binary: the bytes that stay) and spans (array<struct<a long, b long>>:
    the maximal removed ranges) of every document.

    Null and empty texts keep nothing and lose nothing. A null doc_id (or one that is no whole number) comes before all
    others. Rows that share a doc_id are documents of their own, in order of a hash of their texts; only rows alike in
    id and text count as one document, which doesn't repeat itself. An empty table gives no rows; columns not in keep
    are left out. A segment's windows, length - gram + 1 at most, must be fewer than 256.
    """
    if not 8 <= gram <= length or length - gram > 254:
        raise ValueError("gram must be 8 to length, and length - gram at most 254")
    common.bound_batches(docs.sparkSession)
    docs, once = numbered(docs, keep)
    spans = repeated_spans(once, length, gram, hot).groupBy("id", "v").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    spans = common.materialize(spans.withColumnsRenamed({"id": "__sid", "v": "__sv"}), "spans")
    both = packed_texts(docs, keep).join(spans, (F.col("__id") == F.col("__sid")) & (F.col("__v") == F.col("__sv")), "left").select(*(F.col(f"`{c}`") for c in keep), F.col("z").alias("__z"), F.col("found.a").alias("__a"), F.col("found.b").alias("__b"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                size, kept, removed = [], [], []
                for z, a, b in zip(part.column("__z").to_pylist(), part.column("__a"), part.column("__b")):
                    text = zstandard.ZstdDecompressor().decompress(z)
                    size.append(len(text))
                    if not a.is_valid:
                        kept.append(text)
                        removed.append([])
                        continue
                    x = a.values.to_numpy(zero_copy_only=False)
                    y = np.minimum(b.values.to_numpy(zero_copy_only=False), len(text))
                    order = np.argsort(x)
                    x, y = x[order], np.maximum.accumulate(y[order])
                    new = np.flatnonzero(np.concatenate([[True], x[1:] > y[:-1]]))
                    ranges = [(p, q) for p, q in zip(x[new].tolist(), y[np.append(new[1:], len(x)) - 1].tolist()) if p < q]
                    out, at = [], 0
                    for p, q in ranges:
                        out.append(text[at:p])
                        at = q
                    kept.append(b"".join([*out, text[at:]]))
                    removed.append([{"a": p, "b": q} for p, q in ranges])
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [pa.array(size, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                    names=[*keep, "n_bytes", "kept", "spans"],
                )

    return both.mapInArrow(run, f"{head}, n_bytes long, kept binary, spans array<struct<a:long,b:long>>")


def as_text(result: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns in keep and text: the kept bytes as a string, without characters that lost some of their bytes."""
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([k.decode("utf-8", "ignore") for k in batch.column("kept").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [text], names=[*keep, "text"])

    return result.select(*keep, "kept").mapInArrow(run, f"{head}, text string")
