"""Operator 13, token-ID files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds the documents of one range of doc_id, in ascending order:

    frame ...    zstandard frames of little-endian uint32 ids, with zstandard's own content checksum; a document
                 has its own frames (one for every FRAME_IDS ids), so reading it decompresses nothing else
    index        a skippable frame (magic 0x184D2A50): a zstandard frame of the documents' ids (int64), null marks
                 (uint8) and numbers of ids (int64), each as one run
    seek table   a skippable frame (magic 0x184D2A5E) of the public seekable format: for each frame, the index
                 included, compressed size, decompressed size and the low 32 bits of XXH64 of the content (uint32
                 each), then the number of frames (uint32), descriptor 0x80 and magic 0x8F92EAB1

Any zstandard decoder reads such a file from end to end; readers of the seekable format find every frame.

`TokenFiles` is a Spark data source over a folder of these files: `df.write.format("token_files").save(path)` and
`spark.read.format("token_files").load(path)`. Each task writes one file under a name of its own; the manifest,
written when all tasks are done, names the files that count, so what lost or repeated tasks left is never read.
Filters on doc_id reach the reader (spark.sql.python.filterPushdown.enabled): it opens only files whose range may
hold such ids and decompresses only their frames. Files are reached through pyarrow.fs, by the folder's URI.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from offerlens.llm import common

END_ID = 0
LEVEL = 3
FRAME_IDS = 1 << 20
FILE_BYTES = 64 << 20
TEXT_BYTES = 12 << 20
MANIFEST = "_manifest.json"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("size", "<u4"), ("content", "<u4"), ("checksum", "<u4")])


# ---- token ids


class ByteTokenizer:
    """The tokenizer's ids of whole texts as little-endian uint32 bytes; a piece that repeats in a block is encoded once.

    The tokenizer never joins a character to white space that follows it, nor a letter to a mark. So texts are cut
    at spaces and line feeds after something that is no white space, and at MARKS after a-z; their ids are those of
    the pieces in order. Texts with the marks of special tokens stay whole. Pieces are found in the block's bytes
    and told apart by Arrow; those of one space or line feed and plain characters go to the tokenizer in long runs,
    where only their first tokens begin with that character, all others one by one.
    """

    MARKS = b".,;:!?*$%&#|"
    TOGETHER = 4000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.begins = np.array([t[:1] in ("\u0120", "\u010a") for t in names])  # a space or line feed in the byte alphabet
        self.gap, self.mark, self.letter, self.blank = (np.zeros(256, bool) for _ in range(4))
        self.gap[[0x20, 0x0A]] = self.mark[list(self.MARKS)] = self.letter[65:91] = self.letter[97:123] = True
        self.blank[[0x20, *range(0x09, 0x0E)]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Where pieces begin, the texts' own beginnings included; not within texts that stay whole."""
        n = len(data)
        cut = np.zeros(n, bool)
        solid = (data > 0x20) & (data < 0x7F)
        # Two- and three-byte white space begins with C2 or E1 to E3: after such a character there is no cut.
        wide = data >= 0x80
        wide[1:] &= data[:-1] != 0xC2
        wide[2:] &= (data[:-2] < 0xE1) | (data[:-2] > 0xE3)
        solid |= wide
        cut[1:] = self.gap[data[1:]] & solid[:-1] | self.mark[data[1:]] & self.letter[data[:-1]]
        for t in np.flatnonzero(whole).tolist():
            cut[at[t] : at[t + 1]] = False
        cut[at[:-1][at[:-1] < at[1:]]] = True
        return np.flatnonzero(cut)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' ids in one array, and where each one's begin there and how many they are."""
        data, at = common.utf8(pieces)
        n = len(pieces)
        data, at = data[at[0] : at[-1]], at - at[0]
        blanks = np.concatenate([[0], np.cumsum(self.blank[data])])
        simple = self.gap[data[at[:-1]]] & (blanks[at[1:]] - blanks[at[:-1]] == 1) & (at[1:] - at[:-1] > 1)
        runs = np.flatnonzero(simple)
        ids, length, order = [], [], []
        alone = np.flatnonzero(~simple).tolist()
        joined_data, joined = common.utf8(pieces.take(pa.array(runs)))
        for i in range(0, len(runs), self.TOGETHER):
            part = joined[i : i + self.TOGETHER + 1]
            got = self._ids([joined_data[part[0] : part[-1]].tobytes().decode()])[0]
            starts = np.flatnonzero(self.begins[got])
            if len(starts) == len(part) - 1:
                ids.append(got)
                length.append(np.diff(np.append(starts, len(got))))
                order.append(runs[i : i + self.TOGETHER])
            else:
                alone += runs[i : i + self.TOGETHER].tolist()
        for k, got in zip(alone, self._ids(pieces.take(pa.array(alone, pa.int64())).to_pylist())):
            ids.append(got)
            length.append([len(got)])
            order.append([k])
        length, order = np.concatenate(length).astype(np.int64), np.concatenate(order)
        begin, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        size[order] = length
        begin[order] = np.cumsum(length) - length
        return np.concatenate(ids), begin, size

    def encode(self, texts: pa.Array) -> list[bytes]:
        """texts: a string array; null counts as empty."""
        import pyarrow.compute as pc

        data, at = common.utf8(texts)
        data, at = data[at[0] : at[-1]], at - at[0]
        if not len(data):
            return [b""] * len(texts)
        cuts = self._cuts(data, at, pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False))
        offsets = pa.py_buffer(np.append(cuts, len(data)).astype(np.int64))
        pieces = pa.LargeStringArray.from_buffers(len(cuts), offsets, pa.py_buffer(data)).dictionary_encode()
        which = pieces.indices.to_numpy()
        ids, begin, size = self._learn(pieces.dictionary)
        length = size[which]
        ends = np.cumsum(length)
        out = ids[np.repeat(begin[which] - (ends - length), length) + np.arange(ends[-1])]
        first = np.concatenate([[0], ends])[np.searchsorted(cuts, at)]
        return [out[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


_tokenizers: dict[str, ByteTokenizer] = {}


def tokenizer_at(path: str) -> ByteTokenizer:
    """One per Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def in_order(docs: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(doc_id long, text) in ascending doc_id: the partitions are ranges of it, of about file_bytes of text each.

    A null text becomes empty. Null ids come first; rows that share an id are ordered by their text's hash, and
    equal rows may lie in several ranges, so that no id has to fit into one task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    keys = ("doc_id", "tie", "nth")
    dealt = rows.withColumn("tie", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-total // file_bytes)), *keys)
    return dealt.sortWithinPartitions(*keys).select("doc_id", "text")


def encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and text to ones of doc_id and ids, END_ID last; about TEXT_BYTES of text at a time."""
    tokenizer, end = tokenizer_at(tokenizer_path), np.array([END_ID], "<u4").tobytes()
    for table in blocks(batches):
        ids = tokenizer.encode(table.column("text"))
        yield pa.RecordBatch.from_arrays([table.column("doc_id"), pa.array([i + end for i in ids], pa.large_binary())], names=["doc_id", "ids"])


def blocks(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows in batches of whole texts of about size bytes together; smaller batches are joined, larger ones cut."""
    size, held, n = size or TEXT_BYTES, [], 0
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").cast(pa.large_string())], names=["doc_id", "text"])
        _, at = common.utf8(batch.column("text"))
        first = 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(at, at[first] + size - n, "right")) - 1)
            held.append(batch.slice(first, last - first))
            n += int(at[last] - at[first])
            if n >= size or last < len(batch):
                yield pa.concat_batches(held)
                held, n = [], 0
            first = last
    if held:
        yield pa.concat_batches(held)


# ---- one file


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def _checksum(content) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FileWriter:
    """Writes documents one by one to an open binary file; `close` adds the index and the seek table."""

    def __init__(self, sink, level: int = LEVEL, frame_ids: int = FRAME_IDS):
        self.sink, self.step = sink, 4 * frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids) -> None:
        """A document's ids, as a buffer of little-endian uint32."""
        ids = memoryview(ids)
        for a in range(0, len(ids), self.step):
            content = ids[a : a + self.step]
            frame = self.packer.compress(content)
            self.frames.append((len(frame), len(content), _checksum(content)))
            self.sink.write(frame)
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)

    def close(self) -> None:
        null = np.array([i is None for i in self.ids], np.uint8)
        docs = np.array([0 if i is None else i for i in self.ids], "<i8")
        index = _skippable(INDEX_MAGIC, self.packer.compress(docs.tobytes() + null.tobytes() + np.array(self.lengths, "<i8").tobytes()))
        self.sink.write(index)
        table = np.array([*self.frames, (len(index), 0, _checksum(b""))], _ENTRY)
        self.sink.write(_skippable(TABLE_MAGIC, table.tobytes() + struct.pack("<IBI", len(table), CHECKSUMS, SEEKABLE_MAGIC)))


class DamagedFile(ValueError):
    pass


class FileReader:
    """Reads chosen documents of an open file with seek and read; `unpacked` counts the frames that were decompressed."""

    def __init__(self, source, size: int, frame_ids: int = FRAME_IDS):
        self.source, self.unpacked = source, 0
        self.unpacker = zstandard.ZstdDecompressor()
        if size < 26:
            raise DamagedFile("too short for a seek table")
        n, descriptor, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        start = size - 17 - 12 * n
        if magic != SEEKABLE_MAGIC or descriptor != CHECKSUMS or start < 0 or struct.unpack("<II", self._bytes(start, 8)) != (TABLE_MAGIC, 12 * n + 9):
            raise DamagedFile("no seek table at the end")
        table = np.frombuffer(self._bytes(start + 8, 12 * n), _ENTRY)
        self.frames, self.at = table[:-1], np.concatenate([[0], np.cumsum(table["size"].astype(np.int64))])
        if self.at[-1] != start:
            raise DamagedFile("the seek table does not fit the frames")
        raw = self.unpacker.decompress(self._bytes(int(self.at[-2]) + 8, int(table["size"][-1]) - 8))
        m = len(raw) // 17
        self.doc_ids, self.null = np.frombuffer(raw, "<i8", m), np.frombuffer(raw, np.uint8, m, 8 * m).astype(bool)
        self.lengths = np.frombuffer(raw, "<i8", m, 9 * m)
        of = -(-self.lengths // frame_ids)
        self.first = np.concatenate([[0], np.cumsum(of)]).astype(np.int64)
        if self.first[-1] != len(self.frames):
            raise DamagedFile("the index does not fit the frames")

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        got = self.source.read(n)
        if len(got) != n:
            raise DamagedFile("the file ends early")
        return got

    def runs(self, chosen: np.ndarray, size: int = common.BLOCK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """(documents' numbers, their ids) for the chosen numbers, ascending; neighbours are read together, about size bytes at a time."""
        i = 0
        while i < len(chosen):
            j = i + 1
            begin = self.at[self.first[chosen[i]]]
            while j < len(chosen) and chosen[j] == chosen[j - 1] + 1 and self.at[self.first[chosen[j] + 1]] - begin <= size:
                j += 1
            raw = self._bytes(int(begin), int(self.at[self.first[chosen[j - 1] + 1]] - begin))
            yield chosen[i:j], [self._document(int(d), raw, int(begin)) for d in chosen[i:j]]
            i = j

    def _document(self, number: int, raw: bytes, begin: int) -> bytes:
        out = []
        for f in range(self.first[number], self.first[number + 1]):
            try:
                content = self.unpacker.decompress(memoryview(raw)[self.at[f] - begin : self.at[f + 1] - begin])
            except zstandard.ZstdError as e:
                raise DamagedFile(f"frame {f}: {e}") from e
            if len(content) != self.frames["content"][f] or _checksum(content) != self.frames["checksum"][f]:
                raise DamagedFile(f"frame {f}: checksum")
            self.unpacked += 1
            out.append(content)
        return out[0] if len(out) == 1 else b"".join(out)


# ---- a folder of files, as a data source


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    where = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str | None
    n_docs: int = 0
    n_ids: int = 0
    least: int | None = None
    most: int | None = None
    nulls: int = 0


class TokenWriter(DataSourceArrowWriter):
    def __init__(self, path: str, level: int, tokenizer: str | None, overwrite: bool):
        self.path, self.level, self.tokenizer, self.overwrite = path, level, tokenizer, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        where, folder = _folder(self.path)
        said = Written(task.partitionId(), None)
        name = f"ids-{task.partitionId():06d}-{uuid.uuid4().hex}.zst"
        sink = writer = None
        for batch in encoded(iterator, self.tokenizer) if self.tokenizer else iterator:
            if not len(batch):
                continue
            if writer is None:
                where.create_dir(folder, recursive=True)
                sink = where.open_output_stream(f"{folder}/{name}", compression=None)  # else pyarrow packs .zst files once more
                writer, said.name = FileWriter(sink, self.level), name
            ids = batch.column("ids")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                writer.add(doc_id, ids[i].as_buffer() if ids[i].is_valid else b"")
                if doc_id is None:
                    said.nulls += 1
                else:
                    said.least = doc_id if said.least is None else min(said.least, doc_id)
                    said.most = doc_id if said.most is None else max(said.most, doc_id)
        if writer is not None:
            writer.close()
            sink.close()
            said.n_docs, said.n_ids = len(writer.ids), sum(writer.lengths)
        return said

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest: committed files in the order of their partitions, each with the ids before it. One line's worth for each file."""
        where, folder = _folder(self.path)
        where.create_dir(folder, recursive=True)
        known = [] if self.overwrite else manifest(self.path)
        before = sum(f["n_ids"] for f in known)
        for m in sorted((m for m in messages if m is not None and m.name), key=lambda m: m.partition):
            known.append({"name": m.name, "start": before, "n_docs": m.n_docs, "n_ids": m.n_ids, "least": m.least, "most": m.most, "nulls": m.nulls})
            before += m.n_ids
        draft = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with where.open_output_stream(draft) as out:
            out.write(json.dumps(known).encode())
        where.move(draft, f"{folder}/{MANIFEST}")  # readers see the old list or the new one

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = _folder(self.path)
        for m in messages:
            if m is not None and m.name:
                where.delete_file(f"{folder}/{m.name}")


def manifest(path: str) -> list[dict]:
    """The files that count; none where nothing has been committed."""
    where, folder = _folder(path)
    if where.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.File:
        return []
    with where.open_input_stream(f"{folder}/{MANIFEST}") as source:
        return json.loads(source.read())


class OneFile(InputPartition):
    def __init__(self, entry: dict | None):
        super().__init__(entry and entry["name"])
        self.entry = entry


class TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.low, self.high, self.among, self.real = None, None, None, False

    def _chosen(self, ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        take = ~null if self.real else np.ones(len(ids), bool)
        if self.low is not None:
            take &= ids >= self.low
        if self.high is not None:
            take &= ids <= self.high
        if self.among is not None:
            take &= np.isin(ids, [i for i in self.among if i is not None])
        return np.flatnonzero(take)

    def partitions(self) -> list[OneFile]:
        out = []
        for f in manifest(self.path):
            if self.real:
                if f["least"] is None or (self.low is not None and f["most"] < self.low) or (self.high is not None and f["least"] > self.high):
                    continue
                if self.among is not None and not any(i is not None and f["least"] <= i <= f["most"] for i in self.among):
                    continue
            out.append(OneFile(f))
        return out or [OneFile(None)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition.entry is None:
            return
        where, folder = _folder(self.path)
        with where.open_input_file(f"{folder}/{partition.entry['name']}") as source:
            reader = FileReader(source, source.size())
            starts = partition.entry["start"] + np.concatenate([[0], np.cumsum(reader.lengths)]).astype(np.int64)
            for numbers, ids in reader.runs(self._chosen(reader.doc_ids, reader.null)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids[numbers], mask=reader.null[numbers]), pa.array(starts[numbers]), pa.array(reader.lengths[numbers]), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )


class ChoosingReader(TokenReader):
    """For sessions that push filters into Python's data sources; others refuse a reader that could take them."""

    def pushFilters(self, filters):
        """Conditions on doc_id choose files and frames; all other ones stay with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("doc_id",):
                yield f
                continue
            if isinstance(f, EqualTo):
                self.among = {f.value} if self.among is None else self.among & {f.value}
            elif isinstance(f, In):
                self.among = set(f.value) if self.among is None else self.among & set(f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                at = f.value + isinstance(f, GreaterThan)
                self.low = at if self.low is None else max(self.low, at)
            elif isinstance(f, LessThan | LessThanOrEqual):
                at = f.value - isinstance(f, LessThan)
                self.high = at if self.high is None else min(self.high, at)
            elif not isinstance(f, IsNotNull):
                yield f
                continue
            self.real = True


class TokenFiles(DataSource):
    """Writes doc_id and ids, or doc_id and text where a tokenizer is named; reads SCHEMA.

    Options: path, level (of compression) and tokenizer (its file) for writing, choosing (take filters) for reading.
    """

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return (ChoosingReader if self.options.get("choosing") == "true" else TokenReader)(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], int(self.options.get("level", LEVEL)), self.options.get("tokenizer"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenFiles)


def write(docs: DataFrame, tokenizer_path: str, path: str, file_bytes: int = FILE_BYTES, level: int = LEVEL) -> None:
    """Encode every whole text and write the ids with END_ID after each document, in ascending doc_id, to token files at path.

    Takes doc_id and text; other columns are left out. An empty table gives a manifest of no files.
    """
    register(docs.sparkSession)
    common.bound_batches(docs.sparkSession)
    in_order(docs, file_bytes).write.format("token_files").option("level", level).option("tokenizer", tokenizer_path).mode("overwrite").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents at path; start counts the ids of all documents before it.

    With spark.sql.python.filterPushdown.enabled, conditions on doc_id decompress the documents they name only.
    """
    register(spark)
    choosing = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower()
    return spark.read.format("token_files").option("choosing", choosing).load(path)
