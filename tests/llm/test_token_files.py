import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from offerlens.llm import registry, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a  b", "a   b\n\n c", "x\n", "\n \n", "it's  we'll 12,345 \xa0 x", "<|endoftext|> hi", "a\x1cb .\x1c.", "Σας İx", "tab\tand\r\nline", " lead", "trail ", "é ́x　y\x85z", "\x00 a", "a.\n'Tis", "word" * 3000,
    "- - -", "$5.00 %%", "  x ", "x \n y", "a​b ​ c", "﻿bom", "日本 語 の",
]


def plain(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for x in texts]


def test_ids_equal_the_tokenizers(monkeypatch):
    r = random.Random(3)
    marks = [" ", "  ", "\n", "\t", "'s", "'", ".", "a", "Be", "7", "é", "\xa0", "\u3000", "\u2028", "\x85", "\x1f", "word", "-", "…", ",", "$$", "語"]
    texts = [None, *ODD] + ["".join(r.choice(marks) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    want = [w[:-4] for w in plain(texts)]
    own = token_files.ByteTokenizer(PATH)
    assert own.encode(pa.array(texts)) == want
    assert own.encode(pa.array(["x", *texts]).slice(1)) == want
    monkeypatch.setattr(own, "begins", ~own.begins)  # runs that can't be told apart are encoded piece by piece
    assert own.encode(pa.array(texts[:200])) == want[:200]
    assert own.encode(pa.array([], pa.string())) == [] and own.encode(pa.array([None, ""], pa.string())) == [b"", b""]


def test_blocks_hold_all_rows_in_order():
    texts = ["a" * n for n in (3, 0, 50, 1, 1, 1, 9, 200, 0, 4)] + [None]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for size in (1, 10, 60, 10**6):
        for cut in (1, 4, 11):
            got = list(token_files.blocks((rows.slice(i, cut) for i in range(0, len(texts), cut)), size))
            assert [i for b in got for i in b.column("doc_id").to_pylist()] == list(range(len(texts)))
            assert [t for b in got for t in b.column("text").to_pylist()] == texts
            assert all(sum(len(t or "") for t in b.column("text").to_pylist()[:-1]) <= size for b in got)


def file_of(documents, frame_ids=token_files.FRAME_IDS):
    out = io.BytesIO()
    w = token_files.FileWriter(out, frame_ids=frame_ids)
    for i, ids in documents:
        w.add(i, np.array(ids, "<u4").tobytes())
    w.close()
    return out.getvalue()


def test_only_requested_documents_are_decompressed():
    documents = [(None, [0]), (3, list(range(1000))), (5, [7] * 25), (5, [8, 0]), (9, list(range(40)))]
    raw = file_of(documents, frame_ids=10)
    r = token_files.FileReader(io.BytesIO(raw), len(raw), frame_ids=10)
    assert r.null.tolist() == [True, False, False, False, False] and r.lengths.tolist() == [1, 1000, 25, 2, 40]
    got = [(n.tolist(), [np.frombuffer(b, "<u4").tolist() for b in ids]) for n, ids in r.runs(np.array([2, 4]))]
    assert got == [([2], [[7] * 25]), ([4], [list(range(40))])] and r.unpacked == 3 + 4
    whole = [np.frombuffer(b, "<u4").tolist() for _, ids in r.runs(np.arange(5), size=30) for b in ids]
    assert whole == [d for _, d in documents]


def test_any_decoder_reads_the_file():
    raw = file_of([(1, [1, 2, 0]), (2, [0]), (7, list(range(50000)))])
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as s:
        assert np.frombuffer(s.read(), "<u4").tolist() == [1, 2, 0, 0, *range(50000)]


def test_damage_is_found():
    raw = file_of([(1, list(range(3000))), (2, [5, 0])])
    for at in (40, 2000):
        bad = bytearray(raw)
        bad[at] ^= 1
        r = token_files.FileReader(io.BytesIO(bytes(bad)), len(bad))
        with pytest.raises(token_files.DamagedFile):
            list(r.runs(np.arange(2)))
        assert [b for _, ids in r.runs(np.array([1])) for b in ids] == [np.array([5, 0], "<u4").tobytes()]
    for bad in (raw[:-1], raw[:20], raw[:-200] + b"\0" * 200):
        with pytest.raises(token_files.DamagedFile):
            token_files.FileReader(io.BytesIO(bad), len(bad))
    table = bytearray(raw)
    table[-9 - 3 * 12 + 8] ^= 1  # the first frame's checksum
    with pytest.raises(token_files.DamagedFile):
        list(token_files.FileReader(io.BytesIO(bytes(table)), len(table)).runs(np.array([0])))


def corpus():
    r = random.Random(8)
    texts = [None, *ODD] + [" ".join(r.choice(["red", "blue", "offer", "zq."]) for _ in range(r.randrange(1, 900))) for _ in range(120)]
    ids = list(range(-20, len(texts) - 20))
    r.shuffle(ids)
    return list(zip(ids, texts))


def expected(rows):
    start, out = 0, []
    for (i, _), b in sorted(zip(rows, plain([t for _, t in rows])), key=lambda e: e[0][0]):
        out.append((i, start, len(b) // 4, zlib.crc32(b)))
        start += len(b) // 4
    return out


def test_many_files_in_order_and_back(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, ids int, start int").repartition(5)
    token_files.write(df, PATH, f"{tmp_path}/t", file_bytes=20_000)
    files = token_files.manifest(f"{tmp_path}/t")
    assert len(files) > 3 and all(a["most"] < b["least"] for a, b in zip(files, files[1:]))
    got = token_files.read(spark, f"{tmp_path}/t").select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got)) == expected(rows)
    open(f"{tmp_path}/t/ids-000000-lost.zst", "wb").write(b"half a file")  # of a task that died
    assert token_files.read(spark, f"{tmp_path}/t").count() == len(rows)


def test_filters_reach_the_frames(spark, tmp_path):
    rows = corpus()
    path = f"{tmp_path}/t"
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, path, file_bytes=20_000)
    names = [f["name"] for f in token_files.manifest(path) if not f["least"] <= 7 <= f["most"]]
    for n in names:  # files that can't hold the id aren't opened
        open(f"{path}/{n}", "wb").write(b"")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        of = {e[0]: e for e in expected(rows)}
        df = token_files.read(spark, path).where("doc_id = 7")
        assert [tuple(r) for r in df.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()] == [of[7]]
        token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, path, file_bytes=20_000)
        for condition in ("doc_id in (3, 4, 99999)", "doc_id > 10 and doc_id <= 14", "doc_id >= 10 and n_tokens > 100", "doc_id is null", "doc_id < -100", "doc_id <=> 5"):
            got = token_files.read(spark, path).where(condition).select("doc_id", "start", "n_tokens").collect()
            want = spark.createDataFrame(list(of.values()), "doc_id long, start long, n_tokens long, crc long").where(condition).select("doc_id", "start", "n_tokens").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want)), condition
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_null_ids_repeats_and_no_rows(spark, tmp_path):
    rows = [(None, "b"), (None, None), (4, "a b c"), (4, "a b c"), (4, "x"), (1, "q")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, f"{tmp_path}/t")
    got = token_files.read(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 4, 4, 4]
    assert sorted(bytes(r["ids"]) for r in got) == sorted(plain([t for _, t in rows]))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])])[:-1].tolist()
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH, f"{tmp_path}/t")  # overwrites
    assert token_files.read(spark, f"{tmp_path}/t").count() == 0


def test_a_very_long_text_spans_frames(spark, tmp_path):
    long = "word " * 1_200_000 + "x" * 300_000
    token_files.write(spark.createDataFrame([(1, long), (2, "a")], "doc_id long, text string"), PATH, f"{tmp_path}/t")
    got = {r["doc_id"]: r for r in token_files.read(spark, f"{tmp_path}/t").collect()}
    assert got[1]["n_tokens"] > token_files.FRAME_IDS and bytes(got[2]["ids"]) == plain(["a"])[0]
    assert Tokenizer.from_file(PATH).decode(np.frombuffer(got[1]["ids"], "<u4")[:-1].tolist()) == long


def test_registered_query(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.op13_token_files(spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, df.collect())) == expected(rows)
