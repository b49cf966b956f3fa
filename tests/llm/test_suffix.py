import random

import numpy as np
import pytest

from offerlens.llm import suffix


def brute(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        b = (t or "").encode()
        gone, own = bytearray(len(b)), []
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                own.append(p)
            seen.add(s)
        for p in own:
            gone[p : p + length] = b"\1" * length
        spans = [p for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])]
        out[i] = (len(b), len(spans), bytes(c for c, x in zip(b, gone) if not x))
    return out


def corpus():
    r = random.Random(2)
    passages = ["".join(r.choice("abcdefghij éü") for _ in range(r.choice([60, 99, 100, 101, 130, 300]))) for _ in range(20)]
    rows = []
    for i in range(120):
        parts = [r.choice(passages) if r.random() < 0.5 else "".join(r.choice("abcdefgh ") for _ in range(r.randrange(200))) for _ in range(r.randrange(9))]
        rows.append((2 * i + 1, "".join(parts)))
    return rows + [(5000, None), (5001, ""), (5002, "a" * 500), (5003, "ab" * 400), (5004, "a" * 99), (5005, "a" * 100), (5006, rows[3][1]), (5007, rows[3][1] + "x"), (None, "z" * 150)]


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_against_brute_force(spark, hot):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix.without_repeats(df, hot=hot).collect()}
    assert got == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert suffix.without_repeats(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(1, "q" * 40 + "w" * 160)] * 3, schema)
    kept = {bytes(r.kept) for r in suffix.without_repeats(same).collect()}
    assert len(kept) == 1


def test_documents_that_share_an_id(spark):
    """Null and repeated ids: each text by itself, in the order of ids and of its number."""
    r = random.Random(4)
    a, b, c = ("".join(r.choice("abcdefgh") for _ in range(343)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (None, c), (None, "q" * 30 + c), (3, b + "tail"), (4, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(x.doc_id, x.n_bytes, x.kept.decode()) for x in suffix.without_repeats(df).collect()}
    first = {(None, 343, c), (None, 373, "q" * 30)}, {(None, 343, ""), (None, 373, "q" * 30 + c)}
    rest = {(1, 343, a), (2, 343, ""), (2, 343, b), (3, 347, "tail"), (4, 343, "")}
    assert got in [rest | x for x in first]


def test_windows_must_fit(spark):
    with pytest.raises(ValueError):
        suffix.without_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=400, gram=32)


def test_bucket_pointers_tell_prefixes_apart():
    r = random.Random(1)
    data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(3000)), np.uint8)
    for depth in (8, 12, 40, 100):
        p = suffix.buckets(data, depth)
        groups = {}
        for i in range(len(data) - depth + 1):
            groups.setdefault(data[i : i + depth].tobytes(), set()).add(int(p[i]))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_text_in_slices(monkeypatch):
    monkeypatch.setattr(suffix, "SLICE", 500)
    data = np.frombuffer(random.Random(3).randbytes(4000), np.uint8)
    text, start, count, _, _ = suffix._joined(data, np.array([0, 4000]), 100, 32)
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(start, count)])
    assert sorted(covered.tolist()) == list(range(3901))


def test_cut_characters_go(spark):
    df = spark.createDataFrame([(1, bytearray("aé".encode()[:2]))], "doc_id long, kept binary")
    assert suffix.as_text(df, ("doc_id",)).first().text == "a"
