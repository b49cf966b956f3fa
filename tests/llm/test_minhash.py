import hashlib
import random

from offerlens.llm import minhash


def test_edited_forms_against_brute_force(spark):
    r = random.Random(7)
    texts = [None, "", "é", "a b c d"] + [" ".join(r.choice("abcdefghijklmnop") + r.choice("qrstuvwéü") for _ in range(r.randrange(1, 400))) for _ in range(60)]
    ids = r.sample(range(-50, 1000), len(texts))
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    got = {x.doc_id: x for x in minhash.edited_fingerprints(df).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + follow[:n]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [set(zip(*(x.split()[j:] for j in range(5)))) or {tuple(x.split())} for x in (t, edited, follow)]
        if all(len(x.split()) >= 5 for x in (t, edited)):
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            assert abs(got[i].near_edited - true) < 0.25
    one = minhash.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert minhash.edited_fingerprints(df.filter("false")).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(1, "x y z " * 9), (2, "x y z " * 9), (3, None), (4, ""), (None, "q")], "doc_id long, text string")
    f = {x.doc_id: x.fingerprint for x in minhash.fingerprints(df).collect()}
    assert f[1] == f[2] and f[3] == f[4] and f[1] != f[3]
    assert len(f[1]) == 4 * minhash.PERMUTATIONS


def test_near_duplicate_classes(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 12):
        t = list(base)
        for _ in range(i // 2):
            t[r.randrange(200)] = "new" + str(r.random())
        rows.append((i, " ".join(t)))
    rows += [(100 + i, " ".join(f"v{r.randrange(5000)}" for _ in range(200))) for i in range(20)] + [(200, None), (201, rows[0][1])]
    from tests.llm.test_jaccard import brute

    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5, 80)


def test_signatures_against_plain_minhash():
    """Every permutation by itself in Python's integers, over the same shingle hashes."""
    import numpy as np

    from offerlens.llm import common

    texts = [b"one two three four five six seven", b"a b", b"", b"one two three four five six eight nine", "é ü ö a b c".encode()]
    data, at = np.frombuffer(b"".join(texts), np.uint8), minhash._edges(texts)
    starts, ends, doc = common.words_of(data, at)
    h, of = common.shingle_hashes(common.word_hashes(data, starts, ends), doc, len(texts), 5)
    got = minhash.signatures(data, at, 5, 16)
    a, b = minhash.coefficients(16)

    def mixed(x):
        for m in (int(common.MIX_1), int(common.MIX_2)):
            x = (x ^ x >> 33) * m & (1 << 64) - 1
        return x ^ x >> 33

    for i in range(len(texts)):
        mine = [int(x) for x, d in zip(h, of) if d == i]
        for k in range(16):
            want = mixed(min((int(a[k]) * x + int(b[k])) & (1 << 64) - 1 for x in mine)) >> 48 if mine else 0xFFFF
            assert got[i, k] == want


def test_recall_of_the_band_join(spark):
    """Of the pairs of texts at 80 percent and more, the share that the join brings into one class."""
    r = random.Random(11)
    rows = []
    for k in range(60):
        base = [f"w{r.randrange(9000)}" for _ in range(120)]
        t = list(base)
        for p in r.sample(range(0, 120, 6), r.randrange(1, 4)):
            t[p] = f"n{r.random()}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(t))]
    from tests.llm.test_jaccard import brute

    want = brute(rows, 5, 80)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [k for k in range(60) if want[2 * k + 1][1] == 2 * k]
    assert len(linked) > 40
    assert sum(got[2 * k] == got[2 * k + 1] for k in linked) >= 0.9 * len(linked)
    assert all(got[i] == i for i, (_, c) in want.items() if c == i)


def test_near_duplicates_of_empty_tables_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, text), (5, text), (6, text), (7, None), (7, "")]
    got = sorted((x.doc_id, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 7), (7, 7)]
