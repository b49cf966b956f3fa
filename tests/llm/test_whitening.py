import math

import numpy as np

from offerlens.llm import registry, whitening


def exact(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r] for r in rows], np.int64)
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    return x, n, s, z, e[::-1], u[:, ::-1]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string")


def agree(spark, vectors, **options):
    kept = [np.float32(v).astype(float).tolist() for v in vectors]
    x, n, s, z, e, u = exact(kept)
    df = table(spark, [(i, v, "x") for i, v in enumerate(kept)]).repartition(3)
    model = whitening.fit(df, **options)
    got = {r["vec_id"]: r for r in whitening.whiten(df, model).collect()}
    k = len(model.values)
    assert len(got) == n and np.allclose(model.values, e[:k], rtol=1e-9) and model.identity_error < 1e-8
    assert np.allclose(model.explained, e[:k] / e.sum(), rtol=1e-9)
    want = z @ (u[:, :k] / np.sqrt(e[:k]))
    have = np.array([got[i]["whitened"] for i in range(n)])
    sign = np.sign((want * have).sum(axis=0))
    assert np.abs(have - want * sign).max() < 1e-7
    assert [int(got[i]["deviation"]) for i in range(n)] == [sum(int(v) ** 2 for v in r) for r in (n * x - s).tolist()]
    return model


def test_flat_spectrum_grows_to_full_dimension(spark):
    r = np.random.default_rng(1)
    model = agree(spark, r.standard_normal((400, 60)))
    assert model.expanded and model.passes == whitening.PASSES + 2


def test_steep_spectrum_stays_in_the_range_found(spark):
    r = np.random.default_rng(2)
    scale = 2.0 ** -np.arange(80) * 500
    scale[40:] = 0
    model = agree(spark, r.standard_normal((300, 80)) * np.maximum(scale, 0.0), components=8, oversample=6, passes=8)
    assert not model.expanded and len(model.values) == 8


def test_few_rows_give_fewer_components(spark):
    r = np.random.default_rng(3)
    assert len(agree(spark, r.standard_normal((5, 12))).values) == 4


def test_odd_rows(spark):
    good = [[float(i), 1.0, -float(i % 3)] for i in range(9)]
    rows = [(i, v, "x") for i, v in enumerate(good)]
    odd = [(90, None, ""), (91, [], ""), (92, [1.0, None, 2.0], ""), (93, [float("nan"), 1.0, 1.0], ""), (94, [float("inf"), 1.0, 1.0], ""), (95, [1.0, 2.0], ""), (None, [3.0, 1.0, 0.0], None), (3, good[3], "again")]
    df = table(spark, rows + odd)
    model = whitening.fit(df)
    assert model.n == 11 and len(model.values) == 2
    got = whitening.whiten(df, model).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted([str(i) for i in range(9)] + ["None", "3"])
    assert all(len(r["whitened"]) == 2 for r in got)


def test_huge_entries_stay_exact(spark):
    rows = [[3e15, 1.0], [-3e15, 2.0], [5.0, 3.0]]
    x, n, s, *_ = exact([np.float32(v).astype(float).tolist() for v in rows])
    df = table(spark, [(i, v, None) for i, v in enumerate(rows)])
    model = whitening.fit(df)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df, model).collect()}
    for i in range(3):
        assert int(got[i]) == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i].tolist(), np.array([sum(int(v) for v in c) for c in x.T.tolist()], object)))


def test_constant_and_empty_tables(spark):
    df = table(spark, [(i, [1.0, 2.0], "") for i in range(4)])
    model = whitening.fit(df)
    assert model.n == 4 and len(model.values) == 0 and model.identity_error == 0.0
    assert [int(r["deviation"]) for r in whitening.whiten(df, model).collect()] == [0] * 4
    empty = table(spark, [])
    model = whitening.fit(empty)
    assert model.n == 0 and whitening.whiten(empty, model).count() == 0


def test_registered_query(spark, tmp_path):
    r = np.random.default_rng(4)
    vectors = np.float32(r.standard_normal((50, 40))).astype(float).tolist()
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)] + [(99, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = registry.op11_embedding_whitening(spark, str(tmp_path))
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = df.collect()
    x, n, s, z, e, u = exact(vectors)
    assert len(rows) == 50 * 32 and {r["component"] for r in rows} == set(range(1, 33)) and {r["n"] for r in rows} == {50}
    for c in (1, 17, 32):
        of = {r["vec_id"]: r for r in rows if r["component"] == c}
        want = z @ u[:, c - 1] / math.sqrt(e[c - 1])
        have = np.array([of[i]["whitened"] for i in range(50)])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert abs(of[0]["explained"] - e[c - 1] / e.sum()) < 1e-9
