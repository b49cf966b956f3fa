from itertools import permutations

from offerlens.llm import filter_audit, registry

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau phi".split()


def brute(docs, labels):
    """Counts by walking every order over every document."""
    first = {}
    for i, t, _ in docs:
        key = -(1 << 63) if i is None else i
        first[t or ""] = min(first.get(t or "", key), key)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    seen = []
    for i, t, part in docs:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").split(" ") if x]
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            fails.add("C")
        if any(c in "#$%&*|" for c in t):
            fails.add("D")
        if (-(1 << 63) if i is None else i) > first[t]:
            fails.add("E")
        seen.append((part or "", fails, i in good, i in bad))
    out = {}
    for part in {s[0] for s in seen}:
        rows, removed_by = {}, dict.fromkeys("ABCDE", 0)
        mine = [s for s in seen if s[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [s for s in left if f in s[1]]
                left = [s for s in left if f not in s[1]]
                fails = sum(f in s[1] for s in mine)
                removed_by[f] += len(gone)
                rows["".join(order), k + 1] = (f, len(left), len(gone), fails - len(gone), sum(s[1] == {f} for s in mine), sum(s[2] for s in gone), sum(s[3] for s in gone))
        out |= {(part, *k): (*v[1:], removed_by[v[0]]) for k, v in rows.items()}
    return out


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in df.collect()}


def cases():
    long = " ".join(f"{w}{i}" for i in range(12) for w in WORDS)
    texts = [None, "", "short", long, long, long + " #", "BIG " * 300, " ".join(WORDS * 15), long + " A" * 400, "short", "\t\n  ", long + " $ " + "X" * 2000, long + "\n\n", "$" * 100, "é" * 50 + "A"]
    docs = [(i * 3 % 17, t, [None, "en", "de", ""][i % 4]) for i, t in enumerate(texts)]
    docs += [(None, "short", "en"), (None, None, "en"), (4, long, "en"), (4, long, "en"), (900, long, "de")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 17)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (900, None, None)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = cases()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, quality int")
    got = filter_audit.audit(df, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string"))
    want = brute(docs, labels)
    assert rows_of(got) == want and len(want) == 600 * 3


def test_many_copies(spark):
    docs = [(i, "same text" if i % 3 else f"text {i}", "en" if i % 5 else "fr") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert rows_of(filter_audit.audit(df, spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"))) == brute(docs, [(1, 1, 1), (2, 1, 0)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_very_long_text(spark):
    docs = [(1, "word " * 400_000, "en"), (2, "W" * 1_000_000, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert rows_of(filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == brute(docs, [])


def test_registered_query_equals_its_sql(spark, tmp_path):
    import duckdb

    docs, labels = cases()
    docs = [d for d in docs if d[0] is not None]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = registry.op12_filter_audit(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    found = con.execute(registry.oracle_sql()["op12_filter_audit"])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(found.fetchall()) == sorted(tuple(r[c] for c in names) for r in df.collect())
