import random
import re
from collections import Counter

import numpy as np
import pytest

from offerlens.llm import language, quality, registry, sampling, toxicity
from pyspark.sql import functions as F

r = random.Random(6)
GOOD = ["the offer of the week holds in all stores", "fresh bread and milk are cheaper today", "we compare prices of many shops"]


def good(n=70):
    return " ".join(r.choice(GOOD).split()[r.randrange(4)] + str(r.randrange(400)) for _ in range(n))


def bad(n=70):
    return " ".join(r.choice(GOOD).split()[r.randrange(4)].upper() + "!!" + str(r.randrange(400)) for _ in range(n))


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) for j in range(3) if win[tuple(w[i : i + 3])] > 1}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_counts_and_verdicts(spark):
    odd = [None, "", " \n\t", "a b c a b c", "x\nx\n \n \nx", "é# ü|\x0bz\x1ca", "a a a a", "a b\n" * 60, "w " * 40000]
    docs = [(i, t) for i, t in enumerate(odd + [good() for _ in range(60)] + [bad() for _ in range(60)])]
    labels = [(i, int(i < len(odd) + 60), 0) for i, _ in docs if i >= len(odd)] + [(None, 1, 1), (3, None, 2)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, kept int")
    model = quality.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x.doc_id: x for x in quality.quality_rules(df, model).collect()}
    for i, t in docs:
        want = base(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, (i, want)
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    kept = [got[i].kept for i, _ in docs[len(odd) :]]
    assert all(kept[:60]) and not any(kept[60:])


def test_quality_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, good())], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(df, none) is None
    assert quality.quality_rules(df, None).first().kept
    assert quality.quality_rules(df.filter("false"), None).count() == 0


def test_toxicity_finds_marked_words(spark):
    texts = [good() for _ in range(200)]
    toxic = [i % 4 == 0 for i in range(200)]
    texts = [t.replace(" ", " grobword, ", 1) if x else t for t, x in zip(texts, toxic)]
    model = toxicity.fit_texts(texts[:150], np.array(toxic[:150]))
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts[150:] + [None, ""])], "doc_id long, text string, score double")
    got = {x.doc_id: x for x in toxicity.toxicity(df, model).collect()}
    assert [got[i].predicted for i in range(50)] == [int(x) for x in toxic[150:]]
    assert got[50].score == got[51].score < 0.5
    assert len(model.index) < 5000
    assert toxicity.fit_texts(texts[:5], np.zeros(5)) is None
    assert toxicity.toxicity(df, None).agg(F.max("score")).first()[0] == 0


def test_language_profiles(spark):
    words = {"en": "the and of with house water small", "de": "der und von mit haus wasser klein", "fr": "le et de avec maison eau petite"}
    docs = [(3 * i + k, " ".join(r.choice(words[lang].split()) for _ in range(60)), lang) for i in range(60) for k, lang in enumerate(words)]
    df = spark.createDataFrame(docs + [(9001, None, "en"), (9002, "12 + 34 !", "de"), (9003, "", None), (None, "the", "en")], "doc_id long, text string, lang string")
    model = language.fit(df, keep=F.col("doc_id") < 120)
    got = {x.doc_id: x for x in language.identify(df.drop("lang"), model).collect()}
    right = sum(got[i].lang_pred == lang for i, _, lang in docs)
    assert right == len(docs)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9001, 9002, 9003))
    assert all(0 <= x.score <= 1 for x in got.values())
    empty = language.fit(df.filter("false"))
    assert {x.lang_pred for x in language.identify(df, empty).collect()} == {"und"}


def test_profile_distance_by_hand():
    text = "ab ab a"
    g = Counter()
    s = " ab ab a "
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            x = s[i : i + n]
            if x.strip() and not (n == 3 and x[1] == " "):
                g[x] += 1
    code = lambda x: sum((language.BLANK if c == " " else ord(c)) << 21 * (len(x) - 1 - i) for i, c in enumerate(x))
    want = sorted(g, key=lambda x: (-g[x], code(x)))
    assert language.profile(text, 300).tolist() == [code(x) for x in want]


def test_held_out_accuracy_on_the_tables(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = registry.op2_language_id(spark, d).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    labels = spark.read.parquet(f"{d}/labels.parquet")
    tox = registry.op7_toxicity(spark, d).filter("held_out").join(labels, "doc_id")
    assert tox.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def test_long_texts_leave_room_for_others(spark):
    ids = spark.range(40).orderBy(F.xxhash64("id")).toPandas().id.tolist()
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, toxic int")
    # the first by hash is longer than all the bytes, the third than what is left of its label's half
    long = {ids[0]: 1001, ids[2]: 480, ids[4]: 30}
    docs = spark.createDataFrame([(i, "x" * long.get(i, 10)) for i in ids], "doc_id long, text string")
    got = sampling.labelled_sample(docs, labels, "toxic", 100, max_bytes=1000)
    assert ids[0] not in got.doc_id.tolist() and got.text.str.len().sum() <= 1000
    assert set(got.doc_id) == {*ids} - {ids[0]}
    tight = sampling.labelled_sample(docs, labels, "toxic", 100, max_bytes=100)
    assert tight.groupby("y").size().to_dict() == {0: 3, 1: 5}
    with pytest.raises(ValueError, match="toxic 1"):
        sampling.labelled_sample(docs.withColumn("text", F.when(F.col("doc_id").isin(ids[1::2]), F.repeat("text", F.lit(200))).otherwise(F.col("text"))), labels, "toxic", 100, max_bytes=1000)


def plain_profile(text, size):
    """Most frequent letter grams, by count and then by code points with the blank first."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    counts = Counter()
    line = [None, *[c for w in words for c in (*w, None)]] if words else []
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g != [None] and None not in g[1:-1]:
                counts[tuple("\x01" if c is None else c for c in g)] += 1
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:size]


def test_out_of_place_distance_against_brute_force(spark):
    q = random.Random(12)
    speech = {"aa": "the weekly offer of bread and milk in our shop".split(), "bb": "das angebot der woche für brot und käse im markt".split(), "cc": "le pain et le café à la crème dans la boutique".split()}
    rows = [(i, " ".join(q.choice(speech[lang]) for _ in range(q.randrange(1, 60))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, size=40)
    profiles = {k: plain_profile("\n".join(t for _, t, lang in rows if lang == k), 40) for k in speech}
    for k, lang in enumerate(model.languages):
        assert len(profiles[lang]) == (model.ranks[:, k] < 40).sum()
    odd = [None, "", "123 !", "the", "brot käse brot", "le le le café", "x" * 30000 + " the offer", "the das le"]
    tests = [(i, t) for i, t in enumerate(odd)] + [(3, "the")]
    got = language.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()
    assert len(got) == len(tests) and language.identify(df.filter("false"), model).count() == 0
    by = {x.doc_id: (x.lang_pred, x.score) for x in got}
    for i, t in tests:
        top = plain_profile(t or "", 40)
        if not top:
            assert by[i] == ("und", 0.0)
            continue
        far = {k: sum(abs(n - p.index(g)) if g in p else 40 for n, g in enumerate(top)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert by[i][0] == best and abs(by[i][1] - (1 - far[best] / (40 * len(top)))) < 1e-12, (t, far)


def test_character_grams_stay_within_characters():
    """The same text has the same features whatever stands beside it, and letters of several bytes count as one."""
    texts = ["käse über", "x", "", "日本語のテキスト", "plain words here"]
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    together = quality.features(np.frombuffer(b"".join(raw), np.uint8), at)
    for i, b in enumerate(raw):
        alone = quality.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        for (g, of), (h, _) in zip(together, alone):
            assert sorted(g[of == i].tolist()) == sorted(h.tolist()), texts[i]
        for k, f in ((3, 2), (5, 3)):
            assert len(alone[f][0]) == max(0, len(texts[i]) - k + 1)


def test_calibration_follows_the_shares():
    q = np.random.default_rng(1)
    y = np.array([0, 1] * 400)
    s = np.where(y == 1, 1.0, -1.0) + q.normal(0, 1.5, 800)
    even = quality._platt(s, y, np.ones(800))
    rare = quality._platt(s, y, np.where(y == 1, 1.8, 0.2))
    mean = lambda ab, w: float((w / (1 + np.exp(-(ab[0] * s + ab[1])))).sum() / w.sum())
    assert abs(mean(even, np.ones(800)) - 0.5) < 0.02 and abs(mean(rare, np.where(y == 1, 1.8, 0.2)) - 0.9) < 0.02


def test_ftrl_against_the_plain_update():
    """The update of each coordinate by the published formulas, in dictionaries."""
    import math

    texts, y = [good(12) for _ in range(40)], [int(i % 3 == 0) for i in range(40)]
    texts = [t + " vilegrob" if k else t for t, k in zip(texts, y)]
    model = toxicity.fit_texts(texts, np.array(y), epochs=2)
    rows = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        rows.append(sorted(set(toxicity.features(raw, np.array([0, len(raw)]))[0].tolist())))
    z, n, rng = Counter(), Counter(), np.random.default_rng(7)
    bias = "bias"

    def weight(k):
        l1 = 0.0 if k == bias else toxicity.L1
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + (0.0 if k == bias else toxicity.L2))

    for _ in range(2):
        for i in rng.permutation(40):
            w = {k: weight(k) for k in [*rows[i], bias]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for k in w:
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA
                z[k] += g - sigma * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in n if k != bias and weight(k)}
    assert set(model.index.tolist()) == set(want) and want
    assert all(abs(v - want[k]) < 1e-5 for k, v in zip(model.index.tolist(), model.values.tolist())) and abs(model.bias - weight(bias)) < 1e-9


def test_toxicity_of_empty_tables_repeats_and_long_texts(spark):
    texts = [good() for _ in range(60)]
    model = toxicity.fit_texts([t + " vilegrob" if i % 2 else t for i, t in enumerate(texts)], np.arange(60) % 2)
    long = ("clean words " * 40_000) + "vilegrob"
    df = spark.createDataFrame([(1, "a vilegrob", 1), (1, "a vilegrob", 1), (2, long, 1), (3, None, 1), (None, "", 1)], "doc_id long, text string, score int")
    got = [(x.doc_id, x.predicted, x.score) for x in toxicity.toxicity(df, model).collect()]
    assert len(got) == 5 and sorted(p for i, p, _ in got if i == 1) == [1, 1] and len({s for i, _, s in got if i in (3, None)}) == 1
    assert [p for i, p, _ in got if i == 2] == [1]
    assert toxicity.toxicity(df.filter("false"), model).count() == 0
