import random
import re

import numpy as np
import pytest

from offerlens.llm import common, jaccard, minhash


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus():
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(8):
        base = [r.choice(words) for _ in range(r.choice([9, 10, 12, 30, 60, 150]))]
        for _ in range(40):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 1, 2, 2, 3, 4, 5, 8])):
                p, kind = r.randrange(len(t)), r.random()
                if kind < 0.5:
                    t[p] = r.choice(words)
                elif kind < 0.8 and len(t) > 4:
                    del t[p]
                else:
                    t.insert(p, r.choice(words))
            rows.append((3 * len(rows) + 1, " ".join(t)))
    return rows + [(100001, None), (100002, ""), (100003, "a"), (100004, "A"), (100005, "a b"), (100006, "  a\tb "), (100007, "x y z"), (100008, "x y z x y z")]


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, words, percent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0, "q") for i, t in rows], "doc_id long, text string, f int, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, words, percent).collect()}
    assert got == brute(rows, words, percent)


@pytest.mark.parametrize("nearest, cells, small, depth", [(1, 1, 2, 3), (3, 2, 3, 8)])
def test_recursion_and_crowded_elements_lose_no_link(spark, monkeypatch, nearest, cells, small, depth):
    """With tiny bounds every way through the regions is taken; half of the texts also hold one long passage."""
    for name, value in (("NEAREST", nearest), ("CELLS", cells), ("SMALL", small), ("DEPTH", depth)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(5)
    passage = " ".join(f"pass{i}" for i in range(60))
    rows = [(i, t if not t or r.random() < 0.5 else f"{t} {passage}") for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df, 5, 80).collect()}
    assert got == brute(rows, 5, 80)


def test_links_at_the_limit_beside_others(spark):
    """Two texts at exactly 90 percent, one of which shares a third of its words with another linked pair."""
    r = random.Random(6)
    rows = []
    for k in range(60):
        a = [f"a{k}x{i}" for i in range(74)]
        z = a[:26] + [f"z{k}x{i}" for i in range(48)]
        texts = [a, a + [f"b{r.random()}" for _ in range(8)], z, z[:-1] + [f"w{k}"]]
        rows += [(10 * k + j, " ".join(t)) for j, t in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_empty_null_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert jaccard.jaccard_components(spark.createDataFrame([], schema), 3, 90).count() == 0
    rows = jaccard.jaccard_components(spark.createDataFrame([(2, "a b c"), (2, "a b c"), (1, "a b c"), (None, "a b c"), (5, None)], schema), 3, 90).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 1), (1, 1), (2, 1), (2, 1), (5, 5)]


def edited(word, *places):
    t = [f"{word}{i}" for i in range(150)]
    for p in places:
        t[p] = f"{word}new{p}"
    return " ".join(t)


NAMELESS = 10**9
# around a null id: edits of its text; a chain through it; nothing but null ids; a single text; none
AROUND_NULL = [(NAMELESS, edited("a")), (11, edited("a", 40)), (12, edited("a", 90))]
AROUND_NULL += [(21, edited("b")), (NAMELESS + 1, edited("b", 20, 50)), (22, edited("b", 20, 50, 80, 110))]
AROUND_NULL += [(NAMELESS + 2, edited("c")), (NAMELESS + 3, edited("c", 30)), (NAMELESS + 4, edited("c", 70)), (NAMELESS + 5, edited("c"))]
AROUND_NULL += [(NAMELESS + 6, edited("d")), (NAMELESS + 7, None), (NAMELESS + 8, " ")]


@pytest.fixture
def around_null(spark):
    return spark.createDataFrame([(None if i >= NAMELESS else i, t) for i, t in AROUND_NULL], "doc_id long, text string")


def test_null_ids_link_like_others(spark, around_null):
    want = sorted((min(i, NAMELESS), n, min(c, NAMELESS)) for i, (n, c) in brute(AROUND_NULL, 3, 90).items())
    assert [c for i, _, c in want if i < NAMELESS] == [11, 11, 21, 21]
    for found in (jaccard.jaccard_components(around_null, 3, 90), minhash.near_duplicates(around_null, 3, 90)):
        assert sorted((r.doc_id or NAMELESS, r.n_shingles, r.component_id or NAMELESS) for r in found.collect()) == want


def test_first_documents_around_null_ids(spark, around_null):
    kept = [(r.doc_id, r.text) for r in jaccard.first_documents(around_null, 3, 90).collect()]
    assert sorted(i for i, _ in kept if i) == [11, 21]
    nameless = [t for i, t in kept if i is None]
    assert len(nameless) == 4 and {edited("d"), None, " "} < set(nameless)
    assert ({*nameless} - {edited("d"), None, " "}).pop() in (edited("c"), edited("c", 30), edited("c", 70))


def test_texts_with_half_in_common_are_not_measured(spark, monkeypatch):
    """They share a few parts by chance, but far fewer than links do: no set is read for them, only for the linked pair."""
    r = random.Random(7)
    rows = [(k, " ".join([f"k{k}x{i}" for i in range(400)] + [f"h{k // 2}x{i}" for i in range(400)])) for k in range(30)]
    a = [f"a{i}" for i in range(800)]
    rows += [(100, " ".join(a)), (101, " ".join(a[:-60] + [f"b{i}" for i in range(60)]))]
    r.shuffle(rows)
    kept, read = {}, common.materialize

    def materialize(df, name):
        kept[name] = out = read(df, name)
        return out

    monkeypatch.setattr(common, "materialize", materialize)
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {i: 100 if i >= 100 else i for i, _ in rows}
    assert kept["sets"].count() == 2


@pytest.mark.parametrize("percent", [50, 80, 90, 99])
def test_linked_sets_share_the_keys_that_a_link_needs(spark, percent):
    """Pairs at the limit, of sizes on both sides of class borders; in some class they share the keys that a link takes."""
    low = jaccard.size_classes(percent, 3000)[0].tolist()
    assert len(jaccard.size_classes(percent)[0]) <= jaccard.CLASSES
    rows = []
    for n in sorted({max(1, x + d) for x in low for d in (-1, 0, 7)}):
        same = -(-n * 2 * percent // (100 + percent))
        for m in {n, max(same, -(-n * percent // 100))}:
            both = -(-(n + m) * percent // (100 + percent))
            if both <= min(n, m):
                words = [f"n{n}m{m}x{i}" for i in range(n + m - both)]
                rows += [(2 * len(rows), " ".join(words[:n])), (2 * len(rows) + 1, " ".join(words[n - both : n - both + m]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {}
    for r in jaccard.agreements(docs, 1, percent).collect():
        keys.setdefault(r.f, set()).add(r.key)
    least = jaccard.size_classes(percent)[3]
    marks = [jaccard.mark(s) for _, s in jaccard._sets(docs.select("text").withColumnRenamed("text", "__text").toArrow().combine_chunks().to_batches()[0], 1)]
    linked = 0
    for u, v in zip(marks[::2], marks[1::2]):
        if u != v:
            linked += 1
            met = np.bincount([k & jaccard.CLASSES - 1 for k in keys.get(u, set()) & keys.get(v, set())], minlength=len(least))
            assert (met >= least).any()
    assert linked > 20


def test_texts_with_nothing_in_common_share_no_empty_parts(spark, monkeypatch):
    """Most sets of this size have many empty parts in the next size class. Those parts are no keys: no set is read but the linked pair's."""
    rows = [(k, " ".join(f"k{k}x{i}" for i in range(950 + k % 40))) for k in range(80)]
    a = [f"a{i}" for i in range(960)]
    rows += [(100, " ".join(a)), (101, " ".join(a + [f"b{i}" for i in range(230)]))]
    kept, read = {}, common.materialize

    def materialize(df, name):
        kept[name] = out = read(df, name)
        return out

    monkeypatch.setattr(common, "materialize", materialize)
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {i: 100 if i >= 100 else i for i, _ in rows}
    assert kept["sets"].count() == 2


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    r = np.random.default_rng(3)
    for n, edits in ((5, 0), (5, 3), (300, 40), (300, 300), (5000, 900)):
        x = r.integers(0, 1 << 63, n, dtype=np.uint64)
        y = np.concatenate([x[edits:], r.integers(0, 1 << 63, edits // 2, dtype=np.uint64)])
        bits = sum(int(v).bit_count() for v in (jaccard.sketch(x) ^ jaccard.sketch(y)).view(np.uint64))
        assert bits <= len(np.setxor1d(x, y)) and (bits > edits // 2 or n > 1000 or not edits)


def test_edits_of_a_copied_text_are_told_apart_by_their_sketches(spark, monkeypatch):
    """Far edits of one text meet in pairs that no link takes; their sets aren't read for that."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(120):
        t = list(base)
        for _ in range(r.choice([2, 9, 12, 14])):
            t[r.randrange(len(t))] = f"e{k}x{r.random()}"
        rows.append((k, " ".join(t)))
    kept, read = {}, common.materialize

    def materialize(df, name):
        kept.setdefault(name, []).append(read(df, name))
        return kept[name][-1]

    monkeypatch.setattr(common, "materialize", materialize)
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 5, 80).items()}
    met, measured = (sum(t.count() for t in kept[n]) for n in ("met_pairs", "pairs"))
    assert met > 100 and measured < met / 4
