from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from offerlens.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ▁ a\n\n²., 😀中文 \x00", "x" * 5000, "été, \t▁", "The offer, (2+1) holds!", None]


def test_round_trip_and_official_decoding(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    encoded = pieces.encode(df, PATH)
    decoded = {r.doc_id: r.text for r in pieces.decode(encoded, PATH).collect()}
    assert decoded == dict(enumerate(TEXTS))
    official = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    assert official.decode(ids[5]) == TEXTS[5]
    assert pieces.encode(df.filter("false"), PATH).count() == 0


def test_same_key_same_ids(spark):
    df = spark.createDataFrame([(1, "the weekly offers of the store"), (1, "the weekly offers of the store"), (2, "the weekly offers of the store"), (None, "the")], "doc_id long, text string")
    a, b, *_ = [r.ids for r in pieces.encode(df.repartition(3), PATH).filter("doc_id = 1").collect()]
    assert a == b
    assert len({tuple(r.ids) for r in pieces.encode(df.filter("doc_id in (1, 2)"), PATH, alpha=0.2).collect()}) == 2


def paths(table, s, i=0):
    if i == len(s):
        yield (), 1.0
        return
    for j in range(i + 1, len(s) + 1):
        if (w := table.weight.get(s[i:j])) is not None:
            for rest, v in paths(table, s, j):
                yield (s[i:j].encode(), *rest), w * v


def test_draws_follow_the_lattice():
    table = pieces.Pieces(PATH, 0.3)
    n = 20000
    ids, at = table.sample(["then"] * n, pieces.row_keys([str(i) for i in range(n)], 3))
    seen = Counter(tuple(table.raw[k] for k in ids[at[i] : at[i + 1]]) for i in range(n))
    every = dict(paths(table, " then"))
    total = sum(every.values())
    for path, v in every.items():
        assert abs(seen[path] / n - v / total) < 0.02


def test_side_by_side_equals_one_by_one():
    words = [" then", "abc", " ", "    ", " weekly,", "²", " offers"]
    a, b = pieces.Pieces(PATH, 1.0), pieces.Pieces(PATH, 1.0)
    a.learn(words)
    b._learn_each(words)

    def chances(table, w):
        """Chance of each piece at each place of the stretch's end, place by place."""
        end, todo, out = table.end[w], [table.end[w]], []
        while todo:
            node = todo.pop()
            lo, hi = np.searchsorted(table.key[: table.n_edges], [node, node + 1.0], "right")
            share = np.diff(np.concatenate([[node], table.key[lo:hi]]))
            out.append((end - node, sorted(zip(table.piece[lo:hi].tolist(), share.round(9).tolist()))))
            todo += [x for x in table.prev[lo:hi].tolist() if x >= 0]
        return sorted({str(x) for x in out})

    for w in words:
        assert chances(a, w) == chances(b, w), w


def test_cuts_do_not_hang_on_what_was_learnt_before():
    words = ["".join(np.random.default_rng(i).choice(list("abcdeghilmnorst"), 3 + i % 9)) for i in range(4000)]
    alone, among = pieces.Pieces(PATH, 1.0), pieces.Pieces(PATH, 1.0)
    among.learn([" " + w for w in words])
    few = [" weekly", " international", "é😀x", " " + "supermarket" * 9]
    among.learn(few)
    for s in few:
        alone.forget()
        alone.learn([s])
        a, b = ((t.key[: t.n_edges], t.end[s]) for t in (alone, among))
        n = alone.nodes
        own = b[0][(b[0] - 1) >> 32 > b[1] - n]
        own = own[(own - 1) >> 32 <= b[1]]
        assert (own - ((b[1] - n + 1) << 32)).tolist() == a[0].tolist(), s
