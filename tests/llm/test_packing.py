import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from offerlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a\x1cb .\x1c.", "Σας İx", "<|endoftext|> hi", "it's  we'll 12,345 \xa0 x", "é ́x", "A\x85B　c", "\x00 a", "ﬁ ǅ ß ẞ K", "thre,!! thre. thre", "…,. ''", "don't,", "word" * 3000]


def test_ids_equal_the_tokenizers():
    t = Tokenizer.from_file(PATH)
    own = packing.WordTokenizer(PATH)
    for _ in range(2):
        for text, ids in zip(ODD, own.encode(ODD)):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_memory_of_words_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    t = Tokenizer.from_file(PATH)
    own = packing.WordTokenizer(PATH)
    for text in ("one two three four", "five six seven, eight", "one nine ten! eleven", "two two five"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_plan_holds_all_pieces_and_is_near_the_bound():
    r = random.Random(4)
    for n in (0, 1, 7, 500, 20000):
        h = Counter(r.choice([1, 5, r.randrange(1, 300), r.randrange(1, 2049), 2048]) for _ in range(n))
        plan = packing.plan(dict(h))
        seen = Counter()
        for count, content in plan:
            assert sum(k * m for k, m in content) <= 2048
            for k, m in content:
                seen[k] += count * m
        assert seen == h
        least = -(-sum(k * v for k, v in h.items()) // 2048)
        assert sum(c for c, _ in plan) <= least * 1.01 + 1


def test_price_is_the_best_fill():
    lengths, worth = np.array([3, 5, 7]), np.array([3.0, 5.5, 7.2])
    best, _ = packing.price(lengths, worth, 12)
    brute = max(3.0 * a + 5.5 * b + 7.2 * c for a in range(5) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= 12)
    assert abs(best[12] - brute) < 1e-9


def test_pack_places_every_piece(spark):
    r = random.Random(5)
    texts = [None, "", "a b c"] + [" ".join(r.choice(["red", "blue", "offer", "zq"]) for _ in range(r.randrange(1, 5000))) for _ in range(40)]
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(2, "a b c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(df, PATH).collect()
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4").tobytes()
            want[i, k // 2048, k, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in got) == want
    by = {}
    for p in got:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
