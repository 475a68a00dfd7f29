import random

import numpy as np
import pytest

import corpus_pipeline
from fathomline.llm import near_copies
from test_documents import W, classes


def test_tiles_against_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (9, near_copies.WORDS), dtype=np.uint64)
    s = np.repeat(base, 40, axis=0)
    for row in s:
        for _ in range(rng.integers(1, 300)):
            row[rng.integers(near_copies.WORDS)] ^= np.uint64(1) << np.uint64(rng.integers(63))
    roots, sides = rng.integers(0, 300, len(s)), rng.random(len(s)) < 0.4
    for first in (np.ones(len(s), bool), sides):
        x, y, d = near_copies.near_pairs(s, roots, first, 300)
        both = np.bitwise_count(s[:, None] ^ s[None]).sum(axis=2, dtype=int)
        apart = (roots[:, None] != roots[None]) & ((first[:, None] != first[None]) | first.all())
        a, b = np.nonzero(np.triu(apart & (both <= 300), 1))
        assert sorted(map(tuple, np.sort(np.c_[x, y], axis=1).tolist())) == sorted(zip(a.tolist(), b.tolist(), strict=True)) and (d == both[x, y]).all()
        use = near_copies.forest(x, y, d, roots)
        joined = classes(range(300), [(int(roots[i]), int(roots[j])) for i, j in zip(x, y, strict=True)])
        assert joined == classes(range(300), [(int(roots[x[k]]), int(roots[y[k]])) for k in use]) and len(use) == 300 - len(set(joined.values()))


def test_sketch_against_bits():
    h = np.random.default_rng(1).integers(0, 1 << 63, 77, dtype=np.uint64)
    got = np.unpackbits(np.frombuffer(near_copies.sketch(h), np.uint8), bitorder="little").reshape(near_copies.WORDS, 64)
    for w in range(near_copies.WORDS):
        m = h * near_copies._SPREAD[w]
        m = (m ^ m >> np.uint64(32)) * near_copies._MIX
        m ^= m >> np.uint64(29)
        assert got[w].tolist() == [int(2 * sum(int(v) >> b & 1 for v in m) > 77) for b in range(64)]
    assert near_copies.sketch(h[:0]) == bytes(near_copies.SKETCH_BITS // 8)


@pytest.mark.parametrize("large", [2048, 3])
def test_stage_keeps_one_of_each_group_of_similar_texts(spark, monkeypatch, large):
    """Against all pairs: copies with a word changed here and there, most of them beyond four bits; chains of copies of copies."""
    monkeypatch.setattr(near_copies, "LARGE_BUCKET", large)
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "ONE", "two words"]
    for n in (40, 90, 90, 200, 600):
        base = [f"w{rng.randrange(4000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(7):
            words = list(base)
            for _ in range(rng.randint(1, max(1, n // 30))):
                words[rng.randrange(n)] = "changed"
            texts.append(" ".join(words))
        for _ in range(9):
            base = list(base)
            for _ in range(max(1, n // 60)):
                base[rng.randrange(n)] = f"w{rng.randrange(4000)}"
            texts.append(" ".join(base))

    def shingles(t):
        words = W.findall((t or "").lower())
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = list(map(shingles, texts))
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    want = sorted(set(classes(range(len(sets)), near).values()))
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (None, "x")], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs.union(docs.where("doc_id is not null")), "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == want
    assert got.where("doc_id is null").count() == 2
    assert near_copies.keep_one(docs.limit(0)).count() == 0
