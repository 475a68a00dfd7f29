"""Ranked search, language identification and fill-in-middle against brute force, held-out rows and exact round trips."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import byte_network, fill_middle, queries, threshold_search
from test_oracles import plain

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_fill_in_middle"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)


def term_list(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """(number, rank, doc_id, score) by the definition alone."""
    terms = [(i, term_list(t)) for i, t in docs]
    n = sum(bool(t) for _, t in terms)
    total = sum(len(t) for _, t in terms)
    out = []
    for number, (_, text) in enumerate(items):
        asked = set(term_list(text))
        weights = {a: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(a in t for _, t in terms) + 1))) for a in asked}
        scores = []
        for i, t in terms:
            if t:
                m = 50 + 50 * len(t) * n // total
                scores.append((sum(weights[a] * (1_000_000_000 * t.count(a) // (1000 * t.count(a) + 20 * m)) for a in asked if a in t), i))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(number, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return out


ITEMS = [(1, "that and of the"), (None, "QUA lorem été"), (2, None), (3, "!!"), (1, "that and of the"), (4, "passage"), (5, "zzz-absent")]


def found(spark, docs, items, k):
    rows = threshold_search.rank_documents(docs, items, k).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=repr)


def test_ranking_of_awkward_rows(spark, docs, empty, texts):
    words = ITEMS + [(6, " ".join(sorted(set(term_list(texts[10])))))]
    items = spark.createDataFrame([(i, t, "x") for i, t in words], "item_id long, text string, score string")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "that passage"), (None, "that passage"), (3, "one and"), (3, "one and")]
    more = docs.unionByName(spark.createDataFrame([(i, t, "en", None, 1, 1, 1, 1.0, "x") for i, t in rows[-4:]], docs.schema))
    for k in (3, 50):
        want = sorted(((words[n][0], r, i, s) for n, r, i, s in ranked(rows, words, k)), key=repr)
        assert found(spark, more, items, k) == want
    assert found(spark, empty, items, 5) == [] and found(spark, docs, items.limit(0), 5) == []


def test_many_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = found(spark, docs, items, 7)
    monkeypatch.setattr(threshold_search, "BLOCK_ITEMS", 2)
    assert len(list(threshold_search.blocks(items))) == 4
    assert found(spark, docs, items, 7) == whole


def test_threshold_stops_early_and_misses_nothing(monkeypatch):
    """Small shards, equal scores over their borders, and lists read to a part of their depth."""
    rng = random.Random(5)
    monkeypatch.setattr(threshold_search, "SHARD_DOCS", 97)
    monkeypatch.setattr(threshold_search, "FIRST_DEPTH", 2)
    looked = []
    plain_look = threshold_search.Shard.look_up
    monkeypatch.setattr(threshold_search.Shard, "look_up", lambda self, rows, asked: looked.append(len(rows)) or plain_look(self, rows, asked))
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "rare", "dull"]) for _ in range(rng.choice([3, 3, 8, 30])))) for i in range(1000)]
    rng.shuffle(docs)
    for k, item in ((1, "rare"), (5, "a rare"), (40, "a b c dull")):
        asked = sorted({t.encode() for t in term_list(item)})
        seen = [term_list(t) for _, t in docs]
        weights = np.array([threshold_search.weight(len(docs), sum(a.decode() in t for t in seen)) for a in asked])
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], ["doc_id", "text"])
        held = np.empty(0, np.int64), np.empty(0, np.int64)
        looked.clear()
        for shard in threshold_search._shards(iter([batch]), {a: j for j, a in enumerate(asked)}, weights, len(docs), sum(map(len, seen))):
            held = shard.search(np.arange(len(asked)), len(asked), held, k)
        assert [(s, i) for s, i in zip(*map(list, held), strict=True)] == [(s, i) for _, _, i, s in ranked(docs, [(0, item)], k)]
        assert sum(looked) < 800  # of 1000


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ é\n<P>1ñ𝄞")), min_size=1, max_size=6), st.randoms())
def test_runs_cut_where_units_do(texts, rng):
    runs = fill_middle.Runs(texts)
    assert runs.units.tolist() == [len(units(t)) for t in texts]
    cuts = np.array([rng.randint(0, len(units(t))) for t in texts])
    assert runs.offsets(cuts).tolist() == [len("".join(units(t)[:c])) for t, c in zip(texts, cuts.tolist(), strict=True)]


def test_fill_in_middle_by_definition(spark, docs, empty, texts):
    extra = ["<P>marked", "a<S", "M>" * 3, "<", "é𝄞" * 2000, "word " * 60_000]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + k, t) for k, t in enumerate(extra * 8)] + [(None, "no id here"), (5, "again"), (5, "again")]
    table = spark.createDataFrame([(i, t, "n", "form") for i, t in rows], "doc_id long, text string, n string, output string")
    made = fill_middle.transform(table)
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    want = []
    for i, t in rows:
        t = t or ""
        u, h = units(t), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 90:
            want.append((i, len(u), "plain", None, None, t))
        elif h[3] % 100 < 20:
            want.append((i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"))
        else:
            want.append((i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
    assert got == sorted(want, key=repr)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    again = made.select("doc_id", fill_middle.restore(made.output, made.form).alias("text")).collect()
    assert sorted(((r.doc_id, r.text) for r in again), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
    assert fill_middle.digests(fill_middle.transform(empty)).collect() == []


def test_windows_hold_every_stretch():
    rng = random.Random(2)
    for size in (0, 1, 255, 256, 257, 506, 507, 5000):
        data = bytes(rng.choice(b"abcdefgh") for _ in range(size))
        rows = byte_network.windows(data)
        codes = byte_network.CLASS_OF[np.frombuffer(data, np.uint8)].tolist()
        held = {tuple(r[k : k + 4]) for r in rows.tolist() for k in range(byte_network.WINDOW - 3)}
        assert all(tuple(codes[k : k + 4]) in held for k in range(len(codes) - 3))
        assert max(byte_network.STEP, 1) * len(rows) <= len(codes) + 2 * byte_network.WINDOW


def test_scorer_is_the_network():
    rng = np.random.default_rng(3)
    filters = [rng.normal(0, 0.3, (w, byte_network.CLASSES, byte_network.FILTERS)).astype(np.float32) for w in byte_network.WIDTHS]
    net = byte_network.Network(["x", "y", "z"], filters, rng.normal(0, 0.1, 48).astype(np.float32), rng.normal(0, 0.3, (48, 3)).astype(np.float32), np.zeros(3, np.float32))
    texts = ["a", "Straße 12 été " * 400, "b c" * 90]
    for text, got in zip(texts, byte_network.Scorer(net).score([t.encode() for t in texts]), strict=True):
        rows, sums = byte_network.windows(text.encode()), np.zeros(3)
        for row in rows:
            z = []
            for w, f in zip(byte_network.WIDTHS, filters, strict=True):
                z.append(np.max([sum(f[i][row[p + i]] for i in range(w)) for p in range(len(row) - w + 1)], axis=0))
            logits = np.maximum(np.concatenate(z) + net.bias, 0) @ net.out
            e = np.exp(logits - logits.max())
            sums += e / e.sum() * ((row != byte_network.BLANK) & (row != byte_network.DIGIT)).sum()
        assert np.allclose(got, sums / sums.sum(), atol=1e-5)


def test_held_out_languages_and_awkward_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = byte_network.train(docs)
    rows = byte_network.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(None, None, "en", "q"), (1, "", "en", "q"), (2, "12 !! ½", None, None), (3, "the", "de", "q"), (3, "the", "en", "q"), (4, "der " * 90_000, None, "q"), (None, "the and of that", None, None)], "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang_pred, r.score) for r in byte_network.identify(odd, net).collect()}
    assert {(i, p) for i, p, _ in got} == {(None, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "de"), (None, "en")} and len(got) == 6
    assert all((s == 0) == (p == "und") for _, p, s in got)
    none = odd.limit(0)
    assert byte_network.train(none) is None and byte_network.identify(none, None).collect() == []
    assert {r.lang_pred for r in byte_network.identify(odd, None).collect()} == {"und"}
