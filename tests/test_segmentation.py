"""Word paths against all cuts, and lexical routes over texts without spaces."""

import itertools
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.functions import segmentation as functions
from fathomline.functions.segmentation import Lexicon, Paths
from fathomline.operators import recall, segmentation
from fathomline.plans.recall import segment_runs

WORDS = {"碳": 4, "排放": 20, "碳排放": 30, "排放权": 9, "权": 3, "碳排放权": 8, "登记": 15, "管理": 40, "登记管理": 6, "规则": 12, "企业": 25, "温室": 7, "温室气体": 18, "气体": 11}


def all_cuts(text):
    for marks in itertools.product([False, True], repeat=max(0, len(text) - 1)):
        out, at = [], 0
        for k, m in enumerate(marks, 1):
            if m:
                out.append(text[at:k])
                at = k
        yield [*out, text[at:]]


def naive(counts, text, without=None, known_only=False):
    """The best of all cuts: by probability, then fewest words, then the longest first."""
    total = sum(counts.values()) + 1
    best = None
    for cut in all_cuts(text):
        score = 0  # in billionths
        for w in cut:
            if w in counts and w != without:
                score += round(math.log(counts[w] / total) * 1e9)
            elif len(w) == 1 and w not in counts and not known_only:
                score += round(math.log(0.5 / total) * 1e9)
            else:
                break
        else:
            key = (score, -len(cut), tuple(map(len, cut)))
            if best is None or key > best[0]:
                best = key, cut
    return best and best[1]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), max_size=12), st.text("abcd", min_size=1, max_size=9))
def test_path_against_all_cuts(counts, text):
    lexicon = Lexicon(counts.items())
    assert lexicon.path(text) == naive(counts, text)
    assert lexicon.path(text, without=text, known_only=True) == naive(counts, text, text, True)


def test_coarse_and_fine():
    lexicon = Lexicon(WORDS.items())
    assert lexicon.coarse("《碳排放权登记管理规则》 ISO14064 Part-2") == ["碳排放权", "登记管理", "规则", "iso14064", "part", "2"]
    assert lexicon.fine("登记管理") == ["登记", "管理"] and lexicon.fine("温室气体") == ["温室", "气体"] and lexicon.fine("规则") == ["规则"]
    assert lexicon.terms("温室气体 gas") == ["温室气体", "温室", "气体", "gas"]
    assert lexicon.coarse(None) == [] and lexicon.coarse("企业某排放") == ["企业", "某", "排放"]
    assert Lexicon([]).coarse("企业") == ["企", "业"]


def test_routes_find_words_inside_texts_without_spaces(spark):
    segmenter = segmentation.Segmenter(spark.createDataFrame(list(WORDS.items()), "word string, n long"))
    rows = [("a", 1, 1, "企业温室气体排放"), ("b", 2, 1, "碳排放权登记管理规则"), ("c", 3, 1, "企业登记"), ("d", 4, 1, "plain words only")]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, dataset_id long, content string")
    queries = spark.createDataFrame([(1, "气体"), (2, "管理"), (3, "登记"), (4, "words")], "query_id long, query string")
    index = recall.stored_index(chunks, segmenter.terms)
    for route in ("bm25", "sparse"):
        got = recall.lexical(index, queries, 5, route, split=segmenter.terms).collect()
        found = {q: {r.chunk_id for r in got if r.query_id == q} for q in range(1, 5)}
        assert found == {1: {"a"}, 2: {"b"}, 3: {"b", "c"}, 4: {"d"}}
        plain = recall.lexical(recall.stored_index(chunks), queries, 5, route).collect()
        assert {r.query_id for r in plain} == {4}  # whole sentences are single terms without a dictionary


def test_dictionaries_are_checked_and_counted(spark, monkeypatch):
    words = spark.createDataFrame([(w,) for w in ["b", "a", "a", "c", "c", "d"]], "word string")
    assert [tuple(r) for r in segmentation.word_counts(words, 3).collect()] == [("a", 2), ("c", 2), ("b", 1)]
    assert segmentation.word_counts(words, 9, 2).count() == 2
    monkeypatch.setattr(segmentation, "MOST_WORDS", 2)
    with pytest.raises(ValueError, match="too large"):
        segmentation.Segmenter(segmentation.word_counts(words, 3))


def test_long_runs_stay_linear():
    rng = random.Random(3)
    text = "".join(rng.choice(list(WORDS)) for _ in range(20_000))
    assert "".join(Lexicon(WORDS.items()).path(text)) == text


def plain_recut(lexicon, words):
    """Words cut again one run at a time, and how many old ends are new ones."""
    new = lexicon.path("".join(words or []))
    old = set(itertools.accumulate(map(len, words or [])))
    return {"words": new, "n_found": len(old & set(itertools.accumulate(map(len, new))))}


@pytest.mark.parametrize("block", [50, functions.BLOCK])
def test_many_runs_as_one_by_one(block, monkeypatch):
    monkeypatch.setattr(functions, "BLOCK", block)
    rng = random.Random(block)
    for letters in ("ab", "abé", "a碳😀", "aaaaaaaaaaaaaaab"):
        for n in (0, 1, 3, 60):
            word = lambda most: "".join(rng.choices(letters, k=rng.randint(1, most)))
            counts = {word(5): rng.choice([1, 1, 2, 50]) for _ in range(rng.randint(0, 14))}
            rows = [None, [], *([word(rng.choice([1, 6, 300])) + rng.choice(["", "x", "ж"]) for _ in range(rng.randint(0, 5))] for _ in range(n))]
            lexicon = Lexicon(counts.items())
            lists = pa.array(rows, pa.list_(pa.string()))
            for part in (lists, lists[1:], lists[:0], lists[2:-1]):
                assert segmentation.recut_lists(Paths(counts.items()), part).to_pylist() == [plain_recut(lexicon, w) for w in part.to_pylist()]


def test_stretches_of_any_length_as_one_by_one():
    lexicon, paths = Lexicon([("aa", 3), ("aaa", 2)]), Paths([("aa", 3), ("aaa", 2)])
    runs = ["a" * n + "b" * (n % 3) for n in range(600)]
    data = "".join(runs).encode()
    ends = paths.ends(np.frombuffer(data, np.uint8), np.cumsum([len(r) for r in runs]))
    want = itertools.accumulate(len(w) for r in runs for w in lexicon.path(r))
    assert ends.tolist() == list(want)


def test_query_on_a_line_of_many_words(spark, tmp_path):
    """Seconds grow as the line does: gathering its word ends one by one took the square of its words."""
    rng = random.Random(5)
    line = " ".join(rng.choices(["gas", "river", "over", "riverbank", "bank", "s"], k=200_000))
    rows = [(1, line, "en", "src1", len(line)), (2, "Gas over -- river\n!!\n\nbank", "en", "src2", 20), (3, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    got = {r.chunk_id: r for r in segment_runs(spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 30
    assert got["2:0"][1:] == (["gas", "over", "river"], 3, 3) and got["2:1"][1:] == ([], 0, 0) and got["2:3"][1:] == (["bank"], 1, 1)
    long = got["1:0"]
    assert long.n_words == 200_000 and "".join(long.words) == line.replace(" ", "") and set(long.words) <= {"gas", "river", "over", "riverbank", "bank", "s"}
    assert 190_000 < long.n_found <= 200_000


def test_a_dictionary_is_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r

    segmentation.Segmenter(spark.createDataFrame(spark.sparkContext.parallelize([("a", 1), ("b", 2)], 1).mapPartitions(count), "word string, n long"))
    assert seen.value == 2


def test_a_long_run_is_taken_in_parts(monkeypatch):
    """What is held grows with the block, not with the run, where words leave places that none crosses."""
    rng = random.Random(8)
    text = "".join(rng.choices(list(WORDS), k=20_000))
    seen, block = [], Paths._block
    monkeypatch.setattr(functions, "BLOCK", 5_000)
    monkeypatch.setattr(Paths, "_block", lambda self, data, runs: seen.append(len(data)) or block(self, data, runs))
    ends = Paths(WORDS.items()).ends(np.frombuffer(text.encode(), np.uint8), np.array([len(text.encode())]))
    assert ends.tolist() == list(itertools.accumulate(len(w.encode()) for w in Lexicon(WORDS.items()).path(text)))
    assert max(seen) <= 5_000 and sum(seen) == len(text.encode())
