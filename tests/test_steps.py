"""Steps whose work must stay in proportion to their rows: what a function is handed, and shorter ways with the same results."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.operators import assembly
from fathomline.operators.tokens import Vocabulary

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def vocabulary(spark):
    return Vocabulary(spark, PATH, PATTERN)


class OnlyLong(Vocabulary):
    """Refuses to cut texts that aren't to be cut."""

    def whole_lines(self, text, most):
        @F.pandas_udf("string")
        def refused(texts: pd.Series) -> pd.Series:
            if any(t is not None and len(t) < 100 for t in texts):
                raise ValueError("a text that stays whole was handed over")
            return texts

        return super().whole_lines(refused(text), most)


def test_only_what_is_cut_is_counted_again(spark):
    rows = [(1, "few words", ["paragraph"], 2), (2, "word \n" * 60, ["code_block"], 1), (3, None, ["table"], 1)]
    got = {r.k: r for r in assembly.final_chunks(spark.createDataFrame(rows, "k int, content string, kinds array<string>, elements int"), OnlyLong(spark, PATH, PATTERN), most=20, hard_max=40).collect()}
    assert got[1].content == "few words" and got[1].tokens == got[1].original_tokens and not got[1].truncated
    assert got[2].truncated and got[2].tokens <= 40 < got[2].original_tokens and got[3].content is None and got[3].tokens == 0


def test_short_words_merge_as_long_ones_do():
    from fathomline.functions import bpe

    with open(PATH, "rb") as lines:
        pairs = bpe.BytePairs(bpe.read_ranks(lines), PATTERN)
    rng, held = random.Random(3), bpe.SHORT
    words = ["".join(rng.choice("abnotsaa é字") for _ in range(rng.randint(1, 30))).encode() for _ in range(400)]
    short = [pairs.merged(w) for w in words]
    bpe.SHORT = 0
    try:
        assert short == [pairs.merged(w) for w in words]
    finally:
        bpe.SHORT = held


def test_a_pages_equal_texts_are_folded_once(monkeypatch):
    from fathomline.operators import page_quality

    asked, fold = [], page_quality.effective_text
    monkeypatch.setattr(page_quality, "effective_text", lambda t: asked.append(t) or fold(t))
    assert page_quality.page_measures(False, False, "a b", "a b", None, "a b\n\na b", None, "a b\n\na b") == (2, 2, 0, 4, 0, 1.0, 0.5)
    assert sorted(asked, key=str) == sorted(["a b", None, "a b\n\na b"], key=str)
    assert page_quality.page_measures(True, False, "a b", "a b", "c", None, "x", None)[-2:] == (0.0, 0.0)  # a scan, by its hidden text
    assert page_quality.page_measures(False, False, None, "a", None, "a", None, "a")[-2:] == (None, None)


def test_effective_text_passes_over_patterns_without_their_marks():
    from fathomline.functions import signals

    rng = random.Random(5)
    made = ["".join(rng.choice(["<b>", "<!--", "-->", "[", "]", "(u)", "!", "\n", "# ", "- ", "1) ", "***", "__", "|", "---", "`", "~~", "> ", "a", " ", "ß", "²"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in made:
        for pattern, _, marks in signals._MARKUP:
            assert not pattern.search("".join(c for c in t if c not in marks))


def test_rows_of_documents_are_sent_on_as_they_gather(spark, monkeypatch):
    from fathomline.operators import chunking

    monkeypatch.setattr(chunking, "SENT_CHARS", 100, raising=False)
    docs = spark.createDataFrame([(k, "ab" * 30 if k % 3 else None) for k in range(200)], "doc_id long, text string").coalesce(1)
    split = lambda t: [(k, "x" * 30) for k in range(10)] if t else []
    assert chunking.per_document(docs, "n long, body string", split).count() == 1330
    made = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: made.append(run) or self)
    chunking.per_document(docs, "n long, body string", split)
    sent = list(made[0](iter(docs.toArrow().to_batches())))
    assert sum(b.num_rows for b in sent) == 1330 and max(b.num_rows for b in sent) <= 4


def test_texts_with_characters_left_out_need_no_table():
    import time

    from fathomline.functions.text import edit_distance

    def by_table(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    rng = random.Random(6)
    for _ in range(400):
        a = "".join(rng.choice("abcé🎈") for _ in range(rng.randint(0, 12)))
        for b in ("".join(c for c in a if rng.random() < 0.7), "".join(rng.choice("abcé🎈") for _ in range(rng.randint(0, 12)))):
            assert edit_distance(a, b) == edit_distance(b, a) == by_table(a, b)
    long = "".join(rng.choice("abcdefg ") for _ in range(60000))
    began = time.perf_counter()
    assert edit_distance(long, long.replace("e", "")) == long.count("e")
    assert time.perf_counter() - began < 0.5  # bit vectors of 60 000 places take seconds


def test_a_neighbour_is_split_into_words_once(vocabulary):
    pairs = vocabulary.encoder()()
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdé字") for _ in range(rng.randint(1, 9))) for _ in range(200)) for _ in range(12)]
    for t in texts:
        tokens = pairs.encode(t)
        for most in (0, 1, 5, 64, 10_000):
            kept, removed = pairs.first(t, most)
            assert kept.encode() == b"".join(tokens[: len(tokens) - removed]) and len(tokens) - removed <= most
            assert t.endswith(pairs.last(t, most)) and len(pairs.encode(pairs.last(t, most))) <= most
    asked, words = [], pairs.words

    class Spy:
        groups = 0

        def findall(self, text):
            asked.append(text)
            return words.findall(text)

        def finditer(self, text):
            asked.append(text)
            return words.finditer(text)

    pairs.words = Spy()
    for before, body, after in zip(texts, texts[1:], texts[2:]):
        pairs.count(body, keep=True), pairs.last(before, 64), pairs.first(after, 64)
    assert sorted(t for t in asked if t in texts) == sorted(texts)
