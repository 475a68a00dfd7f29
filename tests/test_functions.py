"""Text, markdown, structured and control functions against small cases and naive forms."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import markdown as md
from fathomline.functions import signals
from fathomline.functions import text as fn
from fathomline.operators import paging, structured, tree
from fathomline.operators import reports as rp
from fathomline.sources import sinks, tables
from fathomline.streaming import control


def naive_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab能") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert fn.edit_distance(a, b) == naive_distance(a, b)


def test_mojibake_is_repaired_only_where_it_is_one():
    assert fn.repair_mojibake("é—".encode().decode("cp1252")) == "é—"
    assert all(fn.repair_mojibake(t) == t for t in ("café", "", None, "Ãb", "能碳"))


def test_text_fidelity():
    assert fn.fidelity("abc", "xabcx") == (1.0, 0.6) and fn.fidelity("", "") == (1.0, 1.0) and fn.fidelity("a", "") == (0.0, 0.0)
    assert fn.best_candidate("abcdef", ["abc", "abcdefg", "zzz"]) == 1


def test_effective_text():
    assert signals.effective_text("# Ｔitle\n\n* a **b** [link](http://x) ![i](y) <b>é</b> 5%") == "titleablinké5%"


def test_table_grids_and_records():
    page = "<table><tr><th rowspan=2>a</th><th colspan=2>b</th></tr><tr><th>c</th><th>d</th></tr><tr><td>1<td>2<td>3</tr></table>"
    grid = fn.table_grids(page)[0]
    assert grid == [["a", "b", "b"], ["a", "c", "d"], ["1", "2", "3"]]
    assert fn.flat_headers(grid[:2]) == ["a", "b / c", "b / d"] and fn.records(grid, 2) == ["a: 1; b / c: 2; b / d: 3"]
    assert fn.flat_headers([["", "x"]]) == ["列1", "x"] and fn.table_grids(None) == []


def test_formula_signatures():
    assert signals.formula_signature(r"\frac{a}{ 2 }") == signals.formula_signature(r"\displaystyle \frac { a } {2}") != signals.formula_signature(r"\frac{a}{3}")


DOC = "---\nt: 1\n---\n# A\ntext one\nmore\n\n## B\n- x\n- y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\n# no\n```\n$$x=1$$\n> q\n![i](u)\n# C\n<div>\nz\n</div>\n"


def test_elements_cover_every_line_once():
    e = md.elements(DOC)
    assert [x.kind for x in e] == ["front_matter", "heading", "paragraph", "heading", "list", "table", "code_block", "math_block", "block_quote", "image", "heading", "html"]
    seen = [n for x in e for n in range(x.start, x.end + 1)]
    assert len(seen) == len(set(seen)) and {i for i, t in enumerate(DOC.split("\n"), 1) if t.strip()} <= set(seen)
    assert [x.trail for x in e][4] == ["A", "B"] and e[-1].trail == ["C"] and md.elements(None) == []


def test_chunks_and_segments_lose_nothing():
    rng = random.Random(3)
    text = "\n".join(" ".join(rng.choice(["aa", "bb", "cc."]) for _ in range(rng.randint(1, 300))) for _ in range(30))
    assert "".join(md.segments(text)) == text and all(md.tokens(s) <= md.HARD_MAX for s in md.segments(text))
    chunks = md.coarse_chunks(md.elements("# H\n\n" + text + "\n\n# End"))
    assert chunks[-1][2].endswith("# End") and sum(c[2].count("aa") for c in chunks) == text.count("aa")
    c = [0.9, 0.2, 0.8, 0.8, 0.1]
    assert md.depths(c)[1] == pytest.approx(0.7 + 0.6) and md.depths([]) == []


def test_number_cells(spark):
    cases = {"NA": None, " n/a ": None, "-": None, "1,234.5": 1234.5, "<0.5": 0.5, "≈ 7": 7.0, "x": None, "": None}
    df = spark.createDataFrame(list(cases.items()), "cell string, want double")
    assert all(r.got == r.want for r in df.select("want", structured.number_cell(F.col("cell")).alias("got")).collect())


def test_factor_lookup(spark):
    rows = [(2024, "T1", "Anthracite", "coal", "CO2", "103.69", "r1"), (2023, "T1", "Anthracite", "coal", "CO2", "103", "r2"), (None, "T1", None, "coal", "CH4", "1", "r3")]
    df = spark.createDataFrame(rows, "edition_year int, table_code string, activity_name string, fuel_type string, gas string, v string, source_row string").withColumn("factor_value", F.col("v").cast("decimal(20,6)"))
    assert [r.factor_value for r in structured.factor_lookup(df, year=2024, gas="co2", activity="thra").collect()] == ["103.690000"]
    assert [r.source_row for r in structured.factor_lookup(df, activity="%", limit=900).collect()] == ["r1", "r2", "r3"]
    assert len(structured.factor_lookup(df, limit=0).collect()) == 1


def test_pages_and_patches(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [(r.k, r.total) for r in paging.page(df, [F.desc("k")], 2, 3).collect()] == [(7, 10), (6, 10), (5, 10)]
    assert [r.has_more for r in paging.has_more(df, [F.col("k")], 7, 3).collect()] == [False] * 3
    cur = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "k string, o int, v double")
    new = spark.createDataFrame([("b", 1, 5.0, False), ("a", 2, None, True), ("z", 3, 9.0, False)], "k string, o int, v double, removed boolean")
    assert sorted((r.k, r.v, r.appended) for r in rp.patch(cur, new, "k", "o", "v").collect()) == [("b", 5.0, False), ("z", 9.0, True)]


def test_tree_paths_and_cycles(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (8, 9), (9, 8), (5, 5)], "node long, parent long")
    got = {r.node: (r.path, r.cyclic) for r in tree.paths(df).collect()}
    assert got[4] == ([1, 2, 3, 4], False) and got[8][1] and got[5][1] and not got[1][1]


def test_sinks(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, s long, v string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k long, s long, v string")
    assert sorted(r.v for r in sinks.upsert(old, new, ["k"], "s").collect()) == ["b", "c", "e"]
    sized = spark.createDataFrame([(0, i, s) for i, s in enumerate([5, 5, 5, 20, 1])], "g long, o long, size long")
    assert [r.batch for r in sinks.batches(sized, "g", "o", "size", 2, 12).orderBy("o").collect()] == [0, 0, 1, 2, 3]


def test_schema_drift_is_refused(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.raises(tables.SchemaDrift):
        tables.table(spark, str(tmp_path), "labels")


def test_control_plane(spark):
    m = spark.createDataFrame([(1, 1, False, False), (2, 5, False, False), (3, 1, False, True), (4, 9, True, True)], "seq long, attempt int, ok boolean, terminal boolean")
    assert [r.route for r in control.route(m).orderBy("seq").collect()] == ["RETRY", "DEAD", "DEAD", "DONE"]
    assert [r.d for r in m.orderBy("seq").select(control.retry_delay(F.col("attempt")).alias("d")).collect()] == [30, 1800, 30, 1800]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i % 4, i, i % 7) for i in range(60)]
    schema = "k long, s long, v long"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    control.upsert_stream(stream, ["k"], "s", f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination()
    got = {r.k: r.s for r in control.newest_version(spark, f"{tmp_path}/table").collect()}
    assert got == {0: 56, 1: 57, 2: 58, 3: 59}


def test_upserts_merge_changes_now_and_then(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(control, "MERGE_EVERY", 2)
    schema, want = "k long, s long, v long", {}
    for part in range(7):
        rows = [(k, (part * 5 + (k or 0)) % 9, part * 10 + (k or 0)) for k in (0, 1, part, None)]
        rows = list({r[0]: r for r in rows}.values())
        for k, s, v in rows:
            if k not in want or s >= want[k][0]:  # a later change wins over the same sequence
                want[k] = (s, v)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        control.upsert_stream(stream, ["k"], "s", f"{tmp_path}/table", f"{tmp_path}/check").awaitTermination()
        assert {r.k: (r.s, r.v) for r in control.newest_version(spark, f"{tmp_path}/table").collect()} == want
    assert sorted(os.listdir(f"{tmp_path}/table")) == [f"{n}{i:010d}" for n, i in [("d", 4), ("d", 5), ("d", 6), ("v", 3), ("v", 5)]]
    assert control.newest_version(spark, f"{tmp_path}/none") is None


def test_claims_are_forgotten_when_their_timer_runs_out():
    import pandas as pd

    class State:
        hasTimedOut, exists, get, wait = False, False, None, 0  # noqa: N815

        def update(self, value):
            self.get, self.exists = value, True

        def remove(self):
            self.exists = False

        def setTimeoutTimestamp(self, ms):  # noqa: N802
            self.wait = ms

    state, t = State(), pd.Timestamp("2026-01-01")
    frame = pd.DataFrame({"version": [1, 1, 0, 2], "seq": [0, 1, 2, 3], "ts": [t, t + pd.Timedelta(29, "s"), t + pd.Timedelta(40, "s"), t + pd.Timedelta(41, "s")]})
    (out,) = control.claim((7,), iter([frame]), state)
    assert out.taken.tolist() == [True, False, False, True] and state.get[:2] == (2, 1)
    assert state.wait / 1000 == (t + pd.Timedelta(41, "s") + pd.Timedelta(control.CLAIM_DAYS, "D")).timestamp()
    state.hasTimedOut = True
    assert list(control.claim((7,), iter([]), state)) == [] and not state.exists


def test_html_to_markdown():
    from fathomline.functions.htmltext import cells, to_markdown

    page = "<head><title>t</title></head><nav>menu</nav><h2>A &amp; b</h2><p>one <b>two</b> <a href=u>x</a><br>y<ol><li>i<li>j</ol><blockquote>q</blockquote><pre>c\n d</pre><div hidden>no</div><table><tr><th colspan=2>h</th></tr><tr><td>1|2</td><td>3</td></tr></table><!-- c -->"
    got = to_markdown(page)
    assert got == "## A & b\n\none **two** [x](u) y\n\n1. i\n\n2. j\n\n> q\n\n```\nc\n d\n```\n\n| h | h |\n| --- | --- |\n| 1\\|2 | 3 |"
    assert cells(got.split("\n\n")[-1]) == [["h", "h"], ["1|2", "3"]] and to_markdown(None) == ""


def test_matched_chars_are_those_of_matching_blocks():
    import difflib
    import random

    from fathomline.functions.text import matched_chars

    rng = random.Random(1)
    for k in range(400):
        a, b = ("".join(rng.choice("ab" if k % 2 else "abcdef") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert matched_chars(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_containing_finds_every_whole_excerpt(spark):
    import random

    from fathomline.operators.relational import containing

    rng = random.Random(2)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 200))) for _ in range(60)] + [None, ""]
    for least in (1, 5, 14, 40):
        asked = [t[k : k + rng.randint(least, 60)] for t in texts if t and len(t) > 80 for k in (0, 7, 33)] + ["x" * least, None, ""]
        got = containing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, s string"), spark.createDataFrame(list(enumerate(asked)), "item_id long, excerpt string"))
        wanted = {(i, d) for i, e in enumerate(asked) if e for d, t in enumerate(texts) if t and e in t}
        assert {(r.item_id, r.doc_id) for r in got.collect()} == wanted and got.count() == len(wanted)
    empty = spark.createDataFrame([], "item_id long, excerpt string")
    assert containing(spark.createDataFrame([(1, "a")], "doc_id long, s string"), empty).count() == 0


def test_headed_documents_keep_every_character(spark, monkeypatch):
    from fathomline.plans import chunking

    texts = ["word " * 3000 + "end", "\n".join(f"line {i} " + "x" * 50 * (i % 3) for i in range(30)), "short", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(chunking, "table", lambda *_: docs)
    got = {r.doc_id: r.text.split("\n\n") for r in chunking.markdown_documents(spark, "").collect()}
    for i, t in enumerate(texts):
        lines = iter(got[i])
        assert all(x in lines for x in t.split("\n"))
    chunks = [r.body for r in chunking.coarse_chunks(spark, "").where("doc_id = 0").collect()]
    assert sum(c.count("word") for c in chunks) >= 3000 and any("end" in c for c in chunks)


def test_upper_case_of_single_characters(spark):
    rows = [("straße ﬁn ᾳ ŉ é 🙂",), ("plain é",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(fn.upper_each(F.col("t"))).collect()]
    assert got == ["STRAẞE ﬁN ᾼ ŉ É 🙂", "PLAIN É", "", None]


def test_matches_from_infrequent_characters_are_those_of_difflib():
    import difflib
    import time

    rng = random.Random(8)
    letters, few = "etaoinshrdlu ", "qzxjkvbpygfwmc[]^-\\é"
    for n, share in [(0, 0.1), (50, 0.5), (150, 0.2), *[(rng.randint(200, 1500), rng.choice([0, 0.02, 0.1, 0.3])) for _ in range(40)]]:
        a = "".join(rng.choice(few) if rng.random() < share else rng.choice(letters) for _ in range(n))
        b = "".join(c for c in a if rng.random() > 0.05) if rng.random() < 0.7 else a.replace("t", "")[::-1] + a[: n // 2]
        assert fn.matched_from_rare(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=True).get_matching_blocks())
    long = "".join(rng.choice(few) if rng.random() < 0.08 else rng.choice(letters) for _ in range(100_000))
    began = time.process_time()
    fn.fidelity(long, long.replace("th", ""))
    assert time.process_time() - began < 10


def test_longest_runs_are_those_of_difflib():
    import difflib

    rng = random.Random(12)
    for letters in ("a", "ab", "abc", "etaoinshrdlu 能é") * 60:
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, 300)))
        a = a[: rng.randint(1, 20)] * rng.randint(0, 8) + a
        b = rng.choice(["".join(c for c in a if rng.random() > 0.1) or "a", a[len(a) // 2 :] + a[: len(a) // 2], a * 2, a.replace("t", "") or "a"])
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
        runs, most = fn._Runs(a, b), min(len(a), len(b))
        n, places = runs.longest(0, len(a), 0, len(b), most)
        assert n == m.size and places[:1] == ([(m.a, m.b)] if n else [])
        assert all(a[i : i + n] == b[j : j + n] for i, j in places) and all(i + n <= k and j + n <= l for (i, j), (k, l) in zip(places, places[1:], strict=False))  # noqa: E741
        assert runs._hashed(0, len(a), 0, len(b), rng.randint(0, n), most) == (n, places)
        assert fn.matched_chars(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_matching_blocks_of_many_texts_and_of_repeated_lines_take_seconds():
    import difflib
    import time

    rng = random.Random(13)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    began = time.process_time()
    for _ in range(400):
        text = " ".join(rng.choice([*words, *["the"] * 30]) for _ in range(600))[:3900]
        fn.fidelity(text, text.replace("the ", ""))
    for text, whole in ("a cat sat on the mat and the dog ran to the house by the sea\n", True), ("xthe ", True), ("Und die the ", False):
        long = text * (24000 // len(text))
        assert (fn.matched_chars(long, long.replace("the ", "")) == len(long.replace("the ", ""))) == whole
        some, kept = text * 12, (text * 12).replace("the ", "")
        assert fn.matched_chars(some, kept) == sum(m.size for m in difflib.SequenceMatcher(None, some, kept, autojunk=False).get_matching_blocks())
    assert time.process_time() - began < 8
