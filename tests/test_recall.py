"""Golden cases of fusion, gate, ranking features and context packing."""

import math

import pytest
from pyspark.sql import functions as F

from fathomline.operators import ranking, recall

HITS = "query_id long, source string, chunk_id string, doc_id long, dataset_id long, score double"


def fused(spark, rows):
    hits = spark.createDataFrame([(1, s, c, 100, 10, v) for s, c, v in rows], HITS)
    return {r.chunk_id: r.score for r in recall.fuse(hits).collect()}


def test_log_before_min_max(spark):
    assert fused(spark, [("bm25", "a", 15.0), ("bm25", "b", 3.0), ("bm25", "c", 0.0)]) == {"a": 1.0, "b": 0.5, "c": 0.0}


def test_absent_chunk_adds_nothing(spark):
    assert fused(spark, [("bm25", "a", 5.0), ("sparse", "b", 2.0), ("dense", "c", 0.4)]) == {"a": 0.15, "b": 0.15, "c": 0.7}


def test_weights_of_active_routes(spark):
    got = fused(spark, [("bm25", "a", 5.0), ("dense", "b", 0.4)])
    assert math.isclose(got["a"], 0.15 / 0.85, abs_tol=1e-6) and math.isclose(got["b"], 0.7 / 0.85, abs_tol=1e-6)


def test_one_chunk_in_three_routes(spark):
    assert fused(spark, [("bm25", "a", 5.0), ("sparse", "a", 2.0), ("dense", "a", 0.4)]) == {"a": 1.0}


def test_ties_by_chunk_and_scale_of_weights(spark):
    hits = spark.createDataFrame([(1, "dense", c, 1, 1, 0.5) for c in ("chunk-b", "chunk-a")], HITS)
    assert [r.chunk_id for r in recall.ranked(recall.fuse(hits), ["query_id"]).orderBy("rank").collect()] == ["chunk-a", "chunk-b"]
    mixed = spark.createDataFrame([(1, s, f"c{i}", 1, 1, float(i)) for i in range(5) for s in ("bm25", "dense")], HITS)
    one = recall.fuse(mixed, {"bm25": 0.2, "dense": 0.6}).orderBy("chunk_id").collect()
    assert one == recall.fuse(mixed, {"bm25": 2.0, "dense": 6.0}).orderBy("chunk_id").collect()


def test_negative_lexical_scores_are_errors(spark):
    with pytest.raises(Exception, match="negative"):
        recall.fuse(spark.createDataFrame([(1, "bm25", "a", 1, 1, -1.0)], HITS)).collect()


def test_context_packs_by_budget_and_skips(spark):
    rows = [(1, 1, "a", "能碳"), (1, 2, "b", "会计"), (2, 1, "a", "x" * 40), (2, 2, "b", "y" * 400), (2, 3, "c", "z" * 8), (3, 1, "a", " "), (3, 2, "b", "能碳能碳")]
    got = {(r.query_id, r.chunk_id): (r.kept, r.number) for r in recall.pack_context(spark.createDataFrame(rows, "query_id long, rank int, chunk_id string, content string"), 4).collect()}
    assert got[1, "a"] == (True, 1) and got[1, "b"] == (False, None)
    assert got[2, "a"] == (True, 1) and got[2, "b"][0] is False
    assert got[3, "a"][0] is False and got[3, "b"] == (True, 1)


def test_same_document_features_against_pairs(spark):
    texts = ["温室气体核算", "温室气体核查", "", "能源消耗统计"]
    rows = [(1, f"chunk-{i}", 1 if i < 2 else 5 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, doc_id long, content string")
    df = ranking.grams(df, ["content_bigrams"])
    got = {r.chunk_id: (r.same_doc_candidate_count, r.same_doc_max_bigram_similarity) for r in ranking.same_document(df).collect()}
    grams = [{t[i : i + 2] for i in range(len(t) - 1)} for t in texts]
    j = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
    assert got == {"chunk-0": (1, j), "chunk-1": (1, j), "chunk-2": (0, 0.0), "chunk-3": (0, 0.0)}


def test_query_classes(spark):
    cases = {"版本 v2.1 变化": "exact_identifier", "ISO14064 要求": "exact_identifier", "保存 3 年": "number_time", "碳核算": "short_keyword", "如果工厂同时使用燃煤和天然气并且没有计量表应当怎样核算它们各自的排放量以及间接排放": "long_multi", "什么情况下企业需要提交核查报告材料呢": "natural_default"}
    df = spark.createDataFrame(list(cases.items()), "q string, want string")
    assert all(r.got == r.want for r in df.select("want", ranking.query_class(F.col("q")).alias("got")).collect())


def test_features_are_complete_and_ordered(spark):
    rows = [(1, "a", 1, 0.9, 2.0, None, "不得超过 v2 标准", "是否不得超过"), (1, "b", 1, 0.2, None, 3.0, "超过标准", "是否不得超过")]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, doc_id long, dense double, sparse double, bm25 double, content string, query string")
    got = {r.chunk_id: r for r in ranking.features(df).collect()}
    assert len(ranking.FEATURES) == 38 and all(len(r.features) == 38 for r in got.values())
    assert got["a"].negation_overlap_coverage == pytest.approx(2 / 3) and got["b"].negation_mismatch == 1 and got["a"].same_doc_candidate_count == 1
    assert got["a"].bm25_missing == 1 and got["a"].dense_rr == 1.0 and got["b"].dense_rr == 0.5


def test_slots_stay_with_their_dataset(spark):
    rows = [(1, 7, "a", 1, 0.1), (1, 8, "b", 2, 0.2), (1, 7, "c", 3, 0.9), (1, 7, "d", 4, None)]
    got = ranking.slot_rerank(spark.createDataFrame(rows, "query_id long, dataset_id long, chunk_id string, fused_rank int, rerank_score double"), 12).orderBy("place").collect()
    assert [r.chunk_id for r in got] == ["c", "b", "a", "d"]


def test_dense_search_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, dataset_id long, embedding array<float>")
    got = recall.dense(df, df.where("vec_id < 5").withColumnRenamed("vec_id", "query_id"), 4).orderBy("query_id", "rank").collect()
    f = v.astype(np.float32).astype(float)
    n = np.linalg.norm(f, axis=1)
    c = np.divide(f @ f.T, np.outer(n, n), out=np.zeros((60, 60)), where=np.outer(n, n) > 0).round(6)
    want = [(q, int(i)) for q in range(5) for i in sorted(range(60), key=lambda i: (-c[q, i], i))[:4]]
    assert [(r.query_id, r.vec_id) for r in got] == want


def test_bigram_frequencies_of_every_query(spark, monkeypatch):
    from fathomline.plans import ranking as plans

    rows = [(q, f"c{q}-{k}", t) for q in (0, 7, 8, 50, 10**9) for k, t in enumerate(["ab cd", "abab", "", "Q"])]
    pool = spark.createDataFrame(rows, "query_id long, chunk_id string, content string")
    monkeypatch.setattr(plans, "pool_with_text", lambda s, sf: pool)
    got = {(r.query_id, r.gram): r.df for r in plans.bigram_df(spark, "").collect()}
    assert got == {(q, g): n for q in (0, 7, 8, 50, 10**9) for g, n in {"ab": 2, "bc": 1, "cd": 1, "ba": 1}.items()}


def test_diagnosis_counts_every_hit(spark, monkeypatch):
    from fathomline.plans import recall as plans

    routes = {0: ["bm25", "dense", "dense"], 3: ["dense", "sparse"], 4: ["bm25"], 12: ["dense"], 5: ["sparse"], 6: []}
    hits = spark.createDataFrame([(q, s, f"c{k}", 1, 1, 1.0) for q, v in routes.items() for k, s in enumerate(v)], HITS)
    monkeypatch.setattr(plans, "route_hits", lambda s, sf: hits)
    monkeypatch.setattr(plans, "questions", lambda s, sf: spark.createDataFrame([(q,) for q in routes], "query_id long"))
    got = {r.query_id: (r.bm25, r.dense, r.sparse, r.mode) for r in plans.recall_diag(spark, "").collect()}
    assert got == {0: (1, 2, 0, "hybrid"), 3: (0, 1, 1, "hybrid"), 4: (1, 0, 0, "lexical_only"), 12: (0, 1, 0, "dense_only"), 5: (0, 0, 1, "sparse_only"), 6: (0, 0, 0, None)}


def test_lexical_routes_against_all_pairs(spark, monkeypatch):
    """In one block or many, by dataset and by document: the sums of the definition over every chunk."""
    import random

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(30, 0, -1), k=rng.randint(1, 40))) for _ in range(120)] + ["", "..."]
    rows = [(f"{i // 3}:{i % 3}", i // 3, i % 4, t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, dataset_id int, content string")
    asked = {q: rng.choices(vocabulary, k=4) + ["nowhere"] for q in range(9)} | {9: []}
    queries = spark.createDataFrame([(q, " ".join(w).upper()) for q, w in asked.items()], "query_id long, query string")
    index = recall.stored_index(chunks).cache()
    split = {c: t.split() for c, _, _, t in rows if t.strip(".")}
    of = {c: (d, s) for c, d, s, _ in rows}
    score = {}
    for s in range(4):
        mine = [c for c in split if of[c][1] == s]
        avg = sum(len(split[c]) for c in mine) / len(mine)
        for c in mine:
            for q, ws in asked.items():
                met = [w for w in set(ws) if w in split[c]]
                if met:
                    parts = [math.log(len(mine) / sum(w in split[x] for x in mine)) * (tf := split[c].count(w)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(split[c]) / avg)) for w in met]
                    score[q, c] = (round(1000 * sum(parts), 6), round(sum(round(1 + math.log(split[c].count(w)), 9) for w in met), 6))

    def best(route, by, k, once=False):
        out, seen = [], {}
        for (q, c), v in sorted(score.items(), key=lambda x: (x[0][0], -x[1][route], x[0][1])):
            group = (q, of[c][1]) if by else q
            held = seen.setdefault(group, [])
            if len(held) < k and not (once and of[c][0] in held):
                held.append(of[c][0])
                out.append((q, c, pytest.approx(v[route], abs=2e-6)))
        return sorted(out, key=lambda x: x[:2])

    for block in (1000, 4):
        monkeypatch.setattr(recall, "QUERY_BLOCK", block)
        for how, want in (({}, best(0, False, 5)), ({"by_dataset": True}, best(0, True, 3)), ({"by_dataset": True, "per_document": True}, best(0, True, 3, True)), ({"route": "sparse"}, best(1, False, 5))):
            got = recall.lexical(index, queries, 3 if how.get("by_dataset") else 5, **how).collect()
            assert sorted((r.query_id, r.chunk_id, r.score) for r in got) == want


def test_grams_against_sets(spark):
    rows = [(1, "燃煤锅炉，以及 天然气 Meter!", "a", "天然气锅炉与 meter"), (2, "x", "b", ""), (3, None, "c", None), (4, "ab, cd", "d", "xxabxx")]
    df = spark.createDataFrame(rows, "query_id long, query string, chunk_id string, content string")
    got = {r.query_id: r for r in ranking.grams(df, list(ranking.GRAM_COLUMNS)).collect()}
    for q, query, _, content in rows:
        a, b = (ranking._normal(t or "") for t in (query, content))
        sets = [[{t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b)] for n in (2, 3)]
        for n, name in enumerate(("query_bigram_coverage", "query_trigram_coverage")):
            assert got[q][name] == (len(sets[n][0] & sets[n][1]) / len(sets[n][0]) if sets[n][0] else 0.0)
        assert set(got[q].met_bigrams) == sets[0][0] & sets[0][1] and len(got[q].content_bigrams) == len(sets[0][1]) and set(got[q].content_bigram_texts) == sets[0][1]
    assert got[1].condition_coverage == 0.5 and got[4].condition_coverage == 0.5 and got[2].condition_coverage == 0


def test_a_model_scores_the_features(spark):
    rows = [(1, "a", 1, 0.9, 2.0, None, "x", "y"), (1, "b", 1, 0.2, None, 3.0, "x", "y")]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, doc_id long, dense double, sparse double, bm25 double, content string, query string")
    worst_first = ranking.rank_by(ranking.features(df), lambda m: -m[:, ranking.FEATURES.index("dense_score")]).collect()
    assert [r.chunk_id for r in sorted(worst_first, key=lambda r: r.rank)] == ["b", "a"]
    with pytest.raises(Exception, match="not finite"):
        ranking.rank_by(ranking.features(df), lambda m: m[:, 0] * float("nan")).collect()


def test_stored_index_follows_its_files(spark, tmp_path):
    """A table that is written anew under the same path is indexed anew, and the index before is deleted."""
    from fathomline.plans import recall as plans
    from fathomline.sources import shared

    rows = [(i, f"alpha beta gamma{i}", "en", "src0", 10) for i in range(8)]
    spark.createDataFrame([(1, "alpha gamma3 gamma4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def found(documents):
        spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return {r.doc_id for r in plans.bm25_topk(spark, str(tmp_path)).collect()}

    assert found(rows) == set(range(8))
    before = dict(shared._KEPT)
    assert found(rows[::2]) == {0, 2, 4, 6}
    (key,) = [k for k in shared._KEPT if str(tmp_path) in k[1]]
    assert shared._KEPT[key] != before[key]
    again = shared._KEPT[key]
    plans.bm25_topk(spark, str(tmp_path)).collect()
    assert shared._KEPT[key] == again  # nothing changed, nothing is made anew
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        spark.read.parquet(before[key][1]).count()


def test_index_counts_terms_where_the_chunk_is(spark):
    """Terms by count, then by term, with the dataset's statistics; no exchange moves postings, only the statistics travel."""
    rows = [("1:0", 1, 7, "b a b ß 🙂x c"), ("1:1", 1, 7, "a"), ("2:0", 2, 8, "..."), ("3:0", 3, None, "a"), ("4:0", 4, 7, None)]
    index = recall.stored_index(spark.createDataFrame(rows, "chunk_id string, doc_id long, dataset_id int, content string"))
    got = {r.chunk_id: (r.terms, r.tfs, r.n_chunks, r.norm) for r in index.collect()}
    assert got == {"1:0": (["b", "a", "c", "x", "ß"], [2, 1, 1, 1, 1], 2, pytest.approx(1.2 * (0.25 + 0.75 * 6 / 3.5))), "1:1": (["a"], [1], 2, pytest.approx(1.2 * (0.25 + 0.75 / 3.5)))}
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan
