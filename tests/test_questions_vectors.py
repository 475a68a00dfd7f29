"""Questions parsed by aliases against a naive reading; the vector store's versions, replays and compactions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fathomline.operators import questions, recall
from fathomline.sources.vectors import VectorStore


def naive(text, aliases):
    low = text.lower()
    if not any(w in low for w in ("排放因子", "因子", "gwp", "emission factor")):
        return None
    year = re.search(r"(?<!\d)(20\d{2})(?!\d)", text)
    best = {}
    for term, field, value in aliases:
        if term and term.lower() in low:
            key = (-len(term), term.lower(), value)
            if field not in best or key < best[field]:
                best[field] = key
    gas = best["gas"][2] if "gas" in best else next((g for g in ("CO2E", "CO2", "CH4", "N2O", "HFC", "PFC", "SF6") if g.lower() in low), None)
    code = next((c for words, c in questions.TABLES if any(w in low for w in words)), None)
    activity = best["activity_name"][2] if "activity_name" in best else None
    return (int(year[1]) if year else None, code, activity, gas) if activity or code in ("gwp", "electricity") else None


def test_parsed_against_a_naive_reading(spark):
    rng = random.Random(2)
    parts = ["天然气", "无烟煤", "2023年", "120231", "排放因子", "GWP", "co2e", "CH4", "电力", "货车运输", "diesel", "Diesel oil", "emission factor", " ", "x", "因子", "sf6", "2019"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(300)]
    aliases = [("天然气", "activity_name", "Natural Gas"), ("气", "activity_name", "Gas"), ("Diesel", "activity_name", "Diesel"), ("diesel oil", "activity_name", "Diesel Oil"), ("煤", "activity_name", "Coal"), ("烟煤", "activity_name", "Bituminous"), ("二氧化碳", "gas", "CO2"), ("co2e", "gas", "CO2e total"), ("x", "other", "y"), ("", "gas", "never")]
    got = questions.parsed(spark.createDataFrame(list(enumerate(texts)), "question_id int, question string"), spark.createDataFrame(aliases, "term string, field_name string, canonical_value string")).collect()
    assert {r.question_id: (r.edition_year, r.table_code, r.activity, r.gas) for r in got} == {k: n for k, t in enumerate(texts) if (n := naive(t, aliases))}


POINT = "chunk_id string, doc_id long, dataset_id int, version long, embedding array<double>"


def dense(store):
    return {r.chunk_id: (r.version, list(r.embedding)) for r in store.points("dense").collect()}


def test_versions_replays_and_compactions(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    assert dense(store) == {}

    def rows(*points):
        return spark.createDataFrame([(c, 1, d, v, e) for c, d, v, e in points], POINT)

    first = rows(("a", 1, 1, [1.0, 0.0]), ("b", 2, 5, [0.0, 1.0]), ("c", None, 1, [0.5, 0.5]))
    store.upsert_dense(first)
    want = {"a": (1, [1.0, 0.0]), "b": (5, [0.0, 1.0]), "c": (1, [0.5, 0.5])}
    assert dense(store) == want
    store.upsert_dense(first)  # a replay
    store.upsert_dense(rows(("b", 2, 4, [9.0, 9.0])))  # stale
    assert dense(store) == want
    for step in range(3):
        store.compact()
        assert dense(store) == want
        store.upsert_dense(rows(("a", 1, 2 + step, [float(step), 1.0])))
        want["a"] = (2 + step, [float(step), 1.0])
        assert dense(store) == want
    assert len(store._names("bases")) == 2  # the base before the newest is kept for readers that are under way
    store.delete(rows(("b", 2, 6, [0.0])).drop("embedding"), "dense")
    assert sorted(dense(store)) == ["a", "c"]
    store.upsert_dense(rows(("b", 2, 7, [3.0])))
    assert dense(store)["b"] == (7, [3.0])


def test_kinds_are_apart_and_weights_are_cleaned(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    store.upsert_dense(spark.createDataFrame([("a", 1, 1, 1, [1.0])], POINT))
    sparse = spark.createDataFrame([("a", 1, 1, 9, [7, 3, 3, 5, 1], [0.5, 0.2, 0.9, float("nan"), -1.0]), ("z", 1, 1, 1, [1], [0.1])], "chunk_id string, doc_id long, dataset_id int, version long, indices array<int>, weights array<double>")
    store.upsert_sparse(sparse, most=2)
    got = {r.chunk_id: (r.indices, [round(w, 3) for w in r.weights]) for r in store.points("sparse").collect()}
    assert got == {"a": ([3, 7], [0.9, 0.5]), "z": ([1], [0.1])} and dense(store) == {"a": (1, [1.0])}
    store.delete(sparse.where("chunk_id = 'a'"), "dense")
    assert dense(store) == {} and store.points("sparse").count() == 2
    for bad in ([], [float("inf")], [float("nan")], None):
        with pytest.raises(Exception, match="no finite vector"):
            store.upsert_dense(spark.createDataFrame([("b", 1, 1, 1, bad)], POINT))
    assert dense(store) == {}


def test_a_lost_compaction_changes_nothing(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    store.upsert_dense(spark.createDataFrame([("a", 1, 1, 1, [1.0])], POINT))
    store._latest().write.partitionBy("dataset_id").parquet(f"{store.path}/bases/{1:012d}")  # and no more than that
    assert dense(store) == {"a": (1, [1.0])}
    store.compact()
    assert dense(store) == {"a": (1, [1.0])}


def test_dense_route_reads_the_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "v"))
    store.upsert_dense(spark.createDataFrame([(f"c{k}", k, k % 2, 1, [float(k), 1.0]) for k in range(6)], POINT))
    index = store.points("dense").select(F.col("doc_id").alias("vec_id"), "dataset_id", "embedding")
    asked = spark.createDataFrame([(0, 0, [5.0, 1.0])], "query_id long, dataset_id int, embedding array<double>")
    assert [r.vec_id for r in recall.dense(index, asked, 2).orderBy("rank").collect()] == [5, 4]


def test_first_factors_meet_few_rows(spark):
    """Every question gets the first factors of its gas and year; factors are cut before they meet questions."""
    from fathomline.operators import structured

    factors = spark.createDataFrame([("R", 1993, "F" if n % 2 else None, "a", f"{n:03}") for n in range(60)] + [("A", 1993, "F", "b", "900")], "gas string, edition_year int, table_code string, activity_name string, source_row string")
    asked = spark.createDataFrame([(q, "R" if q % 2 else "A", 1993) for q in range(20)] + [(3, "R", 1993), (99, "N", 1993)], "question_id long, gas string, edition_year int")
    found = structured.first_factors(asked, factors, ["gas", "edition_year"], 5)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.question_id, r.place)):
        got.setdefault(r.question_id, []).append(r.source_row)
    assert got == {q: ["900"] if q % 2 == 0 else ["001", "003", "005", "007", "009"] if q != 3 else ["001", "001", "003", "003", "005"] for q in range(20)}
