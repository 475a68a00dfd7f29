import numpy as np

import __spark_entry__
import corpus_pipeline
from fathomline.llm import packing, quality_trees, secret_ledger
from test_documents import W, classes

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names


def one_of_each(texts):
    """Smallest ids of the groups that five-word shingle sets with a Jaccard similarity of 0.8 or more link, by all pairs."""
    sets = {}
    for i, t in texts.items():
        words = W.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return sorted(set(classes(ids, near).values()))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.quality(spark, docs, SF)
    trees = quality_trees.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {i for i, r in before.items() if not quality_trees._failed(np.array([quality_trees.statistics((r.text or "").encode())[0]]))[0]}
    good = {r.doc_id for r in kept.collect()}
    assert kept.columns == COLUMNS and good <= want and trees is not None
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    ids = sorted(r.doc_id for r in one.collect())
    assert one.columns == COLUMNS and ids == one_of_each({r.doc_id: r.text for r in kept.collect()})
    masked = corpus_pipeline.secrets(spark, one, SF)
    assert masked.columns == COLUMNS and all(not secret_ledger.find_spans(r.text) for r in masked.collect())
    mixed = corpus_pipeline.mix(spark, masked, SF)
    assert mixed.columns == COLUMNS and {r.doc_id for r in mixed.collect()} <= set(ids)
    packed = corpus_pipeline.pack(spark, mixed, SF)
    assert packed.where("piece = 0").count() == mixed.count() and packed.agg({"length": "max"}).first()[0] <= packing.CAPACITY


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_stages_over_awkward_rows(spark, tmp_path):
    """Null ids, nulls in every column, empty and repeated rows, extra columns; and an empty table."""
    text = " ".join(f"word{k} and{k % 7}." for k in range(90))
    rows = [(1, text, "en", "a", 9, "x"), (1, text, "en", "a", 9, "x"), (None, text, None, None, None, None), (None, text, None, None, None, None), (2, None, None, None, None, None), (3, "", "en", None, 0, None), (4, text + " password=hunter2hunter", "en", "b", 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, root string")
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, str(tmp_path))
            assert at.columns == docs.columns, name
            at = spark.createDataFrame(at.collect(), docs.schema)
            if name == "simhash near-dedup" and table is docs:
                assert sorted(str(r.doc_id) for r in at.collect()) == ["1", "None", "None"]
        packed = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path))
        assert packed.where("piece = 0").count() == at.count()
