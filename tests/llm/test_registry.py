"""Queries against their SQL twins, contracts of columns, and the pipeline against a plain version."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from llm import common, decontamination, mixing, ngram_join, personal_data, queries, toxicity
from pyspark.sql import functions as F
from tests.check import database, difference

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ngram_jaccard_join": {"doc_id", "n_shingles", "component_id"},
    "op3_benchmark_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op7_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op8_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op9_lz_fingerprint": {
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op10_source_mixing": {"doc_id", "size", "source_size", "target", "taken"},
}


def test_all_are_registered():
    assert [sum(name.startswith(f"op{n}_") for name in queries.QUERIES) for n in range(1, 14)] == [1] * 13
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twin(spark, name):
    assert difference(name, queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(queries.SQL)))
def test_columns_and_rows(spark, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    assert COLUMNS[name] <= set(frame.columns)
    assert frame.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_pipeline_against_its_stages(spark):
    """run() gives what the operators' decisions leave, taken one by one."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = {r.doc_id: r.asDict() for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "personal_data", "source_mixing"]

    def frame():
        return spark.createDataFrame([tuple(r.values()) for r in left.values()], docs.schema)

    for r in toxicity.score(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).where("predicted = 1").collect():
        left.pop(r.doc_id)
    for r in ngram_join.joined_sets(frame()).collect():
        if r.n_shingles and r.component_id != r.doc_id:
            left.pop(r.doc_id)
    for r in decontamination.contaminated(frame(), spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("n_hit > 0").collect():
        left.pop(r.doc_id)
    for r in personal_data.personal_data(frame()).collect():
        text, at, new = left[r.doc_id]["text"] or "", 0, ""
        for s in r.spans:
            new, at = new + text[at : s.start] + f"[{s.kind.upper()}]", s.end
        left[r.doc_id]["text"] = new + text[at:]
        left[r.doc_id]["n_chars"] = len(left[r.doc_id]["text"])
    want = sorted(
        (r.doc_id, left[r.doc_id]["text"], copy) for r in mixing.mix(mixing.by_source(frame())).collect() for copy in range(1, r.times + 1)
    )
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == [*docs.columns, "copy"]
    assert sorted((r.doc_id, r.text, r.copy) for r in got.collect()) == want
    assert got.where(F.col("n_chars") != F.length("text")).count() == 0


def test_stages_take_edges(spark, edges, empty):
    for rows in (edges, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, FOLDER)
            assert out.columns[: len(rows.columns)] == rows.columns, name
            assert out.count() <= 2 * rows.count()
    assert common.stage(edges, "edges").count() == edges.count()
