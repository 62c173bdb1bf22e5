"""The stages of the corpus pipeline on their own inputs, and what the driver reads from them."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basketry.llm import decontam, minhash, queries
from basketry.llm.common import Stored, table, texts
from tests.llm.test_dedup import brute_lines
from tests.llm.test_search_and_packing import pieces_ok

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(Stored(stage(spark, out[-1], SF), name).df)
    return out


def test_stages_keep_columns_and_only_drop_rows(outputs):
    for before, after in zip(outputs[:-2], outputs[1:-1], strict=True):
        assert after.columns == before.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0


def test_toxic_documents_go(spark, outputs):
    scores = queries.QUERIES["op6_trie_toxicity"](spark, SF)
    assert {r["doc_id"] for r in outputs[1].collect()} == {r["doc_id"] for r in scores.where("predicted = 0").collect()}


def test_line_stage_against_brute_force(outputs):
    named = [(r["doc_id"], r["text"], r["th"]) for r in texts(outputs[1]).collect()]
    want = {}
    for (i, _), (gone, n, _) in brute_lines(named, 2, 40).items():
        text = next(t for k, t, _ in named if k == i)
        if not gone or len(gone) < n:
            want[i] = "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)
    assert {r["doc_id"]: r["text"] for r in outputs[2].collect()} == want


def test_one_document_of_each_group_stays(outputs):
    kept = {r["doc_id"] for r in minhash.near_duplicates(outputs[2]).where("kept").collect()}
    assert {r["doc_id"] for r in outputs[3].collect()} == kept


def test_no_item_is_left(spark, outputs):
    items = [decontam.normal(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    left = {r["doc_id"] for r in outputs[4].collect()}
    for r in outputs[3].collect():
        exact = any(i in decontam.normal(r["text"]) for i in items)
        assert not (exact and r["doc_id"] in left)
    assert outputs[3].count() - len(left) < 0.2 * outputs[3].count()


def test_every_token_is_packed(outputs):
    pieces_ok(outputs[5].collect(), [(r["doc_id"], r["text"]) for r in outputs[4].collect()], 2048)


def test_run_gives_the_last_stage(spark, outputs):
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, ran.drop("sequence_id").groupBy("doc_id").agg(F.sum("length")).collect())) == sorted(map(tuple, outputs[5].groupBy("doc_id").agg(F.sum("length")).collect()))
    assert queries.QUERIES["pipeline"] is corpus_pipeline.run


def test_stages_hand_texts_over_in_small_batches(spark):
    was = spark.conf.get(corpus_pipeline.BATCHES)
    try:
        spark.conf.set(corpus_pipeline.BATCHES, 0)
        stage = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long"))
        rows = [r.n for r in stage(spark, spark.range(5000).coalesce(1), SF).collect()]
    finally:
        spark.conf.set(corpus_pipeline.BATCHES, was)
    assert sum(rows) == 5000 and max(rows) <= corpus_pipeline.BATCH_ROWS
    assert all(hasattr(f, "__wrapped__") for _, f in corpus_pipeline.STAGES)
