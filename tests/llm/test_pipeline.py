"""The pipeline's stages, and the queries that have SQL."""

import oracle
import pytest

import corpus_pipeline
from verdigris.llm import neardup
from verdigris.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf_dir, name):
    oracle.same(oracle.connection(sf_dir), Q.queries()[name](spark, sf_dir), Q.oracle_sql()[name])


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.5 * len(ids)
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "minhash_near_dedup":
            assert all(r.kept for r in neardup.near_duplicates(docs).collect())
        ids = now
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
