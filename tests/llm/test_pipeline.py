"""The pipeline's stages, each on what the one before kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm.common import written
from quillon.llm.near_duplicates import near_duplicates
from quillon.llm.secret_scan import secret_report

from ..conftest import DATA

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        out.append((name, before, docs))
    return out


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == [
        "quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "secret_scans", "packing",
    ]
    for _, before, after in stages[:-1]:
        assert after.schema.names == before.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]


def test_decisions_take_effect(spark, stages):
    by = {n: (a, b) for n, a, b in stages}
    docs, kept = by["quality_classifier"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert 0 < kept.count() < docs.count()
    clean = labels.where("quality = 1").join(docs, "doc_id")
    assert clean.join(kept, "doc_id", "left_anti").count() <= 0.02 * clean.count()
    before, after = by["minhash_near_dedup"]
    groups = near_duplicates(before)
    assert after.count() == groups.select("component_id").distinct().count()
    before, after = by["suffix_array_dedup"]
    assert after.count() == before.count()
    assert after.agg(F.sum(F.octet_length("text"))).first()[0] < before.agg(F.sum(F.octet_length("text"))).first()[0]
    _, after = by["secret_scans"]
    assert secret_report(after).where("n_assign + n_access + n_hex > 0").count() == 0
    assert after.where(F.char_length("text") != F.col("n_chars")).count() == 0
    before, pieces = by["packing"]
    assert pieces.select("doc_id").distinct().count() == before.count()


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).drop("sequence_id", "offset")
    want = stages[-1][2].drop("sequence_id", "offset")
    assert got.groupBy("doc_id").agg(F.sum("length")).exceptAll(want.groupBy("doc_id").agg(F.sum("length"))).count() == 0


def through(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.schema.names == before.schema.names, name
        yield name, docs


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert [(name, out.count()) for name, out in through(spark, docs)] == [(name, 0) for name, _ in corpus_pipeline.STAGES]


def test_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = docs.join(labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").orderBy("doc_id").limit(40)
    long = clean.agg(F.repeat(F.array_join(F.collect_list("text"), "\n"), 3)).first()[0]
    odd = [(None, "no key", None, None, None), (900001, None, None, "s", 0), (900002, "", "en", None, 0), (900002, "", "en", None, 0),
           (900003, long, "en", "s", len(long)), (None, None, None, None, None)]
    every = clean.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, docs.schema))
    # a column of each name that the stages use themselves
    every = every.selectExpr("*", "1 as _bits", "2 as stretches", "3 as row", "4 as body", "5 as component_id")
    told = dict(through(spark, every))
    kept = told["secret_scans"]
    assert kept.where("_bits = 1 and stretches = 2 and row = 3 and body = 4 and component_id = 5").count() == kept.count()
    # what has no key is never dropped by key
    assert kept.where("doc_id is null").count() == 2
    pieces = told["packing"]
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
