"""The pipeline's stages on odd rows and, at small scale, against brute force."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm import cases
from tests.llm.test_similar import brute_force

SF = "/root/testdata/sf0.001"


def test_stage_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "mix_sources", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["odd", "none"])
def test_every_stage_takes_odd_rows(spark, name):
    docs = cases.docs(spark) if name == "odd" else cases.no_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns[0] == "doc_id"


def test_run_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = {r["doc_id"] for r in stages["language_id"](spark, docs, SF).collect()}
    assert len(known) >= 0.97 * docs.count()
    first = {}
    for r in docs.orderBy("doc_id").collect():
        if r["doc_id"] in known:
            first.setdefault(cases.normal(r["text"]), r)
    _, want = brute_force([(r["doc_id"], r["text"]) for r in first.values()])

    pieces = corpus_pipeline.run(spark, SF).cache()
    got = {r[0] for r in pieces.select("doc_id").distinct().collect()}
    assert got <= want and len(got) > len(want) / 2  # the mix leaves some out
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert whole.where("n > 2048 or n & (n - 1) <> 0 and n < 1980").count() == 0
    again = corpus_pipeline.run(spark, SF)
    count = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg(F.sum("length")).collect()))
    assert count(again) == count(pieces)
    pieces.unpersist()
