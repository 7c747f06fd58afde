"""What a Python task of the pipeline gets at once does not grow with the length of texts."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordvol.llm import _common

SF = "/root/testdata/sf0.001"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])


@pytest.mark.parametrize("name", ["language_id", "simhash_near_dedup", "pack"])
def test_stages_hand_long_texts_to_python_in_small_batches(spark, name):
    spark.conf.unset(BYTES)
    try:
        long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcd "), 2000).alias("text"))
        assert dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{SF}/documents.parquet").limit(20), SF).count()
        got = [r["n"] for r in long.mapInArrow(sizes, "n long").collect()]
        assert sum(got) > 25 << 20 and max(got) <= _common.BATCH_BYTES + 20_000
    finally:
        spark.conf.unset(BYTES)


def test_memory_of_a_slice_goes_back_before_the_next(monkeypatch):
    given = []
    pool = type("Pool", (), {"release_unused": lambda self: given.append(1)})()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)
    batch = pa.RecordBatch.from_arrays([pa.array(["abcd"] * 5)], names=["text"])
    assert [len(given) for _ in _common.slices(batch, 0, 8)] == [0, 1, 2] and len(given) == 3
