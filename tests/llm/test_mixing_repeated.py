"""Mixing where most rows are one and the same."""

from pyspark.sql import functions as F
from tests.llm import cases

from recordvol.llm import mixing


def test_repeated_rows_are_dealt_over_blocks_and_their_words_come_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rows = [(1, "the same row again", "en", "hot")] * 600 + [(2 + i, "w " * (1 + i % 9), "en", "b" if i % 2 else "hot") for i in range(400)]
    docs = cases.docs(spark, rows)
    got = mixing.plan(docs, block=50).collect()
    assert len(got) == 1000 and sum(r["doc_id"] == 1 for r in got) == 600
    for s in ("hot", "b"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) < 25, s
    sizes = mixing.numbered(docs.groupBy(F.lit(1).cast("long").alias("doc_id"), F.lit(2).cast("long").alias("h")).agg(F.count("*").alias("rows")), 50)
    assert sorted(r["place"] for r in sizes.collect()) == list(range(1000))
    mixed, got = mixing.mix(docs.repartition(5)), mixing.plan(docs).collect()
    assert mixed.count() == sum(r["copies"] for r in got if r["size"])
    assert mixed.where("doc_id = 1").count() == sum(r["copies"] for r in got if r["doc_id"] == 1)
