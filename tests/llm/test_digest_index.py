"""The log-structured index over several batches, with filters that hold and filters that let nearly all pass."""

import random

import pytest
from pyspark.sql import functions as F
from tests.llm import cases

from recordvol.llm import exact_dedup
from recordvol.llm.exact_dedup import FANOUT, DigestIndex

LOG = "digest string, doc_id long, row_id long"


def batches():
    rng = random.Random(3)
    return [[(f"{rng.randrange(400 if b % 2 else 4000):04x}", rng.choice([None, *range(1000)]), 1000 * b + i) for i in range(150)] for b in range(2 * FANOUT + 1)]


def merged(rows):
    out = {}
    for digest, doc_id, row_id in rows:
        place, n = out.get(digest, (None, 0))
        own = (doc_id is None, doc_id or 0, row_id)
        out[digest] = (own if place is None else min(place, own), n + 1)
    return out


def found(df):
    rows = df.collect()
    out = {r["digest"]: ((r["first"]["no_id"], r["first"]["doc_id"] or 0, r["first"]["row_id"]), r["n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("bits", [None, 64])
def test_batches_are_merged_by_level_and_looked_up(spark, bits):
    index, seen = DigestIndex(spark, filter_bits=bits), []
    for i, rows in enumerate(batches()):
        log = spark.createDataFrame(rows, LOG)
        asked = log.select("digest").distinct()
        if i in (0, 3, len(batches()) - 1):
            want = {d: v for d, v in merged(seen).items() if d in {r[0] for r in rows}}
            assert found(index.known(asked)) == want
        index.add(log)
        seen += rows
    assert sorted(r.level for r in index.runs) == [0, 1, 1]
    assert found(index.compact()) == merged(seen) and len(index.runs) == 1


@pytest.mark.parametrize("bits", [None, 64])
def test_memtables_of_one_batch(spark, bits):
    rows = [r for b in batches()[:2] for r in b]
    index = DigestIndex(spark, filter_bits=bits)
    index.flush(spark.createDataFrame(rows, LOG), 3)
    assert len(index.runs) == 3 and found(index.compact()) == merged(rows)
    assert found(DigestIndex(spark).compact()) == {}


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "same text", None, s) for s in "zvxwy"] + [(2, "other", None, "a")] * 3
    docs = cases.docs(spark, rows)
    kept = {tuple(sorted(map(str, exact_dedup.deduplicate(docs.repartition(n).orderBy(F.rand(n))).select("doc_id", "source").collect()))) for n in (1, 3, 7)}
    assert len(kept) == 1 and len(kept.pop()) == 2
