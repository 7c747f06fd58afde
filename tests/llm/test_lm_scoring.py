"""Language-model scores: exact parts against plain counts, the filter's levels, both ways of lookup."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import cases

from recordvol.llm import lm_scoring as lm
from recordvol.llm import queries

SF = "/root/testdata/sf0.001"
END = "\n"


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", text), END]


def level(c):
    return int((lm.LEAST <= c).sum())


def plain(training, texts, order):
    """n_tokens, n_known, base and score of texts, with exact counts put into levels."""
    counts = [Counter() for _ in range(order)]
    for t in training:
        own = [END, *tokens(t)]
        counts[0].update(own[1:])
        for n in range(2, order + 1):
            counts[n - 1].update(tuple(own[i : i + n]) for i in range(len(own) - n + 1))
    total, different = sum(counts[0].values()), len(counts[0])
    divisor = total + 0.5 * (different + 1)
    mean = lambda n, g: float(lm.VALUE[level(counts[n - 1][g])])
    out = []
    for t in texts:
        own, base, score = [END, *tokens(t)], 0.0, 0.0
        for i, w in enumerate(own[1:], 1):
            base += math.log10((counts[0][w] + 0.5) / divisor)
            p = (mean(1, w) + 0.5) / divisor
            for n in range(2, min(order, i + 1) + 1):
                g = tuple(own[i - n + 1 : i + 1])
                before = mean(n - 1, g[:-1] if n > 2 else g[0])
                p = (min(mean(n, g), before) + lm.MU * p) / (before + lm.MU)
            score += math.log10(p)
        out.append((len(own) - 1, sum(counts[0][w] > 0 for w in own[1:]), total, base, score))
    return out


def close(found, want):
    """Exact parts agree, the score about: a wrong level changes the score of every repeat of an n-gram."""
    assert found[:3] == want[:3]
    assert found[3] == pytest.approx(want[3], rel=1e-9, abs=1e-9) and found[4] == pytest.approx(want[4], rel=0.15, abs=1.0)


def values(r):
    return r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows}
    want = dict(zip((r["doc_id"] for r in rows), plain([r["text"] for r in rows if not held[r["doc_id"]]], [r["text"] for r in rows], lm.ORDER)))
    found = {r["doc_id"]: r for r in queries.op11_lm_scoring(spark, SF).collect()}
    assert set(found) == set(want)
    better, near = [], []
    for k, r in found.items():
        assert r["held_out"] == held[k]
        close(values(r), want[k])
        near.append(abs(r["score"] - want[k][4]) <= max(0.01 * abs(want[k][4]), 0.5))
        if r["held_out"]:
            better.append((r["score"] - r["base_score"]) / r["n_tokens"])
    assert np.mean(better) > 0 and np.mean(near) > 0.97


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_odd_texts_in_every_order(spark, order):
    docs = cases.docs(spark)
    training = docs.where("doc_id is null or doc_id % 2 = 0")
    rows = docs.collect()
    want = plain([r["text"] for r in training.collect()], [r["text"] for r in rows], order)
    model = lm.fit(training.repartition(3), order)
    got = lm.score(docs.repartition(2), model, F.lit(False)).collect()
    key = lambda x: tuple(round(v, 6) for v in x[:4])
    for a, b in zip(sorted(map(values, got), key=key), sorted(want, key=key)):
        close(a, b)


@pytest.mark.parametrize("top", [0, 50])
def test_sent_to_segments_and_joined_counts_give_the_same(spark, top):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(cases.docs(spark).select("doc_id", "text"))
    one, other = lm.fit(docs), lm.fit(docs, top=top)
    assert len(other.top[0]) <= top < len(one.top[0])
    a = lm.score(docs, one, F.lit(True))
    b = lm.score(docs.repartition(5), other, F.lit(True), most_bytes=0)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["score"], 6))
    for x, y in zip(sorted(a.collect(), key=key), sorted(b.collect(), key=key), strict=True):
        assert values(x) == pytest.approx(values(y), rel=1e-9) and x["doc_id"] == y["doc_id"]


def test_filter_never_misses_and_rarely_invents():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 1 << 63, 40_000).astype(np.uint64)
    n = np.maximum(1, rng.pareto(1.0, len(x)).astype(np.int64))
    bits = lm.segment(x[:30_000], n[:30_000])[0]
    f = lm.Filter.of([(0, bits)], 1, len(bits))
    found, want = f.levels(x[:30_000]), np.searchsorted(lm.LEAST, n[:30_000], side="right")
    assert (found >= want).all() and (found > want).mean() < 0.02 and (f.levels(x[30_000:]) > 0).mean() < 0.02
    assert (lm.Filter.of([], 4, 0).levels(x) == 0).all()


def test_nothing_to_learn_and_no_rows(spark):
    docs = cases.docs(spark)
    model = lm.fit(docs.where("false"))
    for r in lm.score(docs, model, F.lit(True)).collect():
        assert r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == pytest.approx(0) and r["score"] == pytest.approx(0)
    assert lm.score(docs.where("false"), lm.fit(docs), F.lit(True)).count() == 0
    assert lm.score(docs.where("false"), lm.fit(docs), F.lit(True), most_bytes=0).count() == 0
