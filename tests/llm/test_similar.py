"""The pipeline's near-duplicate stage against brute force over shingle sets."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import cases

from recordvol.llm import simhash

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def brute_force(rows):
    """Pairs of ids at similarity 0.8 or more, and the ids that stay: the smallest one of each group."""
    sets = [(r[0], shingle_set(r[1])) for r in sorted(rows)]
    top = {i: i for i, _ in sets}
    pairs = [(i, j) for n, (i, a) in enumerate(sets) for j, b in sets[n + 1 :] if similarity(a, b) >= 0.8]
    for i, j in pairs:
        a, b = sorted((top[i], top[j]))
        top = {k: a if v == b else v for k, v in top.items()}
    return pairs, set(top.values())


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.random()}"
    return out


def test_stage_finds_near_copies_down_to_similarity(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):  # 1 to 8 of 200 words replaced: similarities of about 0.95 to 0.65
        words = [f"w{rng.randrange(3000)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(words, 1 + i % 8, rng)))]
    hub = [f"w{rng.randrange(3000)}" for _ in range(300)]  # its copies are near to it, hardly one to another
    rows += [(500, " ".join(hub))] + [(501 + i, " ".join(edited(hub, 5, rng))) for i in range(40)]
    pairs, want = brute_force(rows)
    assert 50 < len(pairs) and len(want) < len(rows) - 50
    docs = cases.docs(spark, [(i, t, "en", "a") for i, t in rows])
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = {r["doc_id"] for r in stage(spark, docs, SF).collect()}
    assert want <= got  # nothing below the similarity goes
    assert len(got - want) <= 0.02 * (len(rows) - len(want))


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    _, want = brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r["doc_id"] for r in stage(spark, docs, SF).collect()} == want


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 16])
def test_large_bucket_in_pieces_gives_a_spanning_tree(spark, bucket):
    rng = np.random.default_rng(2)
    nodes = [(i, int(x), [1]) for i, x in enumerate(rng.integers(-(2**63), 2**63, 100))]
    placed = spark.createDataFrame(nodes, "h long, fp long, bands array<long>")
    found = simhash._near(placed, simhash._buckets(placed), bucket).collect()
    cost = {tuple(sorted((i, j))): (x ^ y & 2**64 - 1) for i, x, _ in nodes for j, y, _ in nodes}
    cost = {k: bin(v & 2**64 - 1).count("1") for k, v in cost.items()}

    def tree(links):
        top, total = list(range(100)), 0
        for a, b in sorted(links, key=cost.get):
            if top[a] != top[b]:
                top, total = [top[a] if t == top[b] else t for t in top], total + cost[a, b]
        return len(set(top)), total

    assert tree([tuple(r) for r in found]) == tree([k for k in cost if k[0] < k[1]])


@pytest.mark.parametrize("part_bytes", [simhash.PART_BYTES, 1 << 16])
def test_large_bucket_of_borderline_copies_loses_no_link(spark, monkeypatch, part_bytes):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]  # 3 of 200 words replaced: few of the pairs are at 0.8, none far below
    rows = [(i, " ".join(edited(base, 3, rng))) for i in range(250)]
    pairs, want = brute_force(rows)
    assert len(pairs) < 2000 and 10 < len(want) < 100
    docs = cases.docs(spark, [(i, t, "en", "a") for i, t in rows])
    monkeypatch.setattr(simhash, "PART_BYTES", part_bytes)
    assert {r["doc_id"] for r in simhash.deduplicate_similar(docs).collect()} == want


def test_exact_overlaps_join_what_brute_force_joins():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.choice(60, rng.integers(0, 50))).astype("<u8") for _ in range(120)] + [np.zeros(0, "<u8")]
    root = np.array([7 * (i % 40) for i in range(121)])
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.6 * len(np.union1d(a, b))
    links = list(simhash._apart(sets, root, 0.6))
    assert all(alike(sets[i], sets[j]) for i, j in links)

    def groups(pairs):
        top = list(root)
        for i, j in pairs:
            a, b = top[i], top[j]
            top = [min(a, b) if t in (a, b) else t for t in top]
        return top

    every = [(i, j) for i in range(121) for j in range(i) if alike(sets[i], sets[j])]
    assert groups(links) == groups(every) and len(set(groups(every))) > 1


def test_copies_in_many_rows_and_odd_rows(spark):
    docs = cases.docs(spark)
    kept = simhash.deduplicate_similar(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in docs.where(F.col("doc_id").isNotNull()).collect()]
    assert {r["doc_id"] for r in kept.collect()} == brute_force(dict(rows).items())[1]
    assert simhash.deduplicate_similar(cases.no_docs(spark)).count() == 0
