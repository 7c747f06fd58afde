"""Hard negatives against brute force in plain integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordvol.llm import hard_negatives, queries

SF = "/root/testdata/sf0.001"


def brute(rows, is_anchor, positives=5, negatives=3, window=(50, 95)):
    """(anchor, positive, rank) -> (negative, positive's score, score) of rows (id, label, vector)."""
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    out = {}
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows)
        for p, positive, _ in [x for x in scored if x[2] == label and x[1] != a][:positives]:
            fits = [(i, -n) for n, i, other in scored if other != label and window[0] * -p <= 100 * -n <= window[1] * -p]
            for rank, (i, n) in enumerate(fits[:negatives], 1):
                out[a, positive, rank] = (i, -p, n)
    return out


def found(df):
    rows = df.collect()
    out = {(r["anchor_id"], r["positive_id"], r["rank"]): (r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_over_the_whole_table(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = brute(rows, lambda i: i % 50 == 0)
    assert want and found(queries.op12_hard_negatives(spark, SF)) == want


@pytest.mark.parametrize("part_rows", [7, 10_000])
def test_ties_equal_vectors_and_negative_scores(spark, part_rows):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-2, 3, 5).tolist()) for i in range(90)]  # many ties
    rows += [(100 + i, i % 2, [1.0, 2.0, 0.5, 0.0, -1.0]) for i in range(60)]  # one vector under two labels
    rows += [(200, 0, [0.0] * 5), (201, 1, [0.0] * 5), (202, 7, [1.0] * 5), (203, 1, [3000.0, -9000.5, 1e-9, 7.0, 8.0])]
    rows = [(i, label, [float(x) for x in v]) for i, label, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"q": F.lit("x"), "part": F.lit(1), "score": F.lit(0.5)})
    got = hard_negatives.mine(df.repartition(3), "vec_id % 5 = 0", part_rows=part_rows)
    assert found(got) == brute(rows, lambda i: i % 5 == 0)


def test_bounds_hold(spark):
    rng = np.random.default_rng(4)
    q = rng.integers(-150, 150, (400, 9))
    books = hard_negatives.fit(q)
    part = hard_negatives.Part(books, np.arange(400), np.zeros(400), q, *books.encode(q))
    lower, upper = part.bounds(q[:50], np.arange(400))
    score = q @ q[:50].T
    assert (lower <= score).all() and (score <= upper).all() and (upper - lower).mean() < 0.2 * (score.max() - score.min())


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 2, [1.0, 1.0]), (2, 3, [9.0, 9.0]), (None, 1, [1.0, 1.0]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 2, [nan, 1.0]), (6, 2, [None, 1.0]), (7, 2, [inf, 1.0]), (8, 1, [1.0]), (9, 1, [1e300, 0.0]), (0, 1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute([(0, 1, [1.0, 2.0]), (1, 1, [2.0, 2.0]), (2, 2, [1.0, 1.0])], lambda i: i == 0)
    assert want and found(hard_negatives.mine(df, "vec_id = 0")) == want
    assert hard_negatives.mine(df.where("false"), "vec_id = 0").count() == 0
    assert hard_negatives.mine(df.where("vec_id = 0"), "vec_id = 0").count() == 0
    assert hard_negatives.mine(df.withColumn("embedding", F.lit(None).cast("array<double>")), "vec_id = 0").count() == 0
