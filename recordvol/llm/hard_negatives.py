"""Hard negatives by product quantisation with stored residual norms; results are exact.

A vector's components become integers, floor(SCALE * x), and its score with an anchor is their
integer inner product. Codebooks of whole numbers are fitted on at most SAMPLE vectors, one for each
pair of dimensions; every vector is stored with its codes and, for each pair, the norm of what the
codebook's entry leaves. An anchor's table of products with all entries gives a vector's score by
lookups, and the sum over pairs of both norms bounds how far the true score can be from it
(Cauchy-Schwarz). So lower and upper bounds are rigorous: only vectors whose upper bound reaches the
k-th best lower bound, inside the window asked for, are multiplied out in integers.

Vectors are dealt out in parts of about PART rows, and the anchors, which are the stated query set,
meet every part in blocks of BLOCK; a part gives an anchor its best few rows at most, and a ranked
window keeps the best over all parts. The first pass finds positives, the second looks for negatives
in the window that each positive's score opens. Of vectors that are equal and have one label, only
as many as a result can need (by smallest identifier) are compared, so one vector that a third of
all rows share costs a few rows.

Defined results: rows with a null identifier, label or vector, with a null or non-finite component,
of another length than most, or with a component too large for integer products of 62 bits take no
part; zero vectors take part; of rows that repeat an identifier the one of the smallest label, then
vector, counts; ties go to the smaller identifier; an anchor without positives, a positive without
negatives and an empty table give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.llm._common import spread, stored

#: Vectors the codebooks are fitted on, dimensions of a pair, entries of a codebook, rounds of fitting.
SAMPLE, PAIR, ENTRIES, ROUNDS = 20_000, 2, 256, 12
#: Rows of a part about, and anchors compared with a part at once.
PART, BLOCK = 16_384, 64
SCALE = 256

ROW = "part int, role int, id long, label long, q binary, codes binary, norms binary, windows array<long>"


@dataclass(frozen=True)
class Books:
    """Entries of whole numbers for each pair of dimensions: pairs, ENTRIES, PAIR (padded with zeros)."""

    entries: np.ndarray

    @property
    def pairs(self) -> int:
        return len(self.entries)

    def cut(self, q: np.ndarray) -> np.ndarray:
        """Vectors as pairs of dimensions: pairs, vectors, PAIR."""
        wide = np.zeros((len(q), self.pairs * PAIR), np.int64)
        wide[:, : q.shape[1]] = q
        return wide.reshape(len(q), self.pairs, PAIR).transpose(1, 0, 2)

    def encode(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and, rounded up, norms of what they leave."""
        codes, norms = np.zeros((len(q), self.pairs), np.uint8), np.zeros((len(q), self.pairs), np.float32)
        for m, (own, entries) in enumerate(zip(self.cut(q), self.entries)):
            for i in range(0, len(q), 4096):
                left = (own[i : i + 4096, None, :] - entries[None]).astype(float)
                far = np.einsum("ijk,ijk->ij", left, left)
                best = far.argmin(axis=1)
                codes[i : i + 4096, m] = best
                norms[i : i + 4096, m] = np.nextafter(np.sqrt(far[np.arange(len(best)), best]).astype(np.float32) * np.float32(1 + 1e-6), np.float32(np.inf))
        return codes, norms


def fit(sample: np.ndarray, seed: int = 1) -> Books:
    """Codebooks by k-means over each pair of dimensions, rounded to whole numbers."""
    rng = np.random.default_rng(seed)
    books = Books(np.zeros((-(-sample.shape[1] // PAIR), ENTRIES, PAIR), np.int64))
    for m, own in enumerate(books.cut(sample)):
        points = own.astype(float)
        centres = points[rng.choice(len(points), ENTRIES, replace=len(points) < ENTRIES)]
        for _ in range(ROUNDS):
            near = np.concatenate([((p[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) for p in np.array_split(points, -(-len(points) // 4096))])
            n = np.bincount(near, minlength=ENTRIES)
            sums = np.stack([np.bincount(near, points[:, d], ENTRIES) for d in range(PAIR)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        books.entries[m] = np.rint(centres)
    return books


@dataclass(frozen=True)
class Part:
    """The rows of a part, with codes and residual norms."""

    books: Books
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    codes: np.ndarray
    norms: np.ndarray

    def bounds(self, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of rows (down) with anchors (across)."""
        cut = self.books.cut(q)
        score = np.zeros((len(rows), len(q)), np.int64)
        for m in range(self.books.pairs):
            score += (self.books.entries[m] @ cut[m].T)[self.codes[rows, m]]
        lengths = np.sqrt((cut.astype(float) ** 2).sum(axis=2))
        far = self.norms[rows].astype(float) @ lengths * (1 + 1e-9) + 1 + np.abs(score) * 1e-12
        return score - far, score + far

    def best(self, q: np.ndarray, anchor_ids: np.ndarray, rows: np.ndarray, maybe: np.ndarray, lower: np.ndarray, upper: np.ndarray, sure: np.ndarray, k: int, low: np.ndarray | None = None, high: np.ndarray | None = None):
        """Anchor, row and exact score of each anchor's k best rows among `maybe`, of scores from low to high.

        Rows in `sure` have such a score whatever the bounds hide; their k-th best lower bound is
        what an upper bound must reach.
        """
        if len(rows) > k:
            reached = np.partition(np.where(sure, lower, -np.inf), len(rows) - k, axis=0)[len(rows) - k]
            maybe = maybe & (upper >= reached)
        r, a = np.nonzero(maybe)
        score = np.zeros(len(r), np.int64)
        for i in range(0, len(r), 65536):
            score[i : i + 65536] = np.einsum("ij,ij->i", self.q[rows[r[i : i + 65536]]], q[a[i : i + 65536]])
        if low is not None:
            inside = (score >= low[a]) & (score <= high[a])
            r, a, score = r[inside], a[inside], score[inside]
        order = np.lexsort((self.ids[rows[r]], -score, a))
        r, a, score = r[order], a[order], score[order]
        first = np.searchsorted(a, a, side="left")
        top = np.arange(len(a)) - first < k
        return a[top], rows[r[top]], score[top]


def _positives(part: Part, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, windows: list, k: int) -> Iterator[tuple]:
    for label in np.unique(labels).tolist():
        (rows,), (own,) = np.nonzero(part.labels == label), np.nonzero(labels == label)
        if len(rows):
            lower, upper = part.bounds(q[own], rows)
            other = part.ids[rows][:, None] != ids[own][None]
            a, r, score = part.best(q[own], ids[own], rows, other, lower, upper, other, k)
            yield ids[own][a], part.ids[r], score, None, None


def _negatives(part: Part, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, windows: list, k: int) -> Iterator[tuple]:
    rows = np.arange(len(part.ids))
    lower, upper = part.bounds(q, rows)
    different = part.labels[:, None] != labels[None]
    for j in range(max(map(len, windows)) // 4):
        (has,) = np.nonzero([len(w) > 4 * j for w in windows])
        low, high, positive, best = np.array([windows[i][4 * j : 4 * j + 4] for i in has]).T
        lo, up, other = lower[:, has], upper[:, has], different[:, has]
        maybe, sure = other & (lo <= high) & (up >= low), other & (lo >= low) & (up <= high)
        a, r, score = part.best(q[has], ids[has], rows, maybe, lo, up, sure, k, low, high)
        yield ids[has][a], part.ids[r], score, positive[a], best[a]


def _compared(books, dims: int, find, k: int):
    """Rows of a part (role 0), then anchors in blocks (role 1), in the order of the stream."""

    def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, part = None, [], None
        for batch in batches:
            parts, roles = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((np.diff(parts) != 0) | (np.diff(roles) != 0)) + 1
            for start, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
                if start == end:
                    continue
                own = batch.slice(start, end - start)
                if parts[start] != at:
                    at, held, part = parts[start], [], None
                ids, labels, q = own.column(2).to_numpy(zero_copy_only=False), own.column(3).to_numpy(zero_copy_only=False), matrix(own.column(4), "<i8", dims)
                if roles[start] == 0:
                    held.append((ids, labels, q, matrix(own.column(5), "u1", books.value.pairs), matrix(own.column(6), "<f4", books.value.pairs)))
                    continue
                if part is None and held:
                    part, held = Part(books.value, *map(np.concatenate, zip(*held))), []
                windows = own.column(7).to_pylist()
                for i in range(0, len(ids) if part else 0, BLOCK):
                    block = slice(i, i + BLOCK)
                    for found in find(part, ids[block], labels[block], q[block], windows[block], k):
                        columns = [np.zeros(len(found[0]), np.int64) if c is None else c for c in found]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "vec_id", "score", "positive_id", "positive_score"])

    return compared


def _usable(vectors: DataFrame, label: Column, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """vec_id, label and embedding of the rows that take part, and the length of their vectors."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(F.forall("embedding", finite))
    lengths = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    dims = usual["n"] if usual else 0
    most = isqrt((1 << 62) // max(dims, 1)) / SCALE - 1
    rows = rows.where((F.size("embedding") == dims) & F.forall("embedding", lambda x: F.abs(x) <= most))
    once = Window.partitionBy("vec_id").orderBy("label", "embedding")
    return rows.withColumn("_rv_n", F.row_number().over(once)).where("_rv_n = 1").drop("_rv_n"), dims


def mine(
    vectors: DataFrame, is_anchor: str, label: Column | None = None, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), vec_id: str = "vec_id", embedding: str = "embedding", part_rows: int = PART
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that fit the SQL condition is_anchor (over vec_id). Their positives are the
    best `positives` others of their label; of each, the best `negatives` rows of other labels are
    returned whose score lies between window[0] and window[1] hundredths of the positive's.
    """
    spark = vectors.sparkSession
    rows, dims = _usable(vectors, F.col("label") if label is None else label, vec_id, embedding)
    rows = stored(rows, "vectors")
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    count = rows.count()
    if not count or not dims:
        return empty

    draw = F.xxhash64("vec_id", F.lit(5))
    share = min(1 << 40, int((1 << 40) * 1.2 * (SAMPLE + 50) / count))
    sample = rows.where(F.pmod(draw, F.lit(1 << 40)) < share).orderBy(draw, "vec_id").limit(SAMPLE).select("embedding").collect()  # at most SAMPLE rows
    books = spark.sparkContext.broadcast(fit(np.floor(SCALE * np.array([r[0] for r in sample] or [[0.0] * dims])).astype(np.int64)))  # pairs x ENTRIES x PAIR numbers

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = np.floor(SCALE * batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)).astype("<i8")
            codes, norms = books.value.encode(q)
            columns = [pa.array([x.tobytes() for x in c], pa.binary()) for c in (q, codes, norms.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["vec_id", "label", "q", "codes", "norms"])

    index = stored(rows.mapInArrow(indexed, "vec_id long, label long, q binary, codes binary, norms binary"), "index")
    parts = -(-count // part_rows)
    equal = Window.partitionBy("q", "label").orderBy("vec_id")
    needed = index.withColumn("_rv_n", F.row_number().over(equal)).where(F.col("_rv_n") <= max(positives + 1, negatives))
    none = F.lit(None).cast("array<long>")
    held = needed.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("role"), F.col("vec_id").alias("id"), "label", "q", "codes", "norms", none.alias("windows"))
    held = stored(held, "parts")
    anchors = index.where(is_anchor).select("vec_id", "label", "q")

    def compare(asked: DataFrame, find, k: int) -> DataFrame:
        asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("role"), F.col("vec_id").alias("id"), "label", "q", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("norms"), "windows")
        work = held.unionByName(asked).repartition(min(parts, 4 * spread(rows)), "part").sortWithinPartitions("part", "role", "id")
        return work.mapInArrow(_compared(books, dims, find, k), "anchor_id long, vec_id long, score long, positive_id long, positive_score long")

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    near = compare(anchors.withColumn("windows", none), _positives, positives)
    near = near.withColumn("_rv_n", F.row_number().over(best)).where(F.col("_rv_n") <= positives)
    hundredths = lambda share: F.col("score").cast("decimal(20,0)") * share / 100
    low, high = F.ceil(hundredths(window[0])).cast("long"), F.floor(hundredths(window[1])).cast("long")
    opened = near.select("anchor_id", F.array(low, high, F.col("vec_id"), F.col("score")).alias("w")).where("w[0] <= w[1]")
    opened = opened.groupBy("anchor_id").agg(F.flatten(F.array_sort(F.collect_list("w"))).alias("windows"))  # at most `positives` of four
    asked = stored(anchors.join(opened.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "windows")
    found = compare(asked, _negatives, negatives)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
