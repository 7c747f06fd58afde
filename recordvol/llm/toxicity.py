"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, word pairs and pairs with one word between,
hashed into 2^BITS places; a text's vector is the log-damped count of each place. Training keeps a
rate per coordinate and an L1 penalty, so most weights are exactly zero and what remains (index,
weight) is a small table: it is bounded by the number of places, 4 bytes each, and broadcast.

Fitting takes at most SAMPLE labelled documents of each class, drawn by hash. Several tasks train on
disjoint parts of it side by side, their weights are averaged, and the next round starts from the
average (iterative parameter mixing). A sixth of the sample calibrates the scores afterwards; its
texts are summed up in tasks, and only sums and labels reach the driver. Of rows that repeat an
identifier the one of the smallest hash is learned from.

Defined results: null and empty texts have no feature and the score of the intercept; repeated rows
get the same score; labels of documents that are not there do not count; without labelled documents
of both classes all scores are the share of toxic ones (0 if there are none); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordvol.llm._common import held_out, slices, stored

#: Hash places (a power of two), most labelled rows (toxic, others), rounds, and rows for each parallel learner.
BITS, SAMPLE, ROUNDS, SHARD = 18, (6000, 18000), 4, 4000
#: Rate, its smoothing, L1 and L2 penalty.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
_WORD = re.compile(r"[^\W\d_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(29))) * _A >> np.uint64(64 - BITS)


def word_hash(token: str) -> int:
    """Hash of the letters of a token, lower-cased; 0 if it has none."""
    import xxhash

    letters = "".join(_WORD.findall(token.lower()))
    return xxhash.xxh64_intdigest(letters) | 1 if letters else 0


class Features:
    """Hash places of the features of texts, with a bounded table of words hashed before."""

    def __init__(self, most: int = 250_000):
        self.known: dict[str, int] = {}
        self.most = most

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of all features of all texts in a row, and where each text's features end."""
        tokens = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        flat = pc.dictionary_encode(tokens.flatten())
        words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        if len(self.known) > self.most:
            self.known.clear()
        self.known.update((w, word_hash(w)) for w in words if w not in self.known)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))[codes]
        offsets = tokens.offsets.to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
        some = hashes != 0
        h, doc = hashes[some], doc[some]
        parts, docs = [_mixed(h)], [doc]
        for gap, salt in ((1, _B), (2, _C)):  # pairs, and pairs with one word between
            same = doc[gap:] == doc[:-gap]
            parts.append(_mixed(h[:-gap][same] * salt + h[gap:][same]))
            docs.append(doc[gap:][same])
        places, owners = np.concatenate(parts).astype(np.int64), np.concatenate(docs)
        order = np.argsort(owners, kind="stable")
        return places[order], np.cumsum(np.bincount(owners, minlength=len(texts)))


def rows_of(places: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct places and values of each text."""
    out, start = [], 0
    for end in ends.tolist():
        at, n = np.unique(places[start:end], return_counts=True)
        out.append((at, 1 + np.log(n)))
        start = end
    return out


class Ftrl:
    """FTRL-proximal with per-coordinate rates; weights come from z and n."""

    def __init__(self, weights: np.ndarray | None = None, squares: np.ndarray | None = None):
        size = (1 << BITS) + 1  # the last place is the intercept
        self.n = np.zeros(size) if squares is None else squares.astype(float)
        rate = (BETA + np.sqrt(self.n)) / ALPHA
        self.z = np.zeros(size) if weights is None else -(weights * (rate + L2)) - np.sign(weights) * L1
        self.z[-1] = 0.0 if weights is None else -weights[-1] * (rate[-1] + L2)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def intercept(self) -> float:
        return -self.z[-1] / ((BETA + np.sqrt(self.n[-1])) / ALPHA + L2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w, bias = self.weights(at), self.intercept()
        p = 1 / (1 + np.exp(-np.clip(w @ value + bias, -30, 30)))
        for k, g, old in ((at, (p - label) * value, w), (-1, p - label, bias)):
            more = (np.sqrt(self.n[k] + g * g) - np.sqrt(self.n[k])) / ALPHA
            self.z[k] += g - more * old
            self.n[k] += g * g


@dataclass(frozen=True)
class Model:
    """Places with weights, their weights, intercept, and the calibration's slope and shift."""

    places: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out

    def raw(self, dense: np.ndarray, places: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Weighted sums of texts; only features with a weight are looked at twice."""
        out = np.full(len(ends), self.bias)
        (hit,) = np.nonzero(dense[places])
        if len(hit):
            owner = np.searchsorted(ends, hit, side="right")
            pairs, n = np.unique(owner * (1 << BITS) + places[hit], return_counts=True)
            np.add.at(out, pairs >> BITS, dense[pairs & ((1 << BITS) - 1)] * (1 + np.log(n)))
        return out

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Model:
    """Learn from labelled rows that are not held out."""
    marks = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"))
    marks = stored(marks.join(there, "doc_id").select("doc_id", "label"), "toxicity-labels")
    counts = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not counts.get(0) or not counts.get(1):
        share = counts.get(1, 0) / max(1, sum(counts.values()))
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-12) / (1 - share + 1e-12))))
    most = {1: sample[0], 0: sample[1]}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))
    # About 1.5 times the sample passes by its draw alone, then the bound holds exactly.
    chosen = [marks.where((F.col("label") == k) & (draw < _below(v, counts[k]))).orderBy(draw, "doc_id").limit(v) for k, v in most.items()]
    drawn = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    drawn = texts.join(F.broadcast(drawn), "doc_id")  # at most sum(sample) identifiers
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    drawn = drawn.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    shards = max(1, sum(min(counts[k], v) for k, v in most.items()) // SHARD)
    part = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(n)).cast("int")
    drawn = stored(drawn.withColumns({"shard": part(5, shards), "place": part(17, 6)}), "toxicity-sample")
    spark = docs.sparkSession
    mixed = None
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(mixed)
        parts = drawn.where("place <> 0").groupBy("shard").applyInPandas(_learner(shared, round_), "place long, weight double, square double")
        sums = parts.groupBy("place").agg(F.sum("weight").alias("w"), F.sum("square").alias("s"), F.count("*").alias("k")).toPandas()  # at most 2^BITS + 1 rows
        w, s = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        learners = sums["k"].max()  # each has an intercept
        w[sums["place"]], s[sums["place"]] = sums["w"] / learners, sums["s"] / learners
        mixed = (w.astype(np.float32), s.astype(np.float32))
    (places,) = np.nonzero(mixed[0][:-1])
    model = Model(places, mixed[0][places], float(mixed[0][-1]))
    seen = drawn.where("place = 0").select("label", "text").mapInArrow(_raw(spark.sparkContext.broadcast(model)), "label int, raw double").toPandas()
    return _calibrated(model, seen, counts)


def _below(sample: int, count: int) -> int:
    return min(1 << 40, int((1 << 40) * 1.5 * (sample + 100) / count))


def _learner(shared, round_: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        pdf = pdf.iloc[np.random.default_rng(round_).permutation(len(pdf))]
        start = shared.value
        model = Ftrl() if start is None else Ftrl(*start)
        features = Features()
        for i in range(0, len(pdf), 200):
            part = pdf.iloc[i : i + 200]
            for (at, value), label in zip(rows_of(*features.places(pa.array(part["text"], pa.string()))), part["label"]):
                if len(at):
                    model.learn(at, value, int(label))
        w = model.weights()
        w[-1] = model.intercept()
        (at,) = np.nonzero((w != 0) | (model.n > 0) | (np.arange(len(w)) == len(w) - 1))
        return pd.DataFrame({"place": at, "weight": w[at], "square": model.n[at]})

    return run


def _raw(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features()
        dense = model.dense()
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.raw(dense, *features.places(part.column(1))))], names=["label", "raw"])

    return run


def _calibrated(model: Model, seen: pd.DataFrame, counts: dict[int, int]) -> Model:
    """Slope and shift (Platt) on texts (label, raw) the weights have not seen, at the classes' true shares."""
    if seen["label"].nunique() < 2:
        return model
    seen = seen.sort_values(["label", "raw"], kind="stable")
    x, y = seen["raw"].to_numpy(float), seen["label"].to_numpy(float)
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    weight /= weight.mean()
    positive, negative = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method on two parameters
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([(g * x).sum() + 1e-3 * (slope - 1), g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step /= max(1.0, np.abs(step).max())
        slope, shift = slope - step[0], shift - step[1]
    return Model(model.places, model.weights, model.bias, max(slope, 1e-3), shift)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, in one narrow stage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = shared.value, Features()
        dense = model.dense()
        for batch in batches:
            for part in slices(batch, 2):
                s = model.score(model.raw(dense, *features.places(part.column(2))))
                columns = [part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
