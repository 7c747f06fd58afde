"""Document quality by co-training of a text-content view and a page-metadata view.

The text view sees what a document says and how it is written: its words and word pairs, and the
shapes of its tokens (capitals, letters, digits, signs) and shape pairs, hashed into a fixed number
of places, damped by the logarithm and scaled to length one. The metadata view sees only what is
known about the document: source, language, and the URL of its page (the page whose page_id is the
doc_id, where there is one); no text and no size. Each view has a logistic classifier.

In every round both views score all documents without a label, each hands those it is surest of to
the other as pseudo-labels, and both are fitted again on labels plus what they were handed. A view
is sure of a document only where its log-odds have the sign of the class and are off the base rate
by SURE in that direction, so a view that tells nothing hands over nothing. In the end each view is
calibrated on labelled documents it did not learn from, and the calibrated log-odds are added with
weights by how much each view tells (log-likelihood gained over the base rate; 0 where it tells nothing).

Features are computed once per document and stored; a round is one pass over them in which each
task keeps its surest few. Fitting takes at most SAMPLE labelled rows, drawn by hash, and HANDED
pseudo-labels a round and view.

Defined results: null and empty texts have an all-zero text view and a score like any other; a null
source, language or URL is a category of its own; repeated rows get the same score; rows with a
null doc_id are scored but never pseudo-labelled; without labelled rows of both classes among the
documents all scores are the share of good ones of these (0.5 if there are none); an empty table
gives no rows; columns of the input other than doc_id, text, source and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.llm._common import HEAVY, held_out, slices, stored

#: Most labelled rows fitted on, rounds, pseudo-labels a round and view, and how far off the base rate (log-odds) a view is sure.
SAMPLE, ROUNDS, HANDED, SURE = 8000, 4, 200, 1.0
#: Hash places of words and of shapes, and of each category of the metadata view.
WORDS, SHAPES, PLACES = 512, 256, 16
#: Rows from which an identifier is frequent, and parts its rows and those without one are spread over.
OFTEN, SALTS = 1000, 1024
FEATURES = "doc_id long, held_out boolean, a binary, b array<float>"
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _hashes(values: pa.Array) -> np.ndarray:
    """An odd 64-bit hash per string; 0 for the empty one."""
    import xxhash

    coded = pc.dictionary_encode(values)
    distinct = np.fromiter((xxhash.xxh64_intdigest(x) | 1 if x else 0 for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return distinct[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.uint64)


def shapes(tokens: pa.Array) -> pa.Array:
    """Tokens with A for capitals, a for other letters, 0 for numbers and ## for runs of signs."""
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a"), (r"\p{N}+", "0"), (r"[^\p{L}\p{N}]{2,}", "##")):
        tokens = pc.replace_substring_regex(tokens, pattern, sign)
    return tokens


def _place(x: np.ndarray, places: int) -> np.ndarray:
    return ((x ^ (x >> np.uint64(29))) * _A >> np.uint64(33)).astype(np.int64) % places


def text_view(texts: pa.Array) -> np.ndarray:
    """Rows of WORDS + SHAPES values; both parts have length one, or zero for a text without a word."""
    tokens = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    coded = pc.dictionary_encode(tokens.flatten())
    at = coded.indices.to_numpy(zero_copy_only=False)
    letters = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), r"[^\p{L}]+", "")
    doc = np.repeat(np.arange(len(texts)), np.diff(tokens.offsets.to_numpy(zero_copy_only=False)))
    some = np.asarray(pc.greater(pc.binary_length(pc.cast(coded.dictionary, pa.binary())), 0).to_numpy(zero_copy_only=False), bool)[at]
    at, doc = at[some], doc[some]  # splitting an empty text gives an empty token
    same = doc[1:] == doc[:-1]
    out = np.zeros((len(texts), WORDS + SHAPES), np.float32)
    for first, places, values in ((0, WORDS, letters), (WORDS, SHAPES, shapes(coded.dictionary))):
        h = _hashes(values)[at]
        has, pair = h != 0, (h[1:] * h[:-1] != 0) & same
        owner = np.concatenate([doc[has], doc[1:][pair]])
        place = _place(np.concatenate([h[has] * _B, (h[:-1] * _C + h[1:])[pair]]), places)
        counts = np.log1p(np.bincount(owner * places + place, minlength=len(texts) * places).reshape(len(texts), places))
        out[:, first : first + places] = counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-9)
    return out


def metadata_view(source: Column, lang: Column, url: Column) -> list[Column]:
    """Features of the metadata view: hashed source, language, URL host suffix and form."""
    place = lambda c, salt: F.pmod(F.xxhash64(F.coalesce(c, F.lit("")), F.lit(salt)), F.lit(PLACES))
    suffix = F.substring_index(F.substring_index(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:]*://([^/?#]*)", 1), ".", -2), ":", 1)
    hot = [(place(c, s) == F.lit(k)).cast("float") for c, s in ((source, 1), (lang, 2), (suffix, 3)) for k in range(PLACES)]
    bits = [F.coalesce(F.contains(url, F.lit(x)), F.lit(False)).cast("float") for x in ("?", "#", "utm_")]
    return [*hot, *bits, url.isNull().cast("float")]


def features(docs: DataFrame, pages: DataFrame | None = None, text: str = "text") -> DataFrame:
    """doc_id, held_out, a (the text view, 16-bit floats) and b (the metadata view), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 5):
                a = text_view(part.column(5)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([x.tobytes() for x in a], pa.binary())], names=["doc_id", "salt", "held_out", "source", "lang", "a"])

    # Rows without an id join with nothing, and an id may be that of very many rows: the salt spreads both.
    me = F.col("doc_id").cast("long")
    often = docs.where(me.isNotNull()).groupBy(me.alias("doc_id")).agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "doc_id").limit(HEAVY).collect()
    hot = [r["doc_id"] for r in often]  # fewer than HEAVY can hold much
    spread_ = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    salt = F.when(me.isNull(), spread_ + 1).when(me.isin(hot) if hot else F.lit(False), spread_).otherwise(F.lit(0)).cast("long")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), salt.alias("salt"), held_out().alias("held_out"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text).alias("text"),
    )
    rows = rows.mapInArrow(run, "doc_id long, salt long, held_out boolean, source string, lang string, a binary")
    if pages is None:
        rows = rows.withColumn("url", F.lit(None).cast("string"))
    else:
        urls = pages.where(F.col("page_id").isNotNull()).groupBy(F.col("page_id").cast("long").alias("doc_id")).agg(F.min("url").alias("url"))
        salts = F.when(F.col("doc_id").isin(hot) if hot else F.lit(False), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        rows = rows.join(urls.withColumn("salt", F.explode(salts)), ["doc_id", "salt"], "left")
    return rows.select("doc_id", "held_out", "a", F.array(*metadata_view(F.col("source"), F.col("lang"), F.col("url"))).alias("b"))


@dataclass(frozen=True)
class Model:
    """Coefficients of both views (the last is the intercept), calibrations (slope, shift), weights, and log-odds of the base rate."""

    a: np.ndarray
    b: np.ndarray
    calibration: tuple[tuple[float, float], tuple[float, float]]
    weights: tuple[float, float]
    prior: float


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept, last, is free."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-4 * max(1.0, np.abs(w).max()):
            break
    return w


def _odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def surest(odds: np.ndarray, ids: np.ndarray, prior: float, good: int, bad: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the `good` rows a view is surest are good, and of the `bad` ones; ties to the smaller id."""
    up = np.flatnonzero((odds > 0) & (odds - prior > SURE))
    down = np.flatnonzero((odds < 0) & (odds - prior < -SURE))
    return up[np.lexsort((ids[up], -odds[up]))[:good]], down[np.lexsort((ids[down], odds[down]))[:bad]]


def _pseudo_labels(rows: DataFrame, wa: np.ndarray, wb: np.ndarray, known: np.ndarray, prior: float, good: int, bad: int) -> pd.DataFrame:
    """view, label, odds, doc_id, a, b of what each view hands over, from all rows that are not known."""
    shape = "view int, label int, sure double, doc_id long, a binary, b array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            free = np.flatnonzero(~np.isin(ids, known))
            batch = batch.take(pa.array(free))
            if not batch.num_rows:
                continue
            a, b = _matrices(batch.column(1), batch.column(2))
            picked = [best] if best is not None else []
            for view, odds in ((0, _odds(wa, a)), (1, _odds(wb, b))):
                for label, at in zip((1, 0), surest(odds, ids[free], prior, good, bad)):
                    part = batch.take(pa.array(at))
                    n = len(at)
                    picked.append(pa.table([pa.array(np.full(n, view), pa.int32()), pa.array(np.full(n, label), pa.int32()), pa.array(np.abs(odds[at])), part.column(0), part.column(1), part.column(2)], names=["view", "label", "sure", "doc_id", "a", "b"]))
            best = _first(pa.concat_tables(picked, promote_options="permissive"), good, bad)
        if best is not None and best.num_rows:
            yield from best.combine_chunks().to_batches()

    key = ["view", "label", "doc_id"]
    found = stored(rows.where("doc_id is not null").select("doc_id", "a", "b").mapInArrow(run, shape), "surest")  # 2 * HANDED a task at most
    best = Window.partitionBy("view", "label").orderBy(F.desc("sure"), "doc_id")
    first = found.groupBy(*key).agg(F.max("sure").alias("sure")).withColumn("place", F.row_number().over(best))
    first = first.where(F.col("place") <= F.when(F.col("label") == 1, good).otherwise(bad)).drop("sure")
    return found.join(F.broadcast(first), key).dropDuplicates(key).orderBy("view", "label", "place").toPandas()  # 2 * HANDED in all


def _first(picked: pa.Table, good: int, bad: int) -> pa.Table:
    """Of each view and label the surest rows; ties to the smaller id."""
    view, label, sure, ids = (picked.column(c).to_numpy() for c in ("view", "label", "sure", "doc_id"))
    order = np.lexsort((ids, -sure, label, view))
    stays = [at[: good if lab else bad] for v in (0, 1) for lab in (1, 0) for at in [order[(view[order] == v) & (label[order] == lab)]]]
    return picked.take(pa.array(np.concatenate(stays)))


def _matrices(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(a.to_pylist()), np.float16).reshape(len(a), -1).astype(np.float32)
    return x, b.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, hand, rounds: int = ROUNDS, handed: int = HANDED) -> Model:
    """Fit on labelled rows; two thirds learn, a third calibrates.

    `hand(wa, wb, prior, good, bad)` gives of each view what it hands over as (view, features for
    the other view, labels).
    """
    learn = np.arange(len(y)) % 3 != 0
    if y[learn].min() == y[learn].max() or y[~learn].min() == y[~learn].max():
        learn = np.ones(len(y), bool)
    check = ~learn if not learn.all() else learn
    share = y[learn].mean()
    prior = float(np.log(share / (1 - share)))
    sets = ([a[learn]], [y[learn]]), ([b[learn]], [y[learn]])
    good = max(1, round(handed * share))
    w: list[np.ndarray | None] = [None, None]
    for r in range(rounds + 1):
        w = [_logistic(np.concatenate(xs), np.concatenate(ys), start=old) for (xs, ys), old in zip(sets, w)]
        if r == rounds:
            break
        new = [x for x in hand(w[0], w[1], prior, good, max(1, handed - good)) if len(x[2])]
        for view, x, labels in new:
            sets[1 - view][0].append(x)
            sets[1 - view][1].append(labels)
        if not new:
            break
    calibration, told = [], []
    for k, x in ((0, a), (1, b)):
        odds = _odds(w[k], x[check])
        c = _logistic(odds[:, None], y[check], ridge=1e-3)
        p = 1 / (1 + np.exp(-np.clip(c[0] * odds + c[1], -30, 30)))
        base = y[check].mean()
        gain = np.mean(np.log(np.where(y[check] == 1, p, 1 - p) + 1e-9)) - np.mean(np.log(np.where(y[check] == 1, base, 1 - base) + 1e-9))
        calibration.append((float(c[0]), float(c[1])))
        told.append(max(gain, 0.0))
    total = sum(told) or 1.0
    return Model(w[0], w[1], tuple(calibration), (told[0] / total, told[1] / total), prior)


def fit(rows: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model | float:
    """A model from stored features (see `features`) and labels of rows that are not held out."""
    marks = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    ids = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).join(marks, "doc_id"), "labelled")
    total = ids.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 40))
    below = min(1 << 40, int((1 << 40) * 1.2 * (sample + 50) / max(total, 1)))
    chosen = ids.where(draw < below).orderBy(draw, "doc_id").limit(sample).select("doc_id", "label")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("a", "b"))
    known = rows.join(F.broadcast(chosen), "doc_id").withColumn("nth", F.row_number().over(one)).where("nth = 1").select("doc_id", "label", "a", "b").toPandas()  # at most `sample` rows
    known = known.sort_values("doc_id", kind="stable")
    y = known["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    a, b = _matrices(pa.array(known["a"]), pa.array(known["b"].map(list).tolist(), pa.list_(pa.float32())))
    labelled = known["doc_id"].to_numpy()
    seen = [labelled]

    def hand(wa: np.ndarray, wb: np.ndarray, prior: float, good: int, bad: int):
        found = _pseudo_labels(rows, wa, wb, np.concatenate(seen), prior, good, bad)
        seen.append(found["doc_id"].to_numpy())
        for view in (0, 1):
            own = found[found["view"] == view]
            if len(own):
                xa, xb = _matrices(pa.array(own["a"]), pa.array(own["b"].map(list).tolist(), pa.list_(pa.float32())))
                yield view, (xb, xa)[view], own["label"].to_numpy(float)

    return co_train(a.astype(float), b.astype(float), y, hand)


def score(rows: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, held_out, text_score, metadata_score, score, predicted, metadata_weight: one row per row of features."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "text_score", "metadata_score", "score", "predicted", "metadata_weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        chance = lambda odds: 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for batch in batches:
            n = batch.num_rows
            if isinstance(m, Model):
                odds = [c[0] * _odds(w, x) + c[1] for x, w, c in zip(_matrices(batch.column(2), batch.column(3)), (m.a, m.b), m.calibration)]
                both = m.prior + sum(k * (o - m.prior) for k, o in zip(m.weights, odds))
                values, weight = [chance(odds[0]), chance(odds[1]), chance(both)], m.weights[1]
            else:
                values, weight = [np.full(n, float(m))] * 3, 0.0
            columns = [batch.column(0), batch.column(1), *map(pa.array, values), pa.array((values[2] >= 0.5).astype(np.int32)), pa.array(np.full(n, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    shape = "doc_id long, held_out boolean, text_score double, metadata_score double, score double, predicted int, metadata_weight double"
    return rows.mapInArrow(run, shape)
