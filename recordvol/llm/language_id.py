"""Language identification with interpolated Kneser-Ney character models.

Each language has a model over the characters of its words: n-grams up to ORDER that never reach
over a word's edge, in one sorted array of 64-bit hashes per order, with the discounted
probability of an n-gram and the back-off weight it has as a context. A text gets the language of
the lowest cross-entropy per character. As the score of a word does not depend on its neighbours,
distinct words are scored once and texts are sums over them.

The confidence is the softmax of the cross-entropies at a temperature fitted on labelled texts that
the models have not seen. The same texts give, per language, the limit beyond which a text is
rejected as in none of the learned languages: a high quantile of its own texts' cross-entropies,
held to a few robust deviations from their median so that single noisy texts do not move it, then
a part of the way (GAP) to the low quantile of the other languages' texts, and for short texts a
margin that falls with the square root of the length.

Fitting takes a bounded sample: of each language at most SAMPLE documents with TRAIN_CHARS
characters in all, drawn by hash of identifier and text; of a document longer than 1/LONGEST of these
characters, words drawn by hash from all over its text that make up about as many, so no single one
displaces the others. These bounds are the only ones: every n-gram of the sample is in the model, at
most ORDER * TRAIN_CHARS entries of 16 bytes a language. Models of more than MOST_BYTES in all are an
error, as they are broadcast.

Defined results: a null text, an empty one and one without a letter have language `und`, score 0
and are rejected; ties go to the language first in order; repeated rows get the same result; with
no labelled text every text is `und`; an empty table gives no rows; other columns are ignored by
`identify` and kept by `keep_identified`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.llm._common import held_out, slices, stored

ORDER = 5
#: Bounds of the sample of each language, and of all models together.
SAMPLE, TRAIN_CHARS, MOST_BYTES = 1200, 600_000, 512 << 20
#: A document gives at most this part of TRAIN_CHARS to the sample.
LONGEST = 40
#: Probability of a character no model has seen.
UNSEEN = 1e-4
#: Distinct words a Python worker keeps scores of, and words scored at once.
MOST_WORDS, CHUNK = 250_000, 10_000
#: Quantiles of own and other texts, deviations (in nats at least) own texts may be off, part of the gap to the others' texts.
OWN, OTHER, DEVIATIONS, LEAST_OFF, GAP = 0.99, 0.01, 6, 0.3, 1 / 3
#: Nats instead of the gap where no other language is learned; deviations of one character's cost in the margin.
ALONE, MARGIN = 0.3, 4
EDGE = "\x02"
_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER = re.compile(r"[\W\d_]+")


def cleaned(token: str) -> str:
    """Lower-cased letters of a token; what stands between them is a word's edge."""
    out = _OTHER.sub(EDGE, token.lower()).strip(EDGE)
    if not out.isalpha() and out:
        out = re.sub(f"{EDGE}+", EDGE, "".join(c if c.isalpha() else EDGE for c in out)).strip(EDGE)
    return out


def grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Characters of edge-joined words, hashes of the n-gram that ends at each of them by order,
    the longest n-gram inside the word there, and where the next word starts."""
    chars = np.frombuffer((EDGE + EDGE.join(words) + EDGE).encode("utf-32-le"), "<u4")
    edge = chars == ord(EDGE)
    at = np.arange(len(chars))
    start = np.maximum.accumulate(np.where(edge, at, 0))
    longest = np.empty_like(at)
    longest[1:] = at[1:] - start[:-1] + 1
    longest[0] = 0
    longest[1:][edge[1:] & edge[:-1]] = 0  # between two edges there is nothing
    one = (chars.astype(np.uint64) + np.uint64(1)) * _SEED
    hashes = [one]
    for _ in range(ORDER - 1):
        h = one.copy()
        h[1:] += hashes[-1][:-1] * _STEP
        hashes.append(h)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return chars, hashes, longest, np.concatenate([[1], 1 + np.cumsum(lengths)])


@dataclass(frozen=True)
class Model:
    """Sorted hashes, discounted probabilities and back-off weights by order; weight of the empty context."""

    language: str
    hashes: list[np.ndarray]
    chances: list[np.ndarray]
    weights: list[np.ndarray]
    empty: float


def train(language: str, counts: dict[str, int]) -> Model:
    """Interpolated Kneser-Ney from cleaned words and how often they occur."""
    words = [w for w in counts if w]
    chars, hashes, longest, ends = grams(words)
    times = np.zeros(len(chars), np.int64)
    times[1:] = np.repeat([counts[w] for w in words], np.diff(ends))
    edge_start = lambda n, at: chars[at - n + 1] == ord(EDGE)

    tables = []  # by order: hashes of distinct n-grams, their counts, hashes of their contexts
    longer = None  # distinct (n+1)-grams' suffixes
    for n in range(ORDER, 0, -1):
        at = np.flatnonzero(longest >= n)
        gram, first, inverse = np.unique(hashes[n - 1][at], return_index=True, return_inverse=True)
        raw = np.bincount(inverse, times[at], len(gram)).astype(np.int64)
        where = at[first]
        if longer is not None:  # how many characters come before; at a word's start none can, so there it stays the count
            before = np.zeros(len(gram), np.int64)
            place = np.searchsorted(gram, longer)
            np.add.at(before, place, 1)
            raw = np.where((n > 1) & edge_start(n, where) | (before == 0), raw, before)
        longer = hashes[n - 2][where] if n > 1 else None
        context = hashes[n - 2][where - 1] if n > 1 else np.zeros(len(gram), np.uint64)
        tables.append((gram, raw, context))
    tables.reverse()

    out_h, out_c, out_w, empty = [], [], [], 1.0
    for n, (gram, count, context) in enumerate(tables, 1):
        once, twice = int((count == 1).sum()), int((count == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, count)
        kinds = np.bincount(inverse)
        out_h.append(gram)
        out_c.append(((count - discount) / total[inverse]).astype(np.float32))
        out_w.append(np.ones(len(gram), np.float32))
        weight = discount * kinds / total
        if n == 1:
            empty = float(weight[0]) if len(weight) else 1.0
        else:
            place = np.minimum(np.searchsorted(out_h[n - 2], contexts), len(out_h[n - 2]) - 1)
            known = out_h[n - 2][place] == contexts
            out_w[n - 2][place[known]] = weight[known]
    return Model(language, out_h, out_c, out_w, empty)


def word_scores(words: list[str], models: list[Model]) -> np.ndarray:
    """Per word: characters (edges at ends included), then its log probability in each model."""
    out = np.zeros((len(words), 1 + len(models)))
    for i in range(0, len(words), CHUNK):
        _, hashes, longest, ends = grams(words[i : i + CHUNK])
        part = out[i : i + CHUNK]
        part[:, 0] = np.add.reduceat((longest > 0).astype(np.float64), ends[:-1])
        chance = [np.full(len(longest), UNSEEN) for _ in models]
        weight = [np.full(len(longest), m.empty) for m in models]
        reach = np.maximum(longest, 1)  # an edge before a word is no event of its own, but a context
        for n in range(1, ORDER + 1):
            at = np.flatnonzero(reach >= n)
            gram, inverse = np.unique(hashes[n - 1][at], return_inverse=True)
            for k, m in enumerate(models):
                if not len(m.hashes[n - 1]):
                    continue
                place = np.minimum(np.searchsorted(m.hashes[n - 1], gram), len(m.hashes[n - 1]) - 1)
                known = m.hashes[n - 1][place] == gram
                p = np.where(known, m.chances[n - 1][place], 0.0)[inverse]
                before = weight[k][at] if n == 1 else weight[k][at - 1]
                # Without its context a model has no weight for it: the shorter estimate stays.
                chance[k][at] = p + before * chance[k][at]
                weight[k] = np.ones(len(longest))
                weight[k][at] = np.where(known, m.weights[n - 1][place], 1.0)[inverse]
        for k in range(len(models)):
            part[:, 1 + k] = np.add.reduceat(np.where(longest > 0, np.log(np.minimum(chance[k], 1.0)), 0.0), ends[:-1])
    return out


class Scorer:
    """Cross-entropies of texts, with a bounded table of words scored before."""

    def __init__(self, models: list[Model]):
        self.models, self.known = models, {}
        self.table = np.zeros((0, 1 + len(models)))

    def sums(self, texts: pa.Array) -> np.ndarray:
        """Per text: characters and log probability in each model."""
        tokens = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        flat = pc.dictionary_encode(tokens.flatten())
        words, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        offsets = tokens.offsets.to_numpy(zero_copy_only=False)
        rows = self._rows(words)[codes]
        added = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
        at = offsets - offsets[0]
        return added[at[1:]] - added[at[:-1]]

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > MOST_WORDS:
            self.known, self.table = {}, self.table[:0]
        fresh = [w for w in words if w not in self.known]
        if fresh:
            self.known.update(zip(fresh, range(len(self.table), len(self.table) + len(fresh))))
            self.table = np.concatenate([self.table, word_scores([cleaned(w) for w in fresh], self.models)])
        return self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]


@dataclass(frozen=True)
class Identifier:
    """Models with their calibration: temperature, and per language the largest cross-entropy accepted, which
    for a text of n characters is limits + margins / sqrt(n)."""

    models: list[Model]
    temperature: float
    limits: np.ndarray
    margins: np.ndarray

    def judge(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language's place (-1: none), confidence, cross-entropy, whether accepted."""
        n = sums[:, 0]
        some = n > 0
        if not self.models:
            return np.full(len(n), -1), np.zeros(len(n)), np.full(len(n), np.nan), np.zeros(len(n), bool)
        cross = -sums[:, 1:] / np.maximum(n, 1)[:, None]
        best = np.argmin(cross, axis=1)
        least = cross[np.arange(len(n)), best]
        odds = np.exp(-(cross - least[:, None]) * self.temperature * np.sqrt(np.maximum(n, 1))[:, None])
        return np.where(some, best, -1), np.where(some, 1 / odds.sum(axis=1), 0.0), np.where(some, least, np.nan), some & (least <= self.limits[best] + self.margins[best] / np.sqrt(np.maximum(n, 1)))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, chars: int = TRAIN_CHARS) -> Identifier:
    """Learn from rows with a language that are not held out; a third of the sample calibrates."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out())
    count = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.count("*")).collect()}  # a row per language
    if not count:
        return Identifier([], 1.0, np.zeros(0), np.zeros(0))
    drawn = _sampled(rows, count, text, lang, sample, chars)
    fitted = stored(drawn.groupBy("lang").applyInPandas(_train_one, "lang string, arrays array<binary>, empty double"), "models")
    size = fitted.agg(F.sum(F.aggregate("arrays", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"models of {len(count)} languages have {size} bytes; {MOST_BYTES} is the most that is broadcast")
    fitted = fitted.collect()
    models = [_unpacked(r) for r in sorted(fitted, key=lambda r: r["lang"])]
    seen = drawn.where("place % 3 = 0").select("lang", "text").mapInArrow(_sums_of(models), _sums_schema(models, "lang string")).toPandas()  # sums only
    return _calibrated(models, seen)


def _sampled(rows: DataFrame, count: dict[str, int], text: str, lang: str, sample: int, chars: int) -> DataFrame:
    """lang, text, draw, place, chars of the documents that are learned from or calibrate."""
    # A first draw by hash keeps about twice the sample, whatever the corpus has; then the bounds hold exactly.
    draw = F.pmod(F.xxhash64("doc_id", text, F.lit(7)), F.lit(1 << 40))
    below = F.create_map(*[x for k, v in count.items() for x in (F.lit(k), F.lit(min(1 << 40, int((1 << 40) * 2 * sample / v))))])
    drawn = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), draw.alias("draw"), F.length(text).alias("size")).where(F.col("draw") < below[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    drawn = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample)
    drawn = drawn.withColumn("text", _thinned(F.col("text"), F.col("size"), F.col("draw"), max(1, chars // LONGEST))).drop("size")
    size = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return drawn.withColumn("chars", size).where((F.col("chars") <= chars) | (F.col("place") <= 3))


def _thinned(text: Column, size: Column, draw: Column, most: int) -> Column:
    """A text of at most `most` characters as it is; of a longer one, about as many in words drawn from all over it.

    `size` is its length, a column from below a window: counted inside the lambda it would be counted for each word.
    """
    share = F.lit(most * 1e6) / size
    words = F.filter(F.split(text, r"\s+"), lambda w, i: F.pmod(F.xxhash64(draw, i), F.lit(1_000_000)) < share)
    return F.when(size <= most, text).otherwise(F.array_join(words, " "))


def _train_one(pdf: pd.DataFrame) -> pd.DataFrame:
    learn = pdf[pdf["place"] % 3 != 0] if len(pdf) > 2 else pdf
    tokens = pd.Series([t for x in learn["text"] for t in x.split()], dtype=object).value_counts()
    counts: dict[str, int] = {}
    for token, n in tokens.items():
        for w in cleaned(token).split(EDGE):
            counts[w] = counts.get(w, 0) + int(n)
    m = train(pdf["lang"].iloc[0], counts)
    arrays = [x.tobytes() for group in (m.hashes, m.chances, m.weights) for x in group]
    return pd.DataFrame({"lang": [m.language], "arrays": [arrays], "empty": [m.empty]})


def _unpacked(row) -> Model:
    a = [bytes(x) for x in row["arrays"]]
    kinds = (np.uint64, np.float32, np.float32)
    return Model(row["lang"], *([np.frombuffer(x, kinds[k]) for x in a[k * ORDER : (k + 1) * ORDER]] for k in range(3)), row["empty"])


def _sums_schema(models: list[Model], first: str) -> str:
    return ", ".join([first, "n double", *(f"l{i} double" for i in range(len(models)))])


def _sums_of(models: list[Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models)
        for batch in batches:
            for part in slices(batch, 1):
                sums = scorer.sums(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in sums.T)], names=["lang", "n", *(f"l{i}" for i in range(len(models)))])

    return run


def _calibrated(models: list[Model], seen: pd.DataFrame) -> Identifier:
    """Temperature of the most likely labels; limits from each language's own cross-entropies."""
    seen = seen[seen["n"] > 0]
    n, cross = seen["n"].to_numpy(), -seen.filter(like="l").drop(columns="lang").to_numpy() / np.maximum(seen["n"].to_numpy(), 1)[:, None]
    place = {m.language: i for i, m in enumerate(models)}
    label = seen["lang"].map(place).to_numpy(int) if len(seen) else np.zeros(0, int)
    bounds = [_limit(cross[label == k, k], n[label == k], cross[label != k, k]) for k in range(len(models))]
    limits, margins = np.array([x[0] for x in bounds]), np.array([x[1] for x in bounds])
    best, temperature = -np.inf, 1.0
    for t in np.geomspace(0.05, 20, 40) if len(seen) else []:
        z = -cross * t * np.sqrt(n)[:, None]
        z -= z.max(axis=1, keepdims=True)
        fit_ = (z[np.arange(len(z)), label] - np.log(np.exp(z).sum(axis=1))).mean()
        if fit_ > best:
            best, temperature = fit_, float(t)
    return Identifier(models, temperature, limits, margins)


def _limit(own: np.ndarray, n: np.ndarray, others: np.ndarray) -> tuple[float, float]:
    """Limit of long texts and margin of one character, from cross-entropies of own texts of n characters and of others."""
    if not len(own):  # too few texts to calibrate: only what no model has seen goes
        return -np.log(UNSEEN) / 2, 0.0
    middle = float(np.median(own))
    off = 1.4826 * float(np.median(np.abs(own - middle)))
    high = min(float(np.quantile(own, OWN)), middle + max(DEVIATIONS * off, LEAST_OFF))
    gap = max(0.0, float(np.quantile(others, OTHER)) - high) * GAP if len(others) else ALONE
    return high + gap, MARGIN * 1.4826 * float(np.median(np.abs(own - middle) * np.sqrt(n)))


def identify(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, accepted: one row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = shared.value
        scorer, names = Scorer(me.models), np.array([*(m.language for m in me.models), "und"], dtype=object)
        for batch in batches:
            for part in slices(batch, 2):
                best, score, cross, accepted = me.judge(scorer.sums(part.column(2)))
                columns = [part.column(0), part.column(1), pa.array(names[best], pa.string()), pa.array(score), pa.array(cross, from_pandas=True), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, accepted boolean")


def keep_identified(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """The rows of docs whose text is accepted as one of the learned languages, in one narrow stage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        me = shared.value
        scorer = Scorer(me.models)
        for column in texts:
            batch = pa.RecordBatch.from_arrays([column], names=["t"])
            found = [me.judge(scorer.sums(part.column(0)))[3] for part in slices(batch, 0)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0, bool))

    return docs.where(accepted(F.col(text)))
