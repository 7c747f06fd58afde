"""Language-model scores from a log-frequency Bloom filter.

Every n-gram of all training texts is counted: tasks send sorted hashes and counts of a slice of text
in buckets by hash, and a bucket's counts are added up in one place. A count c becomes the level
1 + floor(log_BASE c), and the n-gram is put into its bucket's segment of the filter once for each level
up to its own, so a lookup probes level 1, 2, ... until one is missing. A segment has BITS bits an entry;
the PROBES bits of an entry lie in one 64-bit word, so a probe is one look at memory. Hashes are 64-bit
ones of the words; n-grams of all orders share the filter.

The probability of a token is smoothed from the shortest history to the longest: with the estimated
counts c of n-gram and history and the probability p of the next shorter history, (c(n-gram) + MU p) /
(c(history) + MU), starting from (c + 0.5) / (N + 0.5 (V + 1)). The history of a first word is the end
of a text before.

A filter of at most MOST_BYTES is broadcast. A larger one stays in its segments: a slice's different
n-grams are sent to the tasks that hold their segments, and the levels found are sent back, with the
same result. Scores of the base need exact counts: those of the TOP most frequent tokens at most are
broadcast, the others are joined.

Defined results: null and empty texts have the end as their only token; repeated rows are learned as
often as they are there and scored each; rows with a null doc_id are learned and are not held out; with
nothing to learn from, each token has the base's probability; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordvol.llm._common import followed, slices, spread, stored

#: Longest n-grams, base of levels, bits of the filter and bits set for an entry, weight of the shorter history.
ORDER, BASE, BITS, PROBES, MU = 2, 1.5, 12, 5, 40.0
#: Most bytes of a filter that is broadcast, most exact counts that are, bytes of text taken at once.
MOST_BYTES, TOP, SLICE = 128 << 20, 1 << 20, 4 << 20
#: What stands for a text's end; no word's hash is 1 (they are made even).
END = np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Random numbers for the hashes: by place (of 64) and byte, and odd ones for the places that follow.
_BYTES = np.random.default_rng(64).integers(0, 1 << 64, (64, 256), np.uint64)
_FAR = np.random.default_rng(65).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)

#: Least counts of the levels, and the mean count of each level (level 0: none).
LEAST = np.unique(np.ceil(BASE ** np.arange(100)).astype(np.int64))
VALUE = np.concatenate([[0.0], (LEAST[:-1] + LEAST[1:] - 1) / 2, LEAST[-1:]])


def _mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    z = (a * _A) ^ b
    z = (z ^ (z >> np.uint64(29))) * _B
    return z ^ (z >> np.uint64(32))


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _entry(x: np.ndarray, level: int, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The word, of `size` words, and the bits in it of each hash at a level."""
    h = _mixed(x, np.uint64(level))
    bits = np.zeros(len(x), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return ((h >> np.uint64(32)) * size >> np.uint64(32)).astype(np.int64), bits


def _hashes(words: pa.Array) -> np.ndarray:
    """Even 64-bit hashes of words that are not empty: sums of random numbers by byte and place; odd for empty ones."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    out = np.ones(len(words), np.uint64)
    some = sizes > 0
    if some.any():
        values = _BYTES[place & 63, data]
        (far,) = np.nonzero(place >= 64)
        values[far] *= _FAR[(place[far] >> 6) & 255] * (place[far].astype(np.uint64) >> np.uint64(14) | np.uint64(1))
        out[some] = _mixed(np.add.reduceat(values, starts[some]), np.uint64(0)) & ~np.uint64(1)
    return out


@dataclass(frozen=True)
class Tokens:
    """Tokens of texts in a row, each text closed by END: different hashes, each token's place there, and where texts end."""

    words: np.ndarray
    word: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(split.offsets.to_numpy(zero_copy_only=False)))
        flat = split.flatten().dictionary_encode()
        words, word = _hashes(flat.dictionary), flat.indices.to_numpy(zero_copy_only=False)
        if (words == 1).any():  # what is left of leading and trailing spaces is no word
            some = words[word] != 1
            word, doc = word[some], doc[some]
        out = np.full(len(word) + len(texts), len(words), np.int32)
        out[np.arange(len(word)) + doc] = word
        return cls(np.append(words, END), out, np.cumsum(np.bincount(doc, minlength=len(texts)) + 1))


def grams(x: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams that end at each token, and whether they lie in one text, for n from 1 to order."""
    out = [(x, np.ones(len(x), bool))]
    for n in range(2, order + 1):
        g, inside = out[-1]
        before = np.concatenate([[END if n == 2 else np.uint64(0)], g[:-1]])
        if n > 2:
            inside = np.concatenate([[False], inside[:-1] & (x[:-1] != END)])
        out.append((_mixed(before, x + np.uint64(2 * n)), inside))
    return out


def _summed(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(x)
    x, n = x[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    return x[first], np.add.reduceat(n, first) if len(x) else n


def segment(x: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """Bits of the filter for n-grams with these counts, and how many entries it has."""
    level = np.searchsorted(LEAST, n, side="right")
    entries = int(level.sum())
    words = np.zeros(-(-max(entries * BITS, 1) // 64), np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        word, bits = _entry(x[level >= j], j, np.uint64(len(words)))
        by = np.argsort(word)
        word, bits = word[by], bits[by]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] |= np.bitwise_or.reduceat(bits, first)
    return words.astype("<u8").tobytes(), entries


@dataclass(frozen=True)
class Filter:
    """Segments laid one after another: first word and number of words of each bucket (none: one empty word)."""

    words: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, segments: Iterable[tuple[int, bytes]], buckets: int, total: int) -> Filter:
        """Segments of `total` bytes, taken one after another."""
        words, first, size, at = np.zeros(total // 8 + 1, np.uint64), np.zeros(buckets, np.int64), np.ones(buckets, np.uint64), 1
        for bucket, own in segments:
            own = np.frombuffer(own, "<u8")
            first[bucket], size[bucket] = at, len(own)
            words[at : at + len(own)] = own
            at += len(own)
        return cls(words, first, size)

    def levels(self, x: np.ndarray) -> np.ndarray:
        """The level of each hash: the last one before the first that is missing."""
        out = np.zeros(len(x), np.uint8)
        bucket, alive = _bucket(x, len(self.first)), np.arange(len(x))
        for level in range(1, len(LEAST) + 1):
            own = bucket[alive]
            word, bits = _entry(x[alive], level, self.size[own])
            alive = alive[self.words[self.first[own] + word] & bits == bits]
            if not len(alive):
                break
            out[alive] = level
        return out


@dataclass(frozen=True)
class Model:
    """Sizes of what was learned, exact counts of frequent tokens, segments of the filter."""

    order: int
    buckets: int
    tokens: int
    words: int
    counts: DataFrame  # x, n of every token
    top: tuple[np.ndarray, np.ndarray]
    segments: DataFrame  # bucket, bits
    filter_bytes: int

    @property
    def divisor(self) -> float:
        return self.tokens + 0.5 * (self.words + 1)


def fit(training: DataFrame, order: int = ORDER, text: str = "text", top: int = TOP) -> Model:
    """Counts of all n-grams of all rows of training, as a filter, and exact counts of tokens."""
    buckets = 16 * spread(training)  # small blobs, as Arrow batches are cut by rows

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, 0, SLICE):
                tokens = Tokens.of(own.column(0))
                longer = [g[inside] for g, inside in grams(tokens.words[tokens.word], order)[1:]]
                times = np.bincount(tokens.word, minlength=len(tokens.words))
                for kind, (x, n) in enumerate(((tokens.words[times > 0], times[times > 0]), np.unique(np.concatenate(longer or [np.zeros(0, np.uint64)]), return_counts=True))):
                    bucket = _bucket(x, buckets)
                    by = np.argsort(bucket, kind="stable")
                    x, n, bucket = x[by], n[by].astype("<u4"), bucket[by]
                    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(x) else np.zeros(0, int)
                    ends = [*starts[1:].tolist(), len(x)]
                    blobs = ([a[s:e].tobytes() for s, e in zip(starts.tolist(), ends)] for a in (x, n))
                    columns = [pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(starts), kind), pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)]
                    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "x", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "x", "n", "bits"]

        def done(bucket: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
            sums = {k: _summed(*(np.concatenate([np.frombuffer(r[i], t) for r in rows]).astype(u) for i, t, u in ((0, "<u8", np.uint64), (1, "<u4", np.int64)))) for k, rows in held.items()}
            if 0 in sums:
                x, n = sums[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(x.view(np.int64)), pa.array(n), pa.nulls(len(x), pa.binary())], names=names)
            bits, entries = segment(*(np.concatenate(c) for c in zip(*sums.values())))
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([bucket], pa.int64()), pa.array([entries], pa.int64()), pa.array([bits], pa.binary())], names=names)

        at, held = None, {}
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                for bucket, kind, x, n in zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns)):
                    if bucket != at and held:
                        yield from done(at, held)
                        held = {}
                    at = bucket
                    held.setdefault(kind, []).append((x, n))
        if held:
            yield from done(at, held)

    sent = training.select(F.col(text).alias("text")).mapInArrow(counted, "bucket int, kind int, x binary, n binary")
    sent = sent.repartition(spread(training), "bucket").sortWithinPartitions("bucket")
    table = stored(sent.mapInArrow(merged, "kind int, x long, n long, bits binary"), "n-grams")
    counts, segments = table.where("kind = 0").select("x", "n"), table.where("kind = 1").select(F.col("x").cast("int").alias("bucket"), "bits")
    # Tokens by the power of two below their count: at most 64 rows.
    by = {r["p"]: (r["words"], r["tokens"]) for r in counts.groupBy((F.length(F.bin("n")) - 1).alias("p")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect()}
    least, held = 64, 0
    while least and held + by.get(least - 1, (0, 0))[0] <= top:
        least -= 1
        held += by.get(least, (0, 0))[0]
    frequent = counts.where(F.col("n") >= F.lit(2**least)).toArrow() if held else pa.table({"x": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})  # at most `top` rows
    x, n = frequent["x"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    by_x = np.argsort(x)
    size = table.where("kind = 1").agg(F.sum(F.length("bits"))).first()[0] or 0
    return Model(order, buckets, sum(t for _, t in by.values()), sum(w for w, _ in by.values()), counts, (x[by_x], n[by_x]), segments, size)


class Slice:
    """Texts' tokens and n-grams, and scores once a lookup of levels is there."""

    def __init__(self, texts: pa.Array, order: int):
        tokens = Tokens.of(texts)
        self.words, self.word, self.ends = tokens.words, tokens.word, tokens.ends
        self.x = self.words[self.word]
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.grams = grams(self.x, order)

    def different(self) -> np.ndarray:
        """Hashes of the different n-grams, in order."""
        return np.unique(np.concatenate([self.words, *(g for g, _ in self.grams[1:])]))

    def score(self, levels: Callable[[np.ndarray], np.ndarray], divisor: float) -> np.ndarray:
        """log10 probability of each text; `levels` looks up the levels of hashes."""
        last = VALUE[levels(self.words)][self.word]
        p = (last + 0.5) / divisor
        for n in range(1, len(self.grams)):
            g, inside = self.grams[n]
            own = VALUE[levels(g)]
            before = np.concatenate([[last[-1] if n == 1 else 0.0], last[:-1]])  # each text ends in END
            p = np.where(inside, (np.minimum(own, before) + MU * p) / (before + MU), p)
            last = own
        return np.add.reduceat(np.log10(p), self.starts)

    def base(self, top: tuple[np.ndarray, np.ndarray], divisor: float) -> tuple:
        """Each text's sum over its frequent tokens, their number, and its other tokens (hashes and times)."""
        at = np.minimum(np.searchsorted(top[0], self.words), max(len(top[0]) - 1, 0))
        hot = top[0][at] == self.words if len(top[0]) else np.zeros(len(self.words), bool)
        log = np.zeros(len(self.words))
        log[hot] = np.log10((top[1][at[hot]] + 0.5) / divisor)
        hot, log = hot[self.word], log[self.word]
        doc = np.searchsorted(self.ends, np.flatnonzero(~hot), side="right")
        x = self.x[~hot]
        by = np.lexsort((x, doc))
        doc, x = doc[by], x[by]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])])) if len(x) else np.zeros(0, int)
        times = np.diff(np.concatenate([first, [len(x)]]))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(self.ends)))]).astype(np.int32)
        lists = (pa.ListArray.from_arrays(pa.array(offsets), pa.array(v)) for v in (x[first].view(np.int64), times.astype(np.int64)))
        return np.add.reduceat(log, self.starts), np.add.reduceat(hot.astype(np.int64), self.starts), *lists


_FOUND = ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "hashes", "times"]


def _rows(own: Slice, levels: Callable[[np.ndarray], np.ndarray], doc_ids: pa.Array, model: tuple, first: int) -> pa.RecordBatch:
    top, divisor = model
    base, known, hashes, times = own.base(top, divisor)
    columns = [np.arange(first, first + len(own.ends)), doc_ids, own.ends - own.starts, known, base, own.score(levels, divisor), hashes, times]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=_FOUND)


def score(docs: DataFrame, model: Model, held_out: Column, text: str = "text", doc_id: str = "doc_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    sc, order = docs.sparkSession.sparkContext, model.order
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, hashes array<long>, times array<long>"
    shared = sc.broadcast((model.top, model.divisor))  # at most TOP counts
    if model.filter_bytes <= most_bytes:
        held = sc.broadcast(Filter.of(((r["bucket"], r["bits"]) for r in model.segments.toLocalIterator()), model.buckets, model.filter_bytes))  # at most MOST_BYTES

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = TaskContext.get().partitionId() << 40
            for batch in batches:
                for own in slices(batch, 1, SLICE):
                    found = Slice(own.column(1), order)
                    yield _rows(found, held.value.levels, own.column(0), shared.value, n)
                    n += own.num_rows

        found = stored(rows.mapInArrow(scored, schema), "scored")
    else:
        found = stored(_routed(rows, kind, model, shared, schema), "scored")

    # Tokens that are not among the frequent ones, with their exact counts.
    rare = stored(found.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("x")).select("row", F.col("x.hashes").alias("x"), F.col("x.times").alias("times")), "rare-tokens")
    rare = followed(rare, model.counts, "x", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(model.divisor))
    more = rare.groupBy("row").agg(F.sum(log * F.col("times")).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = found.drop("hashes", "times").join(more, "row", "left")
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def _routed(rows: DataFrame, kind: str, model: Model, shared, schema: str) -> DataFrame:
    """Scores with levels that are found where the segments are: n-grams go there in slices, levels come back."""
    order, buckets = model.order, model.buckets

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for own in slices(batch, 1, SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, at)), *own.columns], names=["slice", "doc_id", "text"])
                at += own.num_rows

    texts = stored(rows.mapInArrow(cut, f"slice long, doc_id {kind}, text string"), "slices")
    none = lambda t: F.lit(None).cast(t)

    def of_slices(batches: Iterator[pa.RecordBatch], answers: bool) -> Iterator[tuple]:
        """Slices of a stream that is in their order: number, doc_ids, texts, and levels by bucket."""
        at, ids, own, levels = None, [], [], {}
        for batch in batches:
            for s, part in ((int(v), batch.filter(pc.equal(batch.column(0), v))) for v in np.unique(batch.column(0).to_numpy(zero_copy_only=False))):
                if s != at:
                    if own:
                        yield at, ids, own, levels
                    at, ids, own, levels = s, [], [], {}
                if answers:
                    replies = part.filter(pc.equal(part.column(1), 0))
                    levels.update(zip(replies.column(4).to_pylist(), replies.column(5).to_pylist()))
                    part = part.filter(pc.equal(part.column(1), 1)).select([0, 2, 3])
                if part.num_rows:
                    ids.append(part.column(1))
                    own.append(part.column(2))
        if own:
            yield at, ids, own, levels

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, _, own, _ in of_slices(batches, False):
            x = Slice(pa.concat_arrays(own), order).different()
            bucket = _bucket(x, buckets)
            by = np.argsort(bucket, kind="stable")
            x, bucket = x[by], bucket[by]
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [x[s:e].tobytes() for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(x)])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(starts), at)), pa.array(blobs, pa.binary())], names=["bucket", "slice", "v"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out = []
            for bucket, s, v in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if bucket != at:
                    at, held = bucket, None
                if s is None:
                    held = Filter.of([(0, v)], 1, len(v))
                else:
                    x = np.frombuffer(v, "<u8")
                    out.append((s, bucket, (held.levels(x) if held else np.zeros(len(x), np.uint8)).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))], names=["slice", "bucket", "v"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, ids, own, levels in of_slices(batches, True):
            found = Slice(pa.concat_arrays(own), order)
            different = found.different()
            bucket, out = _bucket(different, buckets), np.zeros(len(different), np.uint8)
            by = np.argsort(bucket, kind="stable")
            out[by] = np.frombuffer(b"".join(levels[b] for b in np.unique(bucket).tolist()), np.uint8)
            yield _rows(found, lambda x, different=different, out=out: out[np.searchsorted(different, x)], pa.concat_arrays(ids), shared.value, at)

    ask = texts.repartition(spread(rows), "slice").sortWithinPartitions("slice").select("slice", "doc_id", "text").mapInArrow(asked, "bucket int, slice long, v binary")
    work = model.segments.select("bucket", F.lit(0).alias("role"), none("long").alias("slice"), F.col("bits").alias("v")).unionByName(ask.select("bucket", F.lit(1).alias("role"), "slice", "v"))
    work = work.repartition(spread(rows), "bucket").sortWithinPartitions("bucket", "role")
    replies = work.mapInArrow(answered, "slice long, bucket int, v binary")
    replies = replies.select("slice", F.lit(0).alias("role"), none(kind).alias("doc_id"), none("string").alias("text"), "bucket", "v")
    back = replies.unionByName(texts.select("slice", F.lit(1).alias("role"), "doc_id", "text", none("int").alias("bucket"), none("binary").alias("v")))
    back = back.repartition(spread(rows), "slice").sortWithinPartitions("slice", "role")
    return back.mapInArrow(scored, schema)
