"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Fingerprints of equal value are one node. A node lies in the tile given by the bit counts of its
segments. Two fingerprints that differ in r bits have segment counts that differ by r in sum at
most, so only tiles within the radius of each other are compared, and those completely: every
fingerprint of one against every fingerprint of the other, in numpy blocks. More fingerprints get
more segments and so finer tiles; the result is exact with any number.

A pair of tiles gives at most one link per fingerprint (a spanning forest of what it found), never
all pairs of a group, and components of the links are found by contraction.

`deduplicate_similar` is for near copies by similarity of shingle sets, which a small radius misses:
at similarity 0.8 about 10 of 64 bits differ, and by a radius that wide every fingerprint would have
to be compared with every other. So the tiled comparison links the fingerprints within RADIUS bits, and
for wider ones texts that share a band of MinHash values meet in a bucket as well; a bucket gives the links of a minimum spanning tree by fingerprint distance (all pairs where it has
few texts), and every link is checked on the shingle sets before it counts. Where members of a
bucket with many texts are then still apart, their shingle sets are compared exactly in the tasks,
by an inverted index of the shingles of two parts of the bucket, so a tree never loses a link.

Defined results: null, empty and white-space texts have no words and the fingerprint zero, linked
like any other; texts with fewer words than a shingle are one shingle; repeated rows share a node;
a null doc_id has the component of its fingerprint and never names one unless all ids are null; an
empty table gives no rows; other columns are ignored here and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.llm._common import followed, lookup, marked, slices, spread, stored, whole_row
from recordvol.llm.components import components

#: Most fingerprints of a tile that one task holds as its own; larger tiles are split.
TILE = 1 << 15
#: Fingerprints compared at once: rows and columns of a block.
BLOCK = (1 << 9, 1 << 12)
#: Bands of MinHash values, and values of a band: a pair of similarity 0.8 shares one with chance 0.9993.
BANDS, BAND = 24, 6
#: Bits within which the tiled comparison links fingerprints of near copies.
RADIUS = 3
#: Texts of a bucket that one task takes as its own, and of one whose pairs are all checked.
BUCKET, FEW = 1 << 13, 64
#: Bytes of shingle sets of a part of a bucket; a task compares two parts at once.
PART_BYTES = 8 << 20
_MIX = np.random.default_rng(8).integers(0, 1 << 32, (2, BANDS * BAND), dtype=np.uint32) | np.array([[1], [0]], np.uint32)
_FOLD = np.random.default_rng(9).integers(0, 1 << 63, (2, BAND), dtype=np.uint64) | np.uint64(1)


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text: A-Z lower-cased, ASCII white space between words."""
    h = shingles(text, words, seed)
    return _fingerprint(h) if len(h) else 0


def shingles(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """Hashes of the shingles of UTF-8 text in order, repeated ones too; none for a text without words."""
    import xxhash

    w = (text or b"").lower().split()  # for bytes, exactly A-Z and [\x20\x09-\x0D]
    if not w:
        return np.zeros(0, "<u8")
    found = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), found), "<u8")


def _fingerprint(h: np.ndarray) -> int:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # sums of 255 bits fit into a byte
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """doc_id, h (hash of the text) and fp (the fingerprint's bits as a long), one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                fp = np.array([fingerprint(t, words) for t in part.column(2).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, fp long")


def segments_for(n: int) -> int:
    """Segments that keep tiles small: comparisons per fingerprint stay in the thousands."""
    return 4 if n <= 1_000_000 else 8 if n <= 100_000_000 else 16


def offsets(segments: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of segment counts within the radius; of each and its negative, the first one, and none at all."""
    found = [()]
    for _ in range(segments):
        found = [(*x, d) for x in found for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    return [x for x in found if x >= (0,) * segments]


def links(nodes: DataFrame, radius: int = 2, segments: int | None = None, tile: int = TILE) -> DataFrame:
    """a, b: links that join all fingerprints (distinct, column fp) within `radius` bits, directly or in steps."""
    k = segments or segments_for(nodes.count())
    width = 64 // k
    base = width + 2 * radius + 1  # room for a count plus or minus the radius
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1))) for i in range(k)]
    number = sum((c.cast("long") * base**i for i, c in enumerate(counts)), F.lit(0).cast("long"))
    placed = nodes.select("fp", number.alias("tile"))
    moves = [sum(d * base**i for i, d in enumerate(x)) for x in offsets(k, radius)]

    sizes = placed.groupBy("tile").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    large = stored(sizes.select("tile", F.ceil(F.col("n") / tile).cast("int").alias("parts")), "large-tiles")
    parts = F.coalesce("parts", F.lit(1))
    home = placed.join(large, "tile", "left").select("tile", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), F.lit(0).alias("role"), "fp")
    visits = placed.select(F.explode(F.lit(moves)).alias("move"), "tile", "fp").select((F.col("tile") + F.col("move")).alias("tile"), "fp")
    visits = visits.join(large, "tile", "left").select("tile", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("role"), "fp")
    work = home.unionByName(visits).repartition(spread(nodes), "tile", "part").sortWithinPartitions("tile", "part", "role")
    return work.mapInArrow(partial(_compare, radius=radius), "a long, b long")


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for role, fp in _tiles(batches):
        visitors = int(np.searchsorted(role, 1))
        if 0 < visitors < len(fp):
            a, b = _forest(fp[:visitors], fp[visitors:], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """role and fp of each (tile, part), whose rows follow each other."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, part, role, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        ends = np.flatnonzero((np.diff(tile) != 0) | (np.diff(part) != 0)) + 1
        for lo, hi in zip([0, *ends], [*ends, len(fp)]):
            if (key := (tile[lo], part[lo])) != last and held:
                yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
                held = []
            last = key
            held.append([role[lo:hi].copy(), fp[lo:hi].copy()])
    if held:
        yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])


def _forest(own: np.ndarray, visiting: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For every fingerprint that is linked to a smaller one, itself and the smallest one it is joined with."""
    nodes = np.unique(np.concatenate([own, visiting]))
    top = np.arange(len(nodes))
    own_at, visiting_at = np.searchsorted(nodes, own), np.searchsorted(nodes, visiting)
    for i in range(0, len(visiting), BLOCK[0]):
        x = visiting[i : i + BLOCK[0], None].view(np.uint64)
        for j in range(0, len(own), BLOCK[1]):
            differ = np.bitwise_count(x ^ own[None, j : j + BLOCK[1]].view(np.uint64))
            p, q = np.nonzero(differ <= radius)
            _join(top, visiting_at[i + p], own_at[j + q])
    (moved,) = np.nonzero(top != np.arange(len(nodes)))
    return nodes[moved], nodes[top[moved]]


def _join(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b; top always points straight to the smallest member."""
    while True:
        x, y = top[a], top[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (up := top[top]).tobytes() != top.tobytes():
            top[:] = up


def _grouped(rows: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Distinct fingerprints (fp, rep, n) and, of those with links, their fp and root."""
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "fingerprints")
    roots = components(links(nodes, radius)).select(F.col("node").alias("fp"), "root")
    return nodes, roots


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id: one row per row of docs; component_id is the smallest doc_id reachable."""
    rows = stored(fingerprints(docs, text, words), "simhash")
    nodes, roots = _grouped(rows, radius)
    named = stored(nodes.join(roots, "fp").select("fp", "rep", "root"), "named")
    least = stored(named.groupBy("root").agg(F.min("rep").alias("least")), "least")
    least = followed(named, least, "root").select("fp", "least")
    group = stored(nodes.join(least, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), "n"), "components")
    return lookup(rows, group, "fp", "n").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs that stay, with all columns: of each group the row of the smallest doc_id.

    Rows with a null doc_id come last in a group; of repeated rows one stays. Only rows that may be
    in a group of several are shuffled.
    """
    rows = stored(fingerprints(docs, text, words), "simhash")
    nodes, roots = _grouped(rows, radius)
    several = nodes.join(roots, "fp", "left").where("n > 1 or root is not null").select("fp", F.coalesce("root", "fp").alias("root"), "n")
    return _first_rows(docs, rows, several, "fp", text)


def _first_rows(docs: DataFrame, rows: DataFrame, several: DataFrame, node: str, text: str) -> DataFrame:
    """The rows of docs that stay, given rows (doc_id, h, node) and the root and rows n of nodes in groups of several."""
    members = lookup(rows, stored(several, "several"), node, "n").where("root is not null")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    first = members.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("size"))
    members = stored(members.drop("n").withColumn("place", place), "members")
    members = lookup(members, stored(first, "first"), "root", "size").select("doc_id", "h", (F.col("place") == F.col("first")).alias("_rv_stays")).distinct()
    members = stored(members.select(F.xxhash64("doc_id", "h").alias("_rv_key"), "_rv_stays"), "members")

    keyed = docs.withColumn("_rv_key", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(text)))
    keyed = marked(keyed, F.col("_rv_key"), members.select("_rv_key"), "_rv_member")
    mine = keyed.where("_rv_member").join(members, "_rv_key", "left").where("coalesce(_rv_stays, true)")
    mine = mine.withColumn("_rv_alone", F.when(F.col("_rv_stays").isNull(), F.monotonically_increasing_id()))  # not a member after all
    same = Window.partitionBy("_rv_key", "_rv_alone").orderBy(whole_row(docs.columns))
    mine = mine.withColumn("_rv_rank", F.row_number().over(same)).where("_rv_rank = 1")
    return keyed.where("not _rv_member").select(*docs.columns).unionByName(mine.select(*docs.columns))


def bands(h: np.ndarray) -> np.ndarray:
    """A bucket for each band of MinHash values of a text's shingle hashes; texts without words share theirs."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * BAND, (1 << 32) - 1, np.uint32)
    for i in range(0, len(low), 1024):
        least = np.minimum(least, ((low[i : i + 1024, None] ^ _MIX[1]) * _MIX[0]).min(axis=0))
    mixed = (least.reshape(BANDS, BAND).astype(np.uint64) + _FOLD[1]) * _FOLD[0]
    mixed = (mixed ^ (mixed >> np.uint64(29))).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return (mixed * _FOLD[0, 0]).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            hashes = [shingles(t, words) for t in part.column(2).to_pylist()]
            fp = np.array([_fingerprint(h) if len(h) else 0 for h in hashes], dtype=np.uint64).view(np.int64)
            buckets = pa.array([bands(h) for h in hashes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp), buckets], names=["doc_id", "h", "fp", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            sets = [np.unique(shingles(t, words)).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["h", "shingles"])


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket, n: the buckets that several texts share (nodes: one row per text, columns h, fp, bands)."""
    placed = nodes.select(F.explode("bands").alias("bucket"))
    return stored(placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")


def _placed(nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """h, fp, bucket, n: the texts of the buckets given; only those are shuffled."""
    placed = nodes.select("h", "fp", F.explode("bands").alias("bucket"))
    placed = marked(placed, F.col("bucket"), buckets.select("bucket"), "several").where("several").drop("several")
    return lookup(placed, buckets, "bucket", "n").where("n is not null")


def _dealt(placed: DataFrame, parts: Column, partitions: int, *columns: str) -> DataFrame:
    """bucket, piece and columns: a bucket's texts dealt into parts, each two parts of it one piece, a piece in one task."""
    placed = placed.withColumn("parts", parts.cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("h", F.lit(3)), "parts").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or other <> part")
    work = placed.select("bucket", (F.least("part", "other") * F.col("parts").cast("long") + F.greatest("part", "other")).alias("piece"), *columns)
    return work.repartition(partitions, "bucket", "piece").sortWithinPartitions("bucket", "piece")


def _near(nodes: DataFrame, buckets: DataFrame, bucket: int) -> DataFrame:
    """a, b: pairs of texts to check: all of a bucket with few texts, of any other a spanning tree.

    A bucket with more than `bucket` texts is dealt into parts and every two parts are one piece of
    work; the trees of the pieces hold that of the whole. No task holds a whole one.
    """
    work = _dealt(_placed(nodes, buckets), F.ceil(F.col("n") / bucket), spread(nodes), "h", "fp")
    return work.mapInArrow(_trees, "a long, b long").distinct()


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for h, fp in _tiles(batches):
        if len(h) > 1:
            a, b = np.triu_indices(len(h), 1) if len(h) <= FEW else _tree(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(h[a], h[b])), pa.array(np.maximum(h[a], h[b]))], names=["a", "b"])


def _tree(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the links of a minimum spanning tree by differing bits (Prim's)."""
    left = np.arange(1, len(fp))
    off, to = np.bitwise_count(fp[1:] ^ fp[0]), np.zeros(len(left), np.int64)
    a, b = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    for i in range(len(a)):
        at = int(off.argmin())
        a[i], b[i] = left[at], to[at]
        new = left[at]
        for x in (left, off, to):  # the last one takes its place
            x[at] = x[-1]
        left, off, to = left[:-1], off[:-1], to[:-1]
        d = np.bitwise_count(fp[left] ^ fp[new])
        nearer = d < off
        off[nearer], to[nearer] = d[nearer], new
    return a, b


def _checked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stays = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            stays.append(both >= least * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(stays, pa.bool_()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first two columns, which follow each other."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        ends = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        for lo, hi in zip([0, *ends], [*ends, len(a)]):
            if (key := (a[lo], b[lo])) != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _joins(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        h, root = piece["h"].to_numpy(), piece["root"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in piece["shingles"]]
        if pairs := list(_apart(sets, root, least)):
            a, b = h[np.array(pairs).T]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _apart(sets: list[np.ndarray], root: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Places of sets that join all roots linked by similarity, one link for each two that meet.

    Each two sets of different roots have one outside the root with most sets, so only those look
    up the lists of sets that hold their shingles; the counts are the exact sizes of the overlaps.
    """
    names, top, n = np.unique(root, return_inverse=True, return_counts=True)
    if len(names) == 1:
        return
    sizes = np.array([len(x) for x in sets])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[np.argsort(shingle, kind="stable")]
    lengths = np.bincount(shingle)
    starts = np.cumsum(lengths) - lengths
    for i in np.flatnonzero(top != n.argmax()):
        mine = shingle[bounds[i] : bounds[i + 1]]
        at = np.repeat(starts[mine] - np.cumsum(lengths[mine]) + lengths[mine], lengths[mine])
        both = np.bincount(holders[at + np.arange(len(at))], minlength=len(sets))
        near = np.flatnonzero((both >= least * (sizes[i] + sizes - both)) & (top != top[i]))
        met, first = np.unique(top[near], return_index=True)
        yield from ((int(i), int(j)) for j in near[first])
        top[np.isin(top, met)] = top[i]


def _sets(docs: DataFrame, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """h, shingles: one row per text whose hash is in `wanted` (stored, one row per h), and its other columns."""
    rows = docs.select(F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("text"))
    rows = marked(rows, F.col("h"), wanted.select("h"), "_rv_end").where("_rv_end").select("h", "text")
    sets = rows.mapInArrow(partial(_shingle_sets, words=words), "h long, shingles binary")
    return sets.dropDuplicates(["h"]).join(wanted, "h")


def _checked_links(docs: DataFrame, pairs: DataFrame, text: str, words: int, least: float) -> DataFrame:
    """The pairs (stored) whose shingle sets have similarity `least` or more."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count("*").alias("pairs"))
    sets = stored(_sets(docs, text, words, stored(ends, "ends")), "shingles")
    side = lambda name, column: sets.select(F.col("h").alias(name), F.col("shingles").alias(column), "pairs")
    found = lookup(pairs, side("a", "x"), "a", "pairs").drop("pairs")
    found = lookup(found, side("b", "y"), "b", "pairs").select("a", "b", "x", "y")
    return found.mapInArrow(partial(_checked, least=least), "a long, b long")


def _tiled(nodes: DataFrame, radius: int) -> DataFrame:
    """a, b: pairs of texts to check whose fingerprints are equal or linked within the radius, by the tiled comparison.

    Texts of one fingerprint are each paired with one of them, and those of linked fingerprints as the links say.
    """
    firsts = stored(nodes.groupBy("fp").agg(F.min("h").alias("first")), "tile-texts")
    same = nodes.select("h", "fp").join(firsts, "fp").where("h <> first").select("h", F.col("first").alias("other"))
    found = stored(links(firsts.select("fp"), radius), "tile-links")
    found = found.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("h")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("other")), "b")
    return same.unionByName(found.select("h", "other")).select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b"))


def similar_roots(docs: DataFrame, nodes: DataFrame, text: str = "text", words: int = 5, least: float = 0.8, bucket: int = BUCKET, radius: int = RADIUS) -> DataFrame:
    """node, root: the groups of texts (by hash) linked by shingle sets of Jaccard similarity `least` or more."""
    buckets = _buckets(nodes)
    pairs = _near(nodes, buckets, bucket).unionByName(_tiled(nodes, radius)).distinct()
    near = stored(_checked_links(docs, stored(pairs, "pairs"), text, words, least), "similar")
    roots = components(near)

    large = _placed(nodes, buckets.where(F.col("n") > FEW)).select("bucket", "h", "n")
    large = large.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    large = stored(large, "large-buckets")
    apart = stored(large.groupBy("bucket").agg(F.first("n").alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("bucket", "n"), "apart")
    if apart.isEmpty():
        return roots
    large = stored(lookup(large.drop("n"), apart, "bucket", "n").where("n is not null"), "large-buckets")
    sets = stored(_sets(docs, text, words, stored(large.select("h").distinct(), "wanted")), "shingles")
    sizes = large.join(sets.select("h", F.length("shingles").alias("size")), "h").groupBy("bucket").agg(F.first("n").alias("n"), F.sum("size").alias("size"))
    placed = lookup(large.drop("n"), stored(sizes, "sizes"), "bucket", "n").join(sets, "h")
    work = _dealt(placed, F.greatest(F.lit(1), F.ceil(F.col("size") / PART_BYTES)), spread(nodes), "h", "root", "shingles")
    more = work.mapInArrow(partial(_joins, least=least), "a long, b long")
    return components(near.unionByName(stored(more, "more")))


def deduplicate_similar(docs: DataFrame, text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay, with all columns: of each group of `similar_roots` the row of the smallest doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("text"))
    rows = stored(rows.mapInArrow(partial(_signatures, words=words), "doc_id long, h long, fp long, bands array<long>"), "signatures")
    nodes = stored(rows.groupBy("h").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("n")), "texts")
    roots = similar_roots(docs, nodes, text, words, least).select(F.col("node").alias("h"), "root")
    several = nodes.join(roots, "h", "left").where("n > 1 or root is not null").select("h", F.coalesce("root", "h").alias("root"), "n")
    return _first_rows(docs, rows.select("doc_id", "h"), several, "h", text)
