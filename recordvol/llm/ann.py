"""Approximate nearest neighbours: a forest of random-projection trees with a shared priority queue.

Equal vectors are one node with the smallest identifiers of its members, as many as a result can
need; so a vector that a third of all rows share costs one node. The splits are fitted on at most
SAMPLE nodes: a tree halves them at the median of their projection on the difference of two random
ones. Every node is then put into one leaf of each tree.

A query descends all trees at once: one queue holds the open branches of all trees by how far in
sum the query is on their wrong sides, and the nearest is followed until the leaves taken hold
enough candidates. How many are enough is measured: PROBES nodes of the sample are compared with all
nodes exactly, and the search goes as far as RECALL of their true neighbours need.

Leaves are laid out in parts of at most PART nodes (a larger leaf is several parts). A part's nodes
meet the queries that look at any of its leaves, each query once a part with the list of these
leaves. The part gives one row a query: the best of all its leaves, with cosines computed anew in
extended precision on the original vectors. So rows are at most queries times parts, whatever the
leaves hold, and a task holds one part. With few nodes every leaf is taken and the result is exact.

Defined results: null and zero vectors, vectors with null or non-finite components, of another
length than most, and rows with a null identifier take no part; ties go to the smaller identifier,
also of parallel vectors, as a cosine is rounded to double once; vectors of any magnitude take part;
rows that repeat an identifier are the query's own as well; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordvol.llm._common import lookup, spread, stored

#: Nodes the splits are fitted on, trees, nodes of a leaf about, probes, share of their neighbours wanted.
SAMPLE, TREES, LEAF, PROBES, RECALL = 20_000, 4, 300, 256, 0.965
#: Least candidates of a query; most nodes of a part; queries and nodes compared at once.
LEAST, PART, BLOCK = 2000, 1 << 16, (256, 4096)


@dataclass(frozen=True)
class Forest:
    """Complete binary trees: directions and thresholds of the inner nodes by level, tree by tree."""

    depth: int
    directions: np.ndarray  # trees, 2^depth - 1, dimensions
    thresholds: np.ndarray  # trees, 2^depth - 1

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through all trees."""
        out = np.zeros((len(unit), len(self.directions)), np.int64)
        for t in range(len(self.directions)):
            at = np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                right = np.einsum("ij,ij->i", unit, self.directions[t][at]) > self.thresholds[t][at]
                at = 2 * at + 1 + right
            out[:, t] = t * 2**self.depth + at - (2**self.depth - 1)
        return out

    def search(self, unit: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[list[int]]:
        """For each query the leaves to look at, best first, until they hold `most` candidates."""
        inner, shape = 2**self.depth - 1, self.directions.shape
        for i in range(0, len(unit), 64):
            part = unit[i : i + 64]
            sides = (part @ self.directions.reshape(-1, shape[2]).T).reshape(len(part), shape[0], inner) - self.thresholds
            for side in sides.tolist():
                queue = [(0.0, t, 0) for t in range(shape[0])]
                found, total = [], 0
                while queue and total < most:
                    wrong, t, at = heapq.heappop(queue)
                    while at < inner:
                        x = side[t][at]
                        heapq.heappush(queue, (wrong + abs(x), t, 2 * at + (1 if x > 0 else 2)))
                        at = 2 * at + (2 if x > 0 else 1)
                    leaf = t * 2**self.depth + at - inner
                    if sizes[leaf]:
                        found.append(leaf)
                        total += sizes[leaf]
                yield found


def grow(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 1) -> Forest:
    """Trees over unit vectors; a branch without two different vectors splits at random."""
    rng = np.random.default_rng(seed)
    inner, dims = 2**depth - 1, sample.shape[1]
    directions, thresholds = np.zeros((trees, inner, dims), np.float32), np.zeros((trees, inner), np.float32)
    for t in range(trees):
        members = {0: np.arange(len(sample))}
        for at in range(inner):
            own = members.pop(at, np.zeros(0, int))
            line = np.zeros(dims)
            if len(own) >= 2:
                a, b = sample[rng.choice(own, 2, replace=False)]
                line = a - b
            if not np.linalg.norm(line) > 1e-9:
                line = rng.standard_normal(dims)
            directions[t, at] = line / np.linalg.norm(line)
            far = sample[own] @ directions[t, at]
            thresholds[t, at] = np.median(far) if len(own) else 0.0
            members[2 * at + 1], members[2 * at + 2] = own[far <= thresholds[t, at]], own[far > thresholds[t, at]]
    return Forest(depth, directions, thresholds)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).where("vec_id is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (usual["n"] if usual else 0))


def neighbours(vectors: DataFrame, is_query: str, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", search: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row that fits the SQL condition is_query (over vec_id), the k nearest others."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, vec_id, embedding), "vectors")
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    members = rows.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= k + 1)
    nodes = members.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most k + 1 each
    nodes = stored(nodes.withColumn("node", F.col("ids")[0]), "nodes")
    count = nodes.count()
    queries = rows.where(is_query)
    asked = stored(queries.groupBy("embedding").agg(F.min("vec_id").alias("q"), F.count("*").alias("n")), "queries")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not count:
        return empty

    draw = F.xxhash64("node", F.lit(3))
    sample = nodes.where(F.pmod(draw, F.lit(1 << 40)) < min(1 << 40, int((1 << 40) * 1.2 * (SAMPLE + 50) / count))).orderBy(draw, "node").limit(SAMPLE)
    depth = int(np.ceil(np.log2(max(1, min(count / LEAF, SAMPLE / 4)))))
    sample = sample.select("node", "embedding").collect()  # at most SAMPLE rows
    points = _unit(np.array([r["embedding"] for r in sample], dtype=float))
    forest = grow(points, depth)
    kind = "<f4" if nodes.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    shared = spark.sparkContext.broadcast(forest)

    placed = nodes.select("node", "embedding").mapInArrow(_indexed(shared, kind), "node long, leaves array<int>, v binary")
    placed = stored(placed, "leaves")
    sizes = np.zeros(TREES * 2**depth, np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect():  # at most the leaves of the forest
        sizes[r["leaf"]] = r["n"]
    if search is None:
        probes = np.arange(len(sample))[:: max(1, len(sample) // PROBES)][:PROBES]
        search = _enough(nodes, forest, sizes, [sample[i]["node"] for i in probes], points[probes], k)
    parts = Parts.of(sizes, min(PART, max(1, int(sizes.sum()) // spread(vectors))))
    schema = "part long, role int, leaf int, id long, leaves binary, v binary"
    asking = asked.select("q", "embedding").mapInArrow(_asking(shared, kind, sizes, parts, search), schema)
    work = placed.mapInArrow(_dealt(parts), schema).unionByName(asking)
    work = work.repartition(spread(vectors), "part").sortWithinPartitions("part", "role", "leaf")
    near = work.mapInArrow(_ranked(kind, k + 1), "q long, near array<struct<away: double, node: bigint>>")

    every = near.groupBy("q").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))  # k + 1 of each part
    near = stored(every.select("q", F.explode(F.slice("near", 1, k + 1)).alias("x")).select("q", F.col("x.node").alias("node"), F.col("x.away").alias("away")), "near")
    used = near.groupBy("node").agg(F.count("*").alias("times"))
    named = lookup(near, stored(nodes.select("node", "ids").join(used, "node"), "named"), "node", "times").select("q", "away", F.explode("ids").alias("vec_id"))
    entry = F.struct("away", "vec_id", (-F.col("away")).alias("score"))
    lists = named.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("near"))  # at most (k + 1)^2 each
    lists = stored(asked.drop("embedding").join(lists, "q"), "lists")

    # A vector that very many queries share is one row of asked; its hash finds it, and the vector itself decides.
    hashed = asked.groupBy(F.xxhash64("embedding").alias("h")).agg(F.collect_list(F.struct("embedding", "q")).alias("found"), F.sum("n").alias("n"))
    own = stored(queries.select(F.col("vec_id").alias("query_id"), "embedding", F.xxhash64("embedding").alias("h")), "asking")
    own = lookup(own, stored(hashed, "asked"), "h", "n")
    own = own.select("query_id", F.filter("found", lambda x: x["embedding"] == F.col("embedding"))[0]["q"].alias("q"))
    found = lookup(stored(own, "asked"), lists, "q", "n")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = found.select("query_id", F.posexplode(others).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


@dataclass(frozen=True)
class Parts:
    """How leaves are laid out: the first part of each leaf, and how many it has (more than one only where it is alone in them)."""

    first: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, most: int) -> Parts:
        number = np.maximum(1, -(-sizes // most))
        first, at, held = np.zeros(len(sizes), np.int64), 0, 0
        for leaf, (n, k) in enumerate(zip(sizes.tolist(), number.tolist())):
            if held and (held + n > most or k > 1):
                at, held = at + 1, 0
            first[leaf] = at
            held += n
            if k > 1:
                at, held = at + k, 0
        return cls(first, number)


def _enough(nodes: DataFrame, forest: Forest, sizes: np.ndarray, own: list[int], points: np.ndarray, k: int) -> int:
    """Candidates with which the search reaches RECALL of the probes' true k nearest."""
    me = np.array(own)[:, None]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cos, ids, leaves = np.full((len(points), k), -3.0), np.zeros((len(points), k), np.int64), np.zeros((len(points), k, TREES), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK[1]):
                node, unit = batch.column(0).slice(i, BLOCK[1]).to_numpy(zero_copy_only=False), _unit(_matrix(batch.column(1).slice(i, BLOCK[1])))
                new = np.where(me == node, -2.0, points @ unit.T)
                new, all_ids = np.concatenate([cos, new], 1), np.concatenate([ids, np.broadcast_to(node, new.shape)], 1)
                all_leaves = np.concatenate([leaves, np.broadcast_to(forest.leaves(unit), (*cos.shape[:1], len(node), TREES))], 1)
                top = np.argpartition(-new, k - 1, axis=1)[:, :k]
                cos, ids, leaves = np.take_along_axis(new, top, 1), np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_leaves, top[:, :, None], 1)
        p, j = np.nonzero(cos > -2)
        found = [pa.array(p), pa.array(ids[p, j]), pa.array(cos[p, j]), pa.array(list(leaves[p, j]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(found, names=["p", "node", "score", "leaves"])

    near = nodes.select("node", "embedding").mapInArrow(exact, "p long, node long, score double, leaves array<long>")
    best = Window.partitionBy("p").orderBy(F.desc("score"), "node")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("p", "leaves").collect()  # at most PROBES * k
    by: dict[int, list] = {}
    for r in near:
        by.setdefault(r["p"], []).append(r["leaves"])
    needed = []
    for p, found in enumerate(forest.search(points, sizes, int(sizes.sum()) + 1)):
        after = dict(zip(found, np.cumsum(sizes[found]).tolist()))
        needed += [min(after[x] for x in leaves) for leaves in by.get(p, [])]
    return max(LEAST, int(np.quantile(needed, RECALL)) + 1) if needed else LEAST


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that the largest component is about 1 and no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


_ROWS = ["part", "role", "leaf", "id", "leaves", "v"]


def _indexed(shared, kind: str):
    """The leaf of each node in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                x = _matrix(part.column(1))
                leaves = pa.array(list(shared.value.leaves(_unit(x)).astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), leaves, _bytes(x, kind)], names=["node", "leaves", "v"])

    return run


def _bytes(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())


def _dealt(parts: Parts):
    """A row for each node and tree, with the part it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                own = batch.slice(i, 2000)
                leaf = own.column(1).flatten().to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(own.num_rows), TREES)
                ids = own.column(0).to_numpy(zero_copy_only=False)[at]
                spread_ = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                part = parts.first[leaf] + spread_ % parts.number[leaf]
                none = pa.nulls(len(leaf), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(leaf), np.int32)), pa.array(leaf), pa.array(ids), none, own.column(2).take(pa.array(at))], names=_ROWS)

    return run


def _asking(shared, kind: str, sizes: np.ndarray, parts: Parts, most: int):
    """A row for each query and part it looks at, with its leaves there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                own = batch.slice(i, 200)
                x = _matrix(own.column(1))
                part, at, leaves = [], [], []
                for j, found in enumerate(shared.value.search(_unit(x), sizes, most)):
                    found = np.sort(np.array(found, np.int32))
                    first, number = parts.first[found], parts.number[found]
                    for lo, hi in _runs(first):
                        own_leaves = found[lo:hi].tobytes()
                        for p in range(int(first[lo]), int(first[lo] + number[lo])):
                            part.append(p)
                            at.append(j)
                            leaves.append(own_leaves)
                ids = own.column(0).take(pa.array(at, pa.int64()))
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int32)), ids, pa.array(leaves, pa.binary()), _bytes(x, kind).take(pa.array(at, pa.int64()))], names=_ROWS)

    return run


def _runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where rows that agree in all keys begin and end."""
    if not len(keys[0]):
        return []
    ends = (np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1).tolist()
    return list(zip([0, *ends], [*ends, len(keys[0])]))


def _best(q: np.ndarray, node: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` best rows of each q, ordered by q; ties to the smaller node."""
    order = np.lexsort((node, -score, q))
    q = q[order]
    start = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0)) if len(q) else q
    return order[np.arange(len(q)) - start < most]


class _Part:
    """Nodes of a part, in order of their leaves."""

    def __init__(self, leaf: np.ndarray, node: np.ndarray, x: np.ndarray):
        self.node, self.x = node, _scaled(x)
        self.unit = self.x / np.sqrt((self.x * self.x).sum(axis=1, keepdims=True))
        self.place = {int(leaf[lo]): (lo, hi) for lo, hi in _runs(leaf)}

    def near(self, y: np.ndarray, leaves: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query's place, node and cosine of the `most` nearest nodes of each query in its leaves."""
        y = _scaled(y)
        unit = y / np.sqrt((y * y).sum(axis=1, keepdims=True))
        q, leaf = np.repeat(np.arange(len(y)), [len(x) for x in leaves]), np.concatenate(leaves)
        order = np.argsort(leaf, kind="stable")
        q, leaf = q[order], leaf[order]
        # Twice as many as asked for go on to extended precision; what BLAS rounds apart is still a tie here.
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for lo, hi in _runs(leaf):
            start, end = self.place.get(int(leaf[lo]), (0, 0))
            for i in range(start, end, BLOCK[1]):
                cos = np.round(unit[q[lo:hi]] @ self.unit[i : min(end, i + BLOCK[1])].T, 13)
                width = cos.shape[1]
                least = np.partition(cos, width - 2 * most, axis=1)[:, width - 2 * most, None] if width > 2 * most else -2.0
                a, b = np.nonzero(cos >= least)
                found.append((q[lo:hi][a], i + b, cos[a, b]))
        q, at, cos = (np.concatenate(x) for x in zip(*found))
        _, once = np.unique(q * len(self.node) + at, return_index=True)
        q, at, cos = q[once], at[once], cos[once]
        some = _best(q, self.node[at], cos, 2 * most)
        q, at = q[some], at[some]
        cos = _cosines(y[q], self.x[at])
        some = _best(q, self.node[at], cos, most)
        return q[some], self.node[at[some]], cos[some]


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, in extended precision and rounded to double at the end."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return ((a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))).astype(np.float64)


_NEAR = pa.list_(pa.struct([("away", pa.float64()), ("node", pa.int64())]))


def _ranked(kind: str, most: int):
    """A row for each query and part: the `most` nearest nodes there."""

    def vectors(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)

    def answer(part: _Part, own: pa.RecordBatch) -> pa.RecordBatch:
        leaves = [np.frombuffer(x, np.int32) for x in own.column(4).to_pylist()]
        q, node, cos = part.near(vectors(own.column(5)), leaves, most)
        ends = np.concatenate([[0], np.cumsum(np.bincount(q, minlength=own.num_rows))]).astype(np.int32)
        rows = pa.StructArray.from_arrays([pa.array(-cos), pa.array(node)], fields=list(_NEAR.value_type))
        return pa.RecordBatch.from_arrays([own.column(3), pa.ListArray.from_arrays(pa.array(ends), rows)], names=["q", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, part = None, [], None
        for batch in batches:
            key, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for lo, hi in _runs(key, role):
                own = batch.slice(lo, hi - lo)
                if key[lo] != last:
                    last, held, part = key[lo], [], None
                if role[lo] == 0:
                    held.append((own.column(2).to_numpy(zero_copy_only=False).copy(), own.column(3).to_numpy(zero_copy_only=False).copy(), vectors(own.column(5))))
                elif held or part:
                    if part is None:
                        part, held = _Part(*(np.concatenate(x) for x in zip(*held))), []
                    for i in range(0, own.num_rows, BLOCK[0]):
                        yield answer(part, own.slice(i, BLOCK[0]))

    return run
