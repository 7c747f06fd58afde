"""Mixing sources to target weights by the cube method.

A source whose target is r times its size takes every document floor(r) times, and once more those
that the cube method draws with inclusion probability r - floor(r). The draw is balanced: it keeps
the number of documents and the number of words of each source at their expected totals. Each
flight step moves three probabilities along the null space of these two constraints until one is 0
or 1. Blocks of a source fly independently; at most two undecided documents of each block go on to
the next level, with the largest and the smallest few, which stay out of the flight, until the
source has one block. There this landing problem of at most 16 documents is decided by trying all
outcomes. A source lands when it has one block itself, whatever the others have.

A source's very long documents are settled before, as small documents cannot make up for half of
one in the landing. What they take more or less than expected is spread over the chances of the
source's other documents, so the expected words still equal the target.

Repeated rows (same id, text and source) are counted first and numbered by their count, so they are
alike in every run. Blocks are drawn by hash of id, text and number: a source, or a row, with a
third of all rows is as many groups as its size needs, and reruns agree whatever the partitions.
The targets are found by sorting one row per source (some 40 bytes) in one task.

Defined results: a null source is a source of its own, the last; null and empty texts have size 0
and take nothing; a source without words has target 0; repeated rows are drawn each for itself; a
null doc_id is an id like any other; an empty table gives no rows; other columns are ignored here
and kept by `mix`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.llm._common import lookup, spread, stored

#: Documents of a block, about.
BLOCK = 4096
#: The largest and the smallest documents of a source's last block that only land.
LANDING = (8, 6)
#: A document of more than so many mean sizes of its source is very long; most of a source that are settled first.
LONG, MOST_LONG = 20, 256
WEIGHTS = (1, 2, 3)
#: A target is at most so many times its source.
MOST = 3
FLIGHT = "doc_id long, h long, source string, size long, place long, chance double, copies int, block long, blocks long"
#: What tells two rows of a flight apart.
ROW = ("source", "size", "h", "doc_id", "place")


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, docs, source_size, target for sizes (source, docs, source_size), one row per source.

    The target is weight * level up to most * source_size; the level is the one at which all
    targets add up to the total size. Sources in the order of what caps them are capped up to one
    place, so running sums find the level.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy()
    rows = rows.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(below), F.lit(0)),
            "left": F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(below), F.lit(0)),
            "whole": F.sum("source_size").over(total),
        }
    )
    level = (F.col("whole") - F.col("capped")) / F.col("left")
    # The first source that the level of all sources from it on does not cap.
    fits = F.col("weight") * level <= F.col("cap")
    rows = rows.withColumn("level", F.min(F.when(fits, F.struct(F.col("capped"), level.alias("level")))).over(total)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level"))
    return rows.select("source", "docs", "source_size", F.when(F.col("whole") > 0, target).otherwise(0.0).alias("target"))


def plan(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, h, source, size, source_size, target, copies: one row per row of docs; h is the hash of its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"))
    rows = stored(rows.groupBy("doc_id", "h", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    wanted = stored(targets(rows.groupBy("source").agg(F.sum("rows").alias("docs"), F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most), "targets")

    keyed = wanted.select(_key(), "docs", "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / block))
    flying = lookup(numbered(rows, block).withColumn("_rv_key", _key()), keyed, "_rv_key", "docs").select(
        "doc_id", "h", "source", "size", "place",
        (ratio - F.floor(ratio)).alias("chance"),
        F.floor(ratio).cast("int").alias("copies"),
        F.pmod(F.xxhash64("doc_id", "h", "place"), blocks).alias("block"),
        blocks.alias("blocks"),
        "docs", "source_size",
    )
    most_blocks = wanted.agg(F.max(F.ceil(F.col("docs") / block))).first()[0] or 0
    decided, level, factor = [], 0, max(2, block // sum(LANDING, 2))
    flying, long = _settled(flying)
    decided.append(long)
    while True:
        flown = stored(flying.groupBy("source", "block").applyInPandas(_flights(level), FLIGHT), "flight")
        decided.append(flown.where("chance = 0 or chance = 1"))
        if most_blocks <= 1:
            break
        # At most 16 documents a block are open: each next level has one block for `factor` blocks of this one.
        flying = flown.where("chance > 0 and chance < 1").withColumn("block", F.floor(F.col("block") / factor)).withColumn("blocks", F.ceil(F.col("blocks") / factor))
        most_blocks, level = -(-most_blocks // factor), level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    out = out.withColumn("copies", F.col("copies") + F.col("chance").cast("int"))
    out = out.select("doc_id", "h", "source", "size", "copies", _key())
    return lookup(out, keyed, "_rv_key", "docs").select("doc_id", "h", "source", "size", "source_size", "target", "copies")


def _key() -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_rv_key")


def numbered(rows: DataFrame, chunk: int) -> DataFrame:
    """rows without their column `rows`, each as often as it says, numbered from 0 (place). No task holds more than a chunk of one row's."""
    chunks = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / chunk))).alias("chunk"))
    if not rows.where(F.col("rows") > chunk).isEmpty():
        chunks = chunks.repartition(spread(rows), "doc_id", "h", "chunk")
    first = F.col("chunk") * chunk
    return chunks.withColumn("place", F.explode(F.sequence(first, F.least(first + chunk, F.col("rows")) - 1))).drop("rows", "chunk")


def _settled(flying: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents that fly, with the chances that are left to them, and the very long ones, decided."""
    columns = [c.split()[0] for c in FLIGHT.split(", ")]
    by_size = Window.partitionBy("source").orderBy(F.desc("size"), "h", "doc_id", "place")
    is_long = (F.col("size") * F.col("docs") > LONG * F.col("source_size")) & (F.col("chance") > 0)
    long = flying.where(is_long).withColumn("nth", F.row_number().over(by_size)).where(F.col("nth") <= MOST_LONG)
    settle = long.select(*columns[:-2], F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("blocks"), F.col("chance").alias("was"), "docs")
    decide = _flights(0)
    settled = settle.groupBy("source").applyInPandas(lambda pdf: decide(pdf.drop(columns=["was", "docs"])).assign(was=pdf["was"].iloc[0], docs=pdf["docs"].iloc[0]), f"{FLIGHT}, was double, docs long")
    settled = stored(settled, "settled")
    over = settled.groupBy(_key()).agg(F.sum((F.col("was") - F.col("chance")) * F.col("size")).alias("over"), F.sum("size").alias("words"), F.max("docs").alias("in_source"))
    same = lambda t, ks: [F.col(f"f.{k}").eqNullSafe(F.col(f"{t}.{k}")) for k in ks]
    rest = lookup(flying.withColumn("_rv_key", _key()), stored(over, "over"), "_rv_key", "in_source")
    maybe = is_long & F.col("words").isNotNull()
    rest = rest.select(*flying.columns, "over", "words", F.coalesce(maybe, F.lit(False)).alias("maybe"))
    few = rest.where("maybe").alias("f").join(settled.select(*ROW).alias("d"), same("d", ROW), "left_anti")
    rest = rest.where("not maybe").unionByName(few)
    moved = F.col("chance") + F.col("over") / (F.col("source_size") - F.col("words"))
    chance = F.when(F.col("over").isNotNull() & (F.col("chance") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))).otherwise(F.col("chance"))
    return rest.withColumn("chance", chance).select(*columns), settled.select(*columns)


def _flights(level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size", "place"], kind="stable", ignore_index=True)
        chance, size = pdf["chance"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
        seed = [int(x) & 0xFFFFFFFF for x in (pdf["h"].iloc[0], pdf["block"].iloc[0], level)]
        by_size = np.argsort(-size, kind="stable")
        by_size = by_size[(chance[by_size] > 0) & (chance[by_size] < 1)]
        stay = np.unique(np.concatenate([by_size[:LANDING[0]], by_size[-LANDING[1]:]]))
        fly = np.setdiff1d(np.arange(len(pdf)), stay)
        chance[fly], open_ = flight(chance[fly], size[fly], np.random.default_rng(seed))
        if pdf["blocks"].iloc[0] <= 1:
            few = np.concatenate([stay, fly[open_]]).astype(int)
            chance[few] = landing(chance[few], size[few])
        return pdf.assign(chance=chance)

    return one_block


def flight(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, list[int]]:
    """Chances moved to 0 or 1, but for at most two, whose places come second.

    Sums of the chances and of chance * size stay as they are. A step takes three open documents:
    (s2-s3, s3-s1, s1-s2) is orthogonal to both their counts and their sizes s.
    """
    out, draws = chance.copy(), rng.random(len(chance) + 1)
    held: list[list[float]] = []  # place, chance, size of the open documents, at most three
    step = 0
    for i, (p, s) in enumerate(zip(chance.tolist(), size.tolist())):
        if not 1e-9 < p < 1 - 1e-9:
            out[i] = round(p)
            continue
        held.append([i, p, s])
        if len(held) < 3:
            continue
        (_, p0, s0), (_, p1, s1), (_, p2, s2) = held
        u = (s1 - s2, s2 - s0, s0 - s1)
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        ahead = min((1 - p) / x if x > 0 else -p / x for p, x in zip((p0, p1, p2), u) if x)
        back = min(p / x if x > 0 else (p - 1) / x for p, x in zip((p0, p1, p2), u) if x)
        by = ahead if draws[step] * (ahead + back) < back else -back
        step += 1
        for h, x in zip(held, u):
            h[1] += by * x
        if all(1e-9 < h[1] < 1 - 1e-9 for h in held):  # rounding: the nearest one has arrived
            near = min(held, key=lambda h: min(h[1], 1 - h[1]))
            near[1] = float(round(near[1]))
        for h in held:
            out[int(h[0])] = h[1] if 1e-9 < h[1] < 1 - 1e-9 else round(h[1])
        held = [h for h in held if 1e-9 < h[1] < 1 - 1e-9]
    return out, [int(h[0]) for h in held]


def landing(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The outcome for a few open documents whose words and, less, number are nearest to expected."""
    if not len(chance):
        return chance
    outcomes = (np.arange(1 << len(chance))[:, None] >> np.arange(len(chance)) & 1).astype(float)
    off = np.abs((outcomes - chance) @ np.column_stack([size, np.ones(len(size))]))
    return outcomes[np.argmin(off[:, 0] + 0.1 * size.mean() * off[:, 1])]


def mix(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix, with all columns of docs: a document stands there as often as it is taken.

    Rows without words stay out, as they add nothing.
    """
    key = lambda *c: F.concat_ws("-", F.xxhash64(*c), F.xxhash64(*c, F.lit(1)))
    taken = plan(docs, text, source).where("size > 0")
    # Repeated rows are alike: of n with c copies in all, the first c - n * least have one more than the least.
    taken = taken.groupBy(key("doc_id", "h", "source").alias("_rv_key")).agg(F.min("copies").alias("_rv_least"), F.sum("copies").alias("_rv_sum"), F.count("*").alias("_rv_rows"))
    taken = stored(taken.where("_rv_sum > 0"), "taken")
    rows = docs.withColumn("_rv_key", key(F.col("doc_id").cast("long"), F.xxhash64(text), F.col(source).cast("string")))
    found = lookup(rows, taken, "_rv_key", "_rv_rows").where("_rv_rows is not null")
    same = Window.partitionBy("_rv_key")
    few = found.where(F.col("_rv_rows") <= BLOCK).withColumn("_rv_place", F.row_number().over(same.orderBy(F.lit(1))))
    if not taken.where(F.col("_rv_rows") > BLOCK).isEmpty():
        few = few.unionByName(_places(stored(found.where(F.col("_rv_rows") > BLOCK).withColumn("_rv_task", F.spark_partition_id()), "repeated")))
    more = F.col("_rv_place") <= F.col("_rv_sum") - F.col("_rv_rows") * F.col("_rv_least")
    copies = (F.col("_rv_least") + more.cast("int")).cast("int")
    return few.withColumn("_rv_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def _places(rows: DataFrame) -> DataFrame:
    """rows (stored) with `_rv_place`, their number from 1 among those of their key: by task, then in each task."""
    own = rows.groupBy("_rv_key", "_rv_task").agg(F.count("*").alias("n"))  # a row per key and task
    earlier = Window.partitionBy("_rv_key").orderBy("_rv_task").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_rv_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    here = F.row_number().over(Window.partitionBy("_rv_key", "_rv_task").orderBy(F.lit(1)))
    return rows.withColumn("_rv_place", here).join(own, ["_rv_key", "_rv_task"]).withColumn("_rv_place", F.col("_rv_place") + F.col("_rv_before")).drop("_rv_task", "_rv_before")
