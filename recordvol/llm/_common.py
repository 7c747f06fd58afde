"""Helpers that several corpus operators share: shared folder, skew-safe joins, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than total / HEAVY rows is heavy, so there are fewer than HEAVY heavy keys.
HEAVY = 256
#: Most bits of a filter (8 MB).
MOST_BITS = 1 << 26
#: Most bytes of text a Python task turns into Python objects at once.
SLICE_BYTES = 4 << 20
#: Most bytes of an Arrow batch (a row at least) where `small_batches` holds.
BATCH_BYTES = 1 << 20


_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor can reach.

    Where a session names none, one of its own is made only in local mode, as in tests: there all
    tasks share the machine's folders.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"{spark.sparkContext.applicationId} local"
    if own not in _FOLDERS:
        _FOLDERS[own] = tempfile.mkdtemp(prefix="recordvol-")
    return _FOLDERS[own]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, in a folder that goes when the application ends."""
    me = spark.sparkContext.applicationId
    if me not in _FOLDERS:
        _FOLDERS[me] = f"{shared_dir(spark)}/recordvol/{me}"
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS[me])
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return f"{_FOLDERS[me]}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back; cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Python tasks get their rows in batches of about BATCH_BYTES.

    By default a batch has 10,000 rows or 64 MB, and of long texts each task holds several copies of it, outside the heap and in Python.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> int:
    """Number of partitions for a shuffle this module lays out itself."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of rows with groups (one row per key), also where one key holds a third of all rows.

    Keys with more than 1/HEAVY of the rows are fewer than HEAVY, so those are broadcast; all
    other keys go through a shuffle join in which no key is large. `size` is the column of groups
    that counts the rows of its key. Both inputs are read twice: pass stored tables.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    heavy = groups.where(F.col(size) * HEAVY > F.lit(total))
    light = groups.where(F.col(size) * HEAVY <= F.lit(total))
    hot = [r[0] for r in heavy.select(key).collect()]  # fewer than HEAVY
    if not hot:
        return rows.join(light, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return (
        rows.where(is_hot)
        .join(F.broadcast(heavy), key, "left")
        .unionByName(rows.where(~is_hot).join(light, key, "left"))
    )


def followed(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", least: int = 1000) -> DataFrame:
    """Inner or left join of rows with table (one row per key), also where few keys hold most rows.

    Of the HEAVY most frequent keys of rows, which are all that can be heavy, those with `least`
    rows or more are broadcast; rows without a key count as any other. Both inputs are read twice:
    pass stored tables.
    """
    top = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(HEAVY).collect()
    hot = [r[0] for r in top if r["n"] >= least]
    if not hot:
        return rows.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(table.where(F.col(key).isin(hot)))  # HEAVY rows at most
    return rows.where(is_hot).join(few, key, how).unionByName(rows.where(~is_hot).join(table, key, how))


def key_filter(keys: DataFrame, bits: int | None = None) -> tuple[DataFrame, int]:
    """One row (words array<bigint>), the bits of a filter for the keys, and their number; `keys` (stored) has one column.

    By default 32 bits a key and MOST_BITS at most, so its size is bounded whatever the size of keys;
    with more keys it lets more others pass.
    """
    if bits is None:
        bits = min(MOST_BITS, max(1 << 12, 1 << (32 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits))
    words = keys.select((at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bit"))
    every = keys.sparkSession.range(0, bits // 64, 1, 1).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    held = F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bit", F.lit(0).cast("long")).alias("bit")))), lambda x: x["bit"])
    return every.agg(held.alias("words")), bits


def passes(key: Column, words: DataFrame, bits: int) -> Column:
    """Whether a key may be among those of a filter (see `key_filter`); never false for one that is.

    The filter is one row that a scalar subquery hands to the tasks.
    """
    cell = F.pmod(F.xxhash64(key), F.lit(bits))
    return F.getbit(F.get(words.scalar(), (cell / 64).cast("int")), F.pmod(cell, F.lit(64)).cast("int")) == 1


def marked(df: DataFrame, key: Column, keys: DataFrame, column: str, bits: int | None = None) -> DataFrame:
    """Adds a boolean `column`: may `key` be among `keys`? Never false for one that is (see `key_filter`)."""
    return df.withColumn(column, passes(key, *key_filter(keys, bits)))


def whole_row(columns: list[str]) -> Column:
    """A hash of all columns, which settles ties between rows that agree in all that matters."""
    return F.xxhash64(*(F.col(f"`{c}`") for c in columns))


def slices(batch, column: int, most: int = SLICE_BYTES):
    """Cut an Arrow batch so that a slice holds about `most` bytes of a string column (one row at least).

    What Arrow keeps of a slice's memory goes back to the system before the next, as a Python worker outlives its tasks.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at, n = 0, batch.num_rows
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        pa.default_memory_pool().release_unused()
        at = to


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0, the rows no classifier learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
