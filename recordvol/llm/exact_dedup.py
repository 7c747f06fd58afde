"""Exact deduplication through a log-structured merge index of text digests.

1. Every text is normalised and digested; (row, doc_id, digest) is the log.
2. Memtables: a batch is split into memtables, each aggregated by digest (inside the tasks first, by
   Spark's partial aggregation) and flushed as a sorted run of (digest, smallest id, rows) with a
   filter of its digests.
3. Compaction merges the runs of a level into one of the next. Digests that no other run's filter
   knows are carried over as they are; only the others are shuffled, and keep the smallest identifier.
   A later batch is flushed beside the runs that are there; FANOUT runs of a level are merged, and a
   lookup probes the filters of runs before it reads them.
4. Hits are digests with more than one row; those of the merged run make a filter of 32 bits a
   digest. Rows are read again, every digest is looked up in the filter, and only rows that pass
   are grouped by digest and whole normalised text, so that a group is one text byte for byte, not
   one digest.

Copies collapse inside each task before every shuffle, so a group with a third of all rows moves
as one row per task. Texts outside the hits stay where they are, but for the one in 32 that the
filter lets pass; its size is bounded (8 MB), so beyond two million hits it lets pass more, up to
all of them: more texts move then, results are the same. DataFrame functions only.

Defined results: null texts count as empty; empty and white-space-only texts are not special
(`""` and `" "` differ, as runs of white space become one space); rows with a null doc_id come
after all others in their group; among repeated rows of the smallest doc_id exactly one is kept, by
`deduplicate` the one with the smallest hash of all its columns;
an empty table gives no rows; other columns of any name are ignored here and kept by `deduplicate`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordvol.llm._common import key_filter, lookup, marked, new_path, passes, stored, whole_row

SPACES = r"[\x20\x09-\x0D]+"
SHAPE = "digest string, first struct<no_id: boolean, doc_id: bigint, row_id: bigint>, n bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


#: Runs of a level that are merged into one of the next.
FANOUT = 4


@dataclass(frozen=True)
class Run:
    """A sorted run on storage, the filter of its digests, and its level."""

    path: str
    words: DataFrame
    bits: int
    level: int

    def may_have(self, digest: Column) -> Column:
        return passes(digest, self.words, self.bits)


class DigestIndex:
    """Runs of digests on storage. `digest_bits` shortens digests (tests use it to force collisions), `filter_bits` filters."""

    def __init__(self, spark: SparkSession, digest_bits: int = 256, filter_bits: int | None = None):
        self.spark, self.digest_bits, self.filter_bits = spark, digest_bits, filter_bits
        self.runs: list[Run] = []

    def shortened(self, sha256: Column) -> Column:
        return sha256 if self.digest_bits == 256 else F.substring(sha256, 1, self.digest_bits // 4)

    def flush(self, log: DataFrame, memtables: int = FANOUT) -> None:
        """Aggregate a batch (digest, doc_id, row_id) into `memtables` runs sorted by digest."""
        path = new_path(self.spark, "runs")
        memtable = F.pmod(F.xxhash64("row_id"), F.lit(memtables)).cast("int").alias("run")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
        (
            log.groupBy(memtable, "digest")
            .agg(first, F.count("*").alias("n"))
            .sortWithinPartitions("run", "digest")
            .write.partitionBy("run")
            .parquet(path)
        )
        self.runs += [self._run(f"{path}/run={r}", 0) for r in range(memtables) if self._exists(f"{path}/run={r}")]

    def add(self, log: DataFrame) -> None:
        """Flush a later batch as one run and merge levels that are full."""
        self.flush(log, 1)
        level = 0
        while sum(r.level == level for r in self.runs) >= FANOUT:
            self._merge([r for r in self.runs if r.level == level])
            level += 1

    def compact(self) -> DataFrame:
        """Merge all runs into one, which replaces them: digest, first, n."""
        if len(self.runs) > 1:
            self._merge(list(self.runs))
        return self._read(self.runs[0].path) if self.runs else self.spark.createDataFrame([], SHAPE)

    def known(self, digests: DataFrame) -> DataFrame:
        """Of distinct digests (one column, `digest`, stored) those of earlier batches, with first and n; a run is read for those only that pass its filter."""
        found = None
        for run in self.runs:
            asked = digests.where(run.may_have(F.col("digest")))
            own = self._read(run.path).join(asked, "digest", "left_semi")
            found = own if found is None else found.unionByName(own)
        found = self.spark.createDataFrame([], SHAPE) if found is None else found
        return found.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))

    def _merge(self, runs: list[Run]) -> None:
        shared = alone = None
        for run in runs:
            rows, elsewhere = self._read(run.path), F.lit(False)
            for other in runs:
                if other is not run:
                    elsewhere = elsewhere | other.may_have(F.col("digest"))
            one, other = rows.where(elsewhere), rows.where(~elsewhere)
            shared, alone = (one, other) if shared is None else (shared.unionByName(one), alone.unionByName(other))
        path = new_path(self.spark, "runs")
        merged = shared.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        merged.unionByName(alone).sortWithinPartitions("digest").write.parquet(path)
        self.runs = [r for r in self.runs if r not in runs] + [self._run(path, max(r.level for r in runs) + 1)]

    def _run(self, path: str, level: int) -> Run:
        words, bits = key_filter(self._read(path).select("digest"), self.filter_bits)
        return Run(path, stored(words, "run-filter"), bits, level)

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(SHAPE).parquet(path)


def _log(docs: DataFrame, index: DigestIndex, text: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col(text)), 256).alias("text_sha256"))
    return stored(rows.withColumn("row_id", F.monotonically_increasing_id()), "digests").withColumn("digest", index.shortened(F.col("text_sha256")))


def _possible_hits(docs: DataFrame, index: DigestIndex, merged: DataFrame, text: str) -> DataFrame:
    """Rows of docs with `_rv_text`, `_rv_digest` and whether their digest may have several rows."""
    hits = stored(merged.where("n > 1").select("digest"), "hit-digests")
    rows = docs.withColumn("_rv_text", normalised(F.col(text))).withColumn("_rv_digest", index.shortened(F.sha2("_rv_text", 256)))
    return marked(rows, F.col("_rv_digest"), hits, "_rv_hit")


def groups(docs: DataFrame, text: str = "text", digest_bits: int = 256, runs: int = FANOUT) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    text_sha256 is that of the normalised text in UTF-8.
    """
    index = DigestIndex(docs.sparkSession, digest_bits)
    log = _log(docs, index, text)
    index.flush(log, runs)
    merged = index.compact()

    rows = _possible_hits(docs, index, merged, text).where("_rv_hit")
    verified = rows.groupBy("_rv_digest", "_rv_text").agg(F.count("*").alias("n"))
    verified = stored(verified.groupBy(F.col("_rv_digest").alias("digest")).agg(F.count("*").alias("texts"), F.sum("n").alias("n")), "verified")
    collided = verified.where("texts > 1").select("digest")

    hits = merged.join(verified.where("texts = 1 and n > 1").select("digest"), "digest", "left_semi")
    hits = stored(hits.select("digest", "first", "n"), "hits")
    if collided.isEmpty():
        return _placed(log, hits)
    return _placed(log.join(collided, "digest", "left_anti"), hits).unionByName(_apart(docs, index, collided, text))


def _placed(log: DataFrame, hits: DataFrame) -> DataFrame:
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    found = lookup(log, hits, "digest", "n")
    return found.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("first") == own)).alias("kept"),
        "text_sha256",
    )


def _apart(docs: DataFrame, index: DigestIndex, collided: DataFrame, text: str) -> DataFrame:
    """Where one digest has several texts, its rows are grouped by the whole texts instead."""
    t = normalised(F.col(text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("t")).withColumn("digest", index.shortened(F.sha2("t", 256)))
    rows = stored(rows.join(collided, "digest", "left_semi").drop("digest").withColumn("row_id", F.monotonically_increasing_id()), "collided")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    per_text = rows.groupBy("t").agg(F.min(own).alias("first"), F.count("*").alias("n"))
    return rows.join(per_text, "t").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("first") == own).alias("kept"), F.sha2("t", 256).alias("text_sha256")
    )


def deduplicate(docs: DataFrame, text: str = "text", digest_bits: int = 256, runs: int = FANOUT) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that are surely alone pass by without a shuffle. Of the others, each task first keeps the
    smallest row of each text it holds, and only those are shuffled and compared byte for byte.
    """
    index = DigestIndex(docs.sparkSession, digest_bits)
    index.flush(_log(docs, index, text), runs)
    rows = _possible_hits(docs, index, index.compact(), text)
    same = Window.partitionBy("_rv_digest", "_rv_text").orderBy(F.col("doc_id").asc_nulls_last(), whole_row(docs.columns))
    ranked = rows.where("_rv_hit").withColumn("_rv_rank", F.row_number().over(same)).where("_rv_rank = 1")
    return rows.where("not _rv_hit").select(*docs.columns).unionByName(ranked.select(*docs.columns))
