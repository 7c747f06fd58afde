"""Token ids on storage: frequency-ranked, in byte-aligned variable-length coding.

The id that occurs most in the corpus gets rank 0, and so on; a rank takes one to four bytes. The
lengths of four ranks share one control byte, kept apart from the data bytes, so both coding and
decoding are table lookups on whole numpy arrays.

Format. A file set is a folder with `vocabulary` (rank, id, count) and `shards`, Parquet files of
blocks. A block has whole documents in ascending doc_id order: shard (its place in the order of
shards), start (ids of its shard before it), doc_ids, lengths, control and data. Spark's writer
commits whole files, so a lost executor leaves no half-written shard.

Texts are put in order first and encoded once into plain blocks, whose tasks also count their ids;
coding by rank then works on the plain blocks.

Defined results: null and empty texts are the end id alone; repeated doc_ids follow each other in
the order of their texts' hashes, null doc_ids come first; an empty table gives an empty file set;
other columns are ignored. One document's ids must fit into one Spark row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordvol.llm._common import new_path, shared_dir, slices, spread
from recordvol.llm.tokenization import TEXT_BYTES, encoder, pack

BLOCKS = "shard int, start long, doc_ids array<long>, lengths array<int>, control binary, data binary"
_HEAD = [("shard", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))]
_ARROW = pa.schema([*_HEAD, ("control", pa.binary()), ("data", pa.binary())])
#: Blocks before ranking: ids as they are, and in a task's last row how often each occurs.
PLAIN = "shard int, start long, doc_ids array<long>, lengths array<int>, ids binary, counts binary"
_PLAIN = pa.schema([*_HEAD, ("ids", pa.binary()), ("counts", pa.binary())])
#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 18
#: For each control byte the byte lengths of its four values; for each length the bits that count.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def code(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    extra = (values > 0xFF).view(np.uint8) + (values > 0xFFFF).view(np.uint8) + (values > 0xFFFFFF).view(np.uint8)
    quads = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    quads[: len(values)] = extra
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that code() got."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.zeros(n, dtype=np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    words = np.lib.stride_tricks.as_strided(raw, (len(data), 4), (1, 1)) if len(data) else raw[:0].reshape(0, 4)
    values = words[at].reshape(-1).view("<u4") if n else np.zeros(0, "<u4")
    return values & MASKS[lengths]


def _row(schema: pa.Schema, *values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema)], schema=schema)


def _plain_blocks(shard: int, docs: Iterator[tuple[int | None, bytes]], vocabulary: int) -> Iterator[pa.RecordBatch]:
    narrow = "<u2" if vocabulary <= 1 << 16 else "<u4"
    total = np.zeros(vocabulary, dtype="<i8")
    start, doc_ids, parts, size = 0, [], [], 0

    def full() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(parts), "<u4")
        np.add(total, np.bincount(ids, minlength=vocabulary), out=total)
        return _row(_PLAIN, shard, start, doc_ids, [len(p) // 4 for p in parts], ids.astype(narrow).tobytes(), None)

    for doc_id, ids in docs:
        if size and size + len(ids) // 4 > BLOCK_IDS:
            yield full()
            start, doc_ids, parts, size = start + size, [], [], 0
        doc_ids.append(doc_id)
        parts.append(ids)
        size += len(ids) // 4
    if doc_ids:
        yield full()
        yield _row(_PLAIN, shard, start + size, [], [], b"", total.tobytes())


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.slice(i, 1).to_pylist()[0]
            yield block, decode(block["control"], block["data"], sum(block["lengths"]))


def write_tokens(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, vocabulary: int, text: str = "text", path: str | None = None) -> str:
    """Encode docs and write a file set; returns its folder (a new one in the shared folder by default).

    `vocabulary` is the number of ids the tokenizer and end_id may give: the bound of what is
    counted, broadcast and kept as the rank table (four bytes each).
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/recordvol/tokens-{uuid.uuid4().hex}"
    end = pack([end_id])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, spaces)

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for part in slices(batch, 1, TEXT_BYTES):
                    yield from zip(part.column(0).to_pylist(), (x + end for x in enc.encode(part.column(1))))

        yield from _plain_blocks(TaskContext.get().partitionId(), rows(), vocabulary)

    # Repeated rows differ in their place only, so that they can be dealt out as well.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange(spread(docs), "doc_id", "h", "place").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    plain = new_path(spark, "plain-tokens")
    rows.mapInArrow(encoded, PLAIN).write.option("compression", "zstd").parquet(plain)
    blocks = spark.read.schema(PLAIN).parquet(plain)

    counted = _counts(blocks, vocabulary)
    counted.write.parquet(f"{path}/vocabulary")
    ids = [r["id"] for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()]  # at most `vocabulary`
    ranks = np.zeros(vocabulary, dtype="<u4")
    ranks[ids] = np.arange(len(ids), dtype="<u4")
    shared = spark.sparkContext.broadcast(ranks.tobytes())

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, "<u4")
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(block["ids"], "<u2" if vocabulary <= 1 << 16 else "<u4")
                yield _row(_ARROW, *(block[f] for f, _ in _HEAD), *code(table[ids]))

    blocks.where("counts is null").drop("counts").mapInArrow(ranked, BLOCKS).write.option("compression", "zstd").parquet(f"{path}/shards")
    return path


def _counts(blocks: DataFrame, vocabulary: int) -> DataFrame:
    """rank, id and count of every id that occurs; at most `vocabulary` rows."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype="<i8")
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_py(), "<i8")
        (ids,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["id", "n"])

    counted = blocks.where("counts is not null").select("counts")
    sums = counted.mapInArrow(seen, "id long, n long").groupBy("id").agg(F.sum("n").alias("count"))
    place = Window.orderBy(F.desc("count"), "id")  # over the vocabulary, not over the corpus
    return sums.select((F.row_number().over(place) - 1).alias("rank"), "id", "count")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from a file set: doc_id, start, n_tokens, ids (little-endian uint32)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/shards")
    ids = [r["id"] for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()]  # the vocabulary
    shared = spark.sparkContext.broadcast(np.array(ids, dtype="<u4").tobytes())

    sizes = blocks.groupBy("shard").agg(F.max(F.expr("start + aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n")).collect()  # a row per shard
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["shard"]):
        before[r["shard"]] = at
        at += r["n"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, "<u4")
        for block, values in _values(batches):
            raw, lengths = table[values].tobytes(), np.array(block["lengths"], dtype=np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            cut = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
            columns = [pa.array(block["doc_ids"], pa.int64()), pa.array(starts + (before[block["shard"]] + block["start"])), pa.array(lengths), pa.array(cut, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
