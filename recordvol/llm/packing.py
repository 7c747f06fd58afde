"""Harmonic packing of token ids into sequences, with hardly any padding and without a shuffle.

A document is cut into whole sequences first; of the rest, the largest reciprocal of the capacity
that fits is cut off again and again: a piece of class k has floor(capacity / k) ids. A bin of class
k holds exactly k pieces, so a bin that is filled has fewer than k ids of padding. A rest that is
nearly such a piece (SLACK) stays whole. Each task fills bins of its own. The pieces of the bins that
are open at a task's end follow each other through whole sequences, cut where one ends, and the last
ids through sequences whose lengths are powers of two, which need no padding.

A task keeps the open bins only: fewer than `capacity` ids a class, of which there are fewer than
2 * sqrt(capacity) (89 at 2048), whatever its input holds.

Defined results: null and empty texts are the end id alone; repeated rows are packed each for
itself; a null doc_id is passed on; very long texts become many whole sequences; an empty table
gives no rows; other columns are ignored. The capacity must be a power of two.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordvol.llm._common import slices
from recordvol.llm.tokenization import PieceEncoder, encoder, pack

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
#: Rows of an output batch.
BATCH = 2000
#: Bytes of text encoded at once. What a task holds beyond its input is a multiple of it.
TEXT_BYTES = 1 << 20


#: A rest that lacks at most 1/SLACK of a class's share of the capacity is put there uncut.
SLACK = 64


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Lengths and classes of the pieces of a document of n ids."""
    found, rest = [(capacity, 1)] * (n // capacity), n % capacity
    while rest:
        k = capacity // rest  # as many such rests fit
        if capacity - k * rest > capacity // SLACK:
            k += 1  # a piece of the next class is shorter than the rest
        length = min(rest, capacity // k)
        found.append((length, k))
        rest -= length
    return found


class Bins:
    """The open bins of one task, one for each reciprocal class."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        """Rows of all bins that this document fills."""
        total, start = len(ids) // 4, 0
        for length, k in cuts(total, self.capacity):
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total))
            start += length
            if len(bin_) == k:
                yield from self._close(self.open.pop(k))

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for p in pieces:
            yield (*p, self.next_id, offset)
            offset += p[2]
        self.next_id += 1

    def rest(self) -> Iterator[tuple]:
        """Rows of the pieces in bins that stayed open: whole sequences, then lengths that are powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]][::-1]
        left = sum(p[2] for p in pieces)
        self.open.clear()
        while left:
            room = min(self.capacity, 1 << left.bit_length() - 1)
            left -= room
            taken = []
            while room:
                doc_id, start, length, ids, total = pieces.pop()
                part = min(length, room)
                taken.append((doc_id, start, part, ids[: 4 * part], total))
                if part < length:
                    pieces.append((doc_id, start + part, length - part, ids[4 * part :], total))
                room -= part
            yield from self._close(taken)


def encoded(batches: Iterable[pa.RecordBatch], enc: PieceEncoder) -> Iterator[tuple[int | None, bytes]]:
    """doc_id and ids of each row of batches of doc_id and text."""
    for batch in batches:
        for part in slices(batch, 1, TEXT_BYTES):
            yield from zip(part.column(0).to_pylist(), enc.encode(part.column(1)))


def pack_sequences(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, capacity: int = 2048, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    `tokenizer` is a file of the tokenizers library that every executor has; `spaces` as in
    PieceEncoder. sequence_id is unique over all tasks: the task's number in the upper 24 bits.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = pack([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, enc, out = Bins(capacity, TaskContext.get().partitionId() << 39), encoder(tokenizer, spaces), []
        for doc_id, ids in encoded(batches, enc):
            out.extend(bins.add(doc_id, ids + end))
            while len(out) >= BATCH:
                yield _batch(out[:BATCH])
                out = out[BATCH:]
        out.extend(bins.rest())
        if out:
            yield _batch(out)

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
