"""What a packing task encodes at once does not grow with its Arrow batches."""

import pyarrow as pa

from recordvol.llm import packing


class Seen:
    def __init__(self):
        self.bytes = []

    def encode(self, texts):
        self.bytes.append(sum(len(t) for t in texts.to_pylist()))
        return [t.encode() for t in texts.to_pylist()]


def test_texts_are_encoded_a_megabyte_at_a_time():
    texts, seen = [str(i) * 1000 for i in range(4000)], Seen()
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], names=["doc_id", "text"])
    assert list(packing.encoded([batch], seen)) == [(i, t.encode()) for i, t in enumerate(texts)]
    assert sum(seen.bytes) > 10 << 20 and max(seen.bytes) <= 1 << 20
