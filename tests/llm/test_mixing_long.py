"""Sources with a few very long documents keep to their targets next to a source of many blocks."""

import random

import pytest
from tests.llm import cases

from recordvol.llm import mixing


def test_one_block_source_lands_next_to_many_blocks(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 20), "en", "a") for i in range(2000)]
    rows += [(10_000 + i, "w " * rng.randint(1, 20), "en", "b") for i in range(150)]
    rows += [(20_000 + i, "w " * rng.randint(2000, 4000), "en", s) for i, s in enumerate("abb" * 3)]
    found = mixing.plan(cases.docs(spark, rows), block=256).collect()
    assert len(found) == len(rows) and {r["doc_id"] for r in found} == {r[0] for r in rows}
    for s in "ab":
        own = [r for r in found if r["source"] == s]
        assert sum(r["size"] * r["copies"] for r in own) == pytest.approx(own[0]["target"], abs=20)
