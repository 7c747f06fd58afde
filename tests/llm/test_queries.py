"""The registered queries over their whole tables, row by row against plain Python where it can say what is right."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import cases
from tokenizers import Tokenizer

from recordvol.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def ids_of(name, end):
    t = Tokenizer.from_file(queries.tokenizer_file(name))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def test_every_operator_has_a_query():
    assert sorted(queries.queries()) == sorted(["op1_language_id", "op2_token_output", "op3_toxicity", "op4_url_filter", "op5_quality", "op6_ann", "op7_exact_dedup", "op8_simhash", "op9_packing", "op10_mixing", "op11_lm_scoring", "op12_hard_negatives", "op13_conversation_repair"])


@pytest.mark.parametrize("name", ["op1_language_id", "op3_toxicity", "op5_quality"])
def test_scores(spark, rows, name):
    found = queries.queries()[name](spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == [r["doc_id"] for r in rows]
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    if name == "op1_language_id":
        assert {r["lang_pred"] for r in found} <= {r["lang"] for r in rows} | {"und"}
    else:
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found)


def test_token_output(spark, rows):
    encode, start = ids_of("byte_bpe_50k.json", 2), 0
    found = {r["doc_id"]: r for r in queries.op2_token_output(spark, SF).collect()}
    for r in rows:
        ids, got = encode(r["text"]), found.pop(r["doc_id"])
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not found


def test_neighbours(spark):
    table = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None]
    table = [(i, x) for i, x in table if i is not None and np.isfinite(x).all() and x.any()]
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table])
    x /= np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for r in queries.op6_ann(spark, SF).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {int(i) for i in ids if i % 50 == 0}
    for q, near in found.items():
        cos = np.where(ids == q, -2, x @ x[ids == q][0])
        best = np.lexsort((ids, -np.round(cos, 12)))[:5]
        assert [near[k][0] for k in range(1, 6)] == ids[best].tolist() and np.allclose([near[k][1] for k in range(1, 6)], cos[best], atol=1e-12)


def test_simhash(spark, rows):
    prints = [cases.fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{p:016x}", c) for r, p, c in zip(rows, prints, cases.smallest_linked(prints, [r["doc_id"] for r in rows], 2))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, SF).collect()} == want


def test_packing(spark, rows):
    encode = ids_of("word_bpe_49k.json", 1)
    ids = {r["doc_id"]: encode(r["text"]) for r in rows}
    pieces = queries.op9_packing(spark, SF).collect()
    covered, bins = {}, {}
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        covered.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for doc_id, parts in covered.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() and sum(n for _, n in parts) == len(ids[doc_id])
    assert set(covered) == set(ids)
    sizes = []
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
        sizes.append(sum(n for _, n in parts))
    padded = [2048 - n for n in sizes if n & (n - 1)]
    assert max(sizes) <= 2048 and sum(padded) < 0.02 * sum(sizes)


def test_mixing(spark, rows):
    found = queries.op10_mixing(spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == [r["doc_id"] for r in rows]
    by = {}
    for r in found:
        s = by.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
    assert all(abs(taken - target) <= max(0.02 * target, 400) for (_, target), (_, taken) in by.items())


def test_url_filter_and_exact_dedup_count_rows(spark, rows):
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert queries.op4_url_filter(spark, SF).count() == pages
    found = queries.op7_exact_dedup(spark, SF)
    assert found.count() == len(rows) and found.where("kept").count() == len({cases.normal(r["text"]) for r in rows})
    assert found.where(F.col("kept") & (F.col("doc_id") != F.col("keep_id"))).count() == 0
