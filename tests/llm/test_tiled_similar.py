"""The pipeline's near-duplicate stage links fingerprints by the tiled comparison, also of texts that share no band."""

from pyspark.sql import functions as F
from tests.llm import cases

from recordvol.llm import simhash


def test_texts_of_near_fingerprints_are_linked_without_a_band(spark):
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"x{i}" for i in range(2000))]
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= simhash.RADIUS < (fps[0] ^ fps[2]).bit_count()
    docs = cases.docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    hashes = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    nodes = spark.createDataFrame([(hashes[i], signed[i], [i]) for i in range(3)], "h long, fp long, bands array<long>")
    roots = {r["node"]: r["root"] for r in simhash.similar_roots(docs, nodes).collect()}
    assert roots[hashes[0]] == roots[hashes[1]] and hashes[2] not in roots
