"""What the language models reject and keep."""

import random

import numpy as np
from pyspark.sql import functions as F

from recordvol.llm import language_id

SF = "/root/testdata/sf0.001"


def test_unlearned_latin_language_and_random_letters_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = docs.where("lang <> 'fr'")
    model = language_id.fit(learned)
    found = language_id.identify(docs, model).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 200").collect()
    assert np.mean([r["accepted"] for r in found if r["lang"] == "fr"]) < 0.2
    assert np.mean([r["accepted"] for r in found if r["lang"] != "fr" and r["held_out"]]) > 0.97
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60))) for i in range(20)]
    odd = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert odd.where(F.col("accepted")).count() == 0


def test_one_very_long_document_does_not_displace_the_others(spark):
    rows = [(i, "xy", f"some words of number {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    first = docs.orderBy(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40))).first()["doc_id"]
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("long "), 5000)).otherwise(F.col("text")))
    found = language_id._sampled(docs, {"xy": 300}, "text", "lang", 1200, 20_000)
    assert found.count() == 300


def test_words_of_a_long_document_come_from_all_over_it(spark):
    text = "".join(f"w{i} " for i in range(40_000))
    docs = spark.createDataFrame([(None, "xy", text), (None, "xy", "a short one"), (None, "xy", "another short one")], "doc_id long, lang string, text string")
    drawn = {len(r["text"]) > 100: r["text"] for r in language_id._sampled(docs, {"xy": 3}, "text", "lang", 1200, 400_000).collect()}
    places = [int(w[1:]) for w in drawn[True].split()]
    assert 8_000 < len(drawn[True]) < 12_000 and places == sorted(set(places))
    assert all(sum(1000 * k <= p < 1000 * (k + 1) for p in places) > 10 for k in range(40))
