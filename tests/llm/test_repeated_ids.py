"""Learning and joining by identifiers that very many rows share."""

from pyspark.sql import functions as F

from recordvol.llm import quality, toxicity
from recordvol.llm._common import stored

SF = "/root/testdata/sf0.001"


def test_frequent_identifiers_meet_their_page(spark):
    rows = [(7, f"text {i}", "en", "a") for i in range(2500)] + [(8, "other", "en", "b"), (None, "none", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(7, "http://a.example.net/x?y"), (8, "http://b.example.org/")], "page_id long, url string")
    found = quality.features(docs, pages).collect()
    assert len(found) == len(rows) and len({tuple(r["b"]) for r in found if r["doc_id"] == 7}) == 1
    few = {r["doc_id"]: list(r["b"]) for r in quality.features(docs.where("doc_id is null or text in ('text 3', 'other')"), pages).collect()}
    assert all(list(r["b"]) == few[r["doc_id"]] for r in found)


def test_what_is_learned_does_not_depend_on_the_order_of_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    again = docs.join(toxic, "doc_id").withColumn("text", F.concat(F.reverse("text"), F.lit(" again")))  # other texts under the same identifiers
    both = stored(docs.select("doc_id", "text").unionByName(again.select("doc_id", "text")), "both")
    models = [toxicity.fit(both.repartition(n), labels) for n in (2, 5)]
    assert models[0].places.tolist() == models[1].places.tolist() and abs(models[0].slope - models[1].slope) < 1e-6
