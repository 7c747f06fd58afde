"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents; each works
on every row its predecessor kept. Stages that hand texts to Python keep the session's Arrow batches
small. What happens to nulls, empty texts, repeated rows and empty
tables is said in the operators' modules; all of them pass through every stage without failing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordvol.llm import exact_dedup, language_id, mixing, packing, simhash
from recordvol.llm._common import small_batches, stored
from recordvol.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; what is rejected goes."""
    small_batches(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity 0.8 or more of five-word shingles, that of the smallest doc_id."""
    small_batches(spark)
    return simhash.deduplicate_similar(docs, words=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids and places in sequences of 2048."""
    small_batches(spark)
    return packing.pack_sequences(docs, tokenizer_file("word_bpe_49k.json"), "dropped", end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Models, connected components and tokenizers are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
