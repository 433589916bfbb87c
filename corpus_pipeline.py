"""From raw documents to placed training text: toxicity, near duplicates, benchmark leaks, mixing, sharding."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespark.llm import decontamination, mixing, sharding, shingle_sets, simhash, toxicity
from notespark.llm.common import table
from notespark.llm.components import components
from notespark.session import ensure_checkpoint_dir


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't call toxic. The model learns from the labels of these documents."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id.

    Linked are documents whose SimHash fingerprints differ in 4 bits or fewer (operator 6), and those whose five-word
    shingles are alike to 0.8 or more, compared in full; groups go over links of both kinds. An id that some row of its
    own represents isn't linked, so of rows that share an id no text is lost. Rows with a null id stay.
    """
    key, at = F.col("doc_id"), F.col("component_id")
    linked = [
        method.near_duplicates(docs).groupBy(key.alias("a")).agg(F.min(at).alias("b"), F.max(at == key).alias("own")).where("not own")
        for method in (simhash, shingle_sets)
    ]
    grouped = components(linked[0].unionByName(linked[1]).select("a", "b"))
    others = grouped.where("node <> component").select(F.col("node").alias("doc_id"))
    known = docs.where(key.isNotNull()).join(others, "doc_id", "left_anti").select(*docs.columns)
    return known.dropDuplicates(["doc_id", "text"]).unionByName(docs.where(key.isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws, as documents: one for each time that words of a document are drawn."""
    return mixing.Mix(docs).documents()


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return sharding.assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# Learned models, fingerprint components and permutations can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over what the one before kept. Results between stages go to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
