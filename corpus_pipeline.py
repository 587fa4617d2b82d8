"""The training-data pipeline over ``documents``: toxic documents go, repeated lines go, of near copies one stays,
documents that leak the benchmark go, and the rest is mixed to source weights.

Each stage takes (spark, docs, sf_dir) and gives a table that is written before the next one reads it. All but the
last return the columns they were given; ``n_chars`` follows the text. Missing ids, texts and sources, empty
tables, repeated rows and extra columns are handled as the operators' docstrings say; a document without an id is
never taken for a copy of another one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontamination, jaccard_join, line_dedup, mixing, toxicity
from plumbline.llm.common import NO_ID, table, whole, written
from plumbline.session import broadcast_if_small


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines found in many of them."""
    own = [c for c in ("n_lines", "n_dropped") if c in docs.columns]
    out = line_dedup.line_dedup(docs.withColumnsRenamed({c: f"__own_{c}" for c in own}))
    out = out.drop("n_lines", "n_dropped").withColumnsRenamed({f"__own_{c}": c for c in own})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, and all documents without links or id.

    Rows without an id are nodes of their own by their text (63 bits of its hash under the sign bit), so that they
    link what they are like and nothing else."""
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(whole()).bitwiseOR(F.lit(NO_ID)))
    no_id = broadcast_if_small(written(docs.where(F.col("doc_id").cast("long").isNull()).select(own.alias("doc_id")).distinct(), "without-id"))
    found = written(jaccard_join.jaccard_components(docs.select(own.alias("doc_id"), "text")), "linked").join(no_id, "doc_id", "left_anti")
    # Where a row without an id is the smallest of its group, the smallest known id takes its place.
    heads = found.join(no_id.withColumnRenamed("doc_id", "component_id"), "component_id", "left_semi").groupBy("component_id").agg(F.min("doc_id").alias("head"))
    found = found.join(broadcast_if_small(written(heads, "heads")), "component_id", "left")
    gone = written(found.where(F.col("doc_id") != F.coalesce("head", "component_id")).select("doc_id").distinct(), "near-copies")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.taken_by_document(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
]

#: The first stage is a trained model; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
