"""A corpus pipeline: toxic documents go, then exact and near copies, sources are mixed, texts encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs; all but the last return the columns of documents. Null texts are
empty; an empty table passes through every stage; further columns stay until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact, mixing, neardup, pieces, toxicity
from quarry.llm.common import batched, drop_scratch, scratch_path, scratch_scope, text_bytes

ORACLE_SQL = None  # the classifier and the seeded mix are beyond SQL; tests hold run() against a brute-force version


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of op 7 rejects (score of at least 0.5) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    names = docs.columns
    # texts of null stay null: the score is made from a copy of the text
    work = batched(docs).select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), text_bytes().alias("text"))
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)), "score double"])
    out = work.mapInArrow(toxicity.scorer(model), schema).filter("score < 0.5")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest doc_id stays."""
    return neardup.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and text as decoded from the ids."""
    out = pieces.encode(docs, back=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("source_mix", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has made besides, and the
    stage before it, is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark, name):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        drop_scratch(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}
