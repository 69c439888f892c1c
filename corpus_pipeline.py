"""A training corpus from raw documents: five of the operators, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnset.llm import minhash, mixing, packing, secrets, toxicity
from cairnset.llm.common import Scratch, col, free
from cairnset.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labelled rows, doesn't reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), Scratch(spark, "toxicity"))
    return docs.where(toxicity.rated(docs["text"], model)["predicted"] == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and every document without doc_id."""
    near = minhash.near_duplicates(docs, Scratch(spark, "minhash"))
    kept = docs.join(near.where("kept and doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    # rows that share a doc_id are one group; each task first keeps one of its own, and no further exchange is needed
    nth = free("nth", docs.columns)
    kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where(F.col(nth) == 1)
    return kept.select(*map(col, docs.columns)).union(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark."""
    return secrets.redact(docs, Scratch(spark, "secrets"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for."""
    return mixing.mix(docs, Scratch(spark, "mixing"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs, Scratch(spark, "packing"), tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the model nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the table documents; each stage's rows are written and read again."""
    scratch = Scratch(spark, "pipeline")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = scratch.save(stage(spark, rows, sf_dir), name)
    return rows
