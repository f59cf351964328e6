"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import langid
from chronoweave.llm.common import doc_bucket, materialize, unused_name
from chronoweave.llm.decontaminate import decontaminate
from chronoweave.llm.line_dedup import line_dedup
from chronoweave.llm.near_dedup import near_duplicates
from chronoweave.llm.packing import best_fit_packing
from chronoweave.llm.queries import TOKENIZER


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification does not reject, as they are. The model learns from this stage's documents."""
    model = langid.train(docs, doc_bucket("doc_id", 4) != 2)
    return langid.identify(docs, model).where("not rejected").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without chunks and passages of lines that stand earlier elsewhere; n_chars follows the text. Those of which nothing is left go."""
    out = line_dedup(docs)
    cleaned = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out
    return cleaned.where("n_removed = 0 or text <> ''").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, at a similarity of 0.8 of five-word shingles: the one with the least id.

    Rows are told apart by id and text, so of rows that repeat an id, those whose text is a copy go.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    own = unused_name(docs, "key")
    tagged = docs.withColumn(own, key)
    kept = near_duplicates(tagged, percent=80, id_col=own).where("kept").select(F.col("doc_id").alias("kept_key")).distinct()
    return tagged.join(kept, tagged[own].eqNullSafe(kept["kept_key"]), "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 1024 tokens."""
    return best_fit_packing(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language identification and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
