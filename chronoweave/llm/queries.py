"""One query for each training-data operator, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import langid, oracles, quality, toxicity
from chronoweave.llm.common import doc_bucket
from chronoweave.llm.decontaminate import contamination
from chronoweave.llm.exact_dedup import exact_dedup
from chronoweave.llm.hard_negatives import hard_negatives, prepared
from chronoweave.llm.lexical_search import lexical_search
from chronoweave.llm.line_dedup import line_dedup
from chronoweave.llm.near_dedup import near_duplicates
from chronoweave.llm.packing import best_fit_packing
from chronoweave.llm.pieces import decode, encode
from chronoweave.llm.secret_scan import secret_scan
from chronoweave.llm.token_counts import token_counts

#: The vocabulary file that token counts and packing use unless told otherwise.
TOKENIZER = "byte_bpe_50k.json"
#: The model file of the piece encoder, likewise.
PIECES = "piece_bpe_32k.model"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(parts: int, remainder: int):
    """Whether crc32(doc_id) modulo ``parts`` is ``remainder``; null ids are not held out."""
    return F.coalesce(doc_bucket("doc_id", parts) == remainder, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    weights = toxicity.train(docs, _read(spark, sf_dir, "labels"), doc_bucket("doc_id", 5) != 0)
    return toxicity.score(docs, weights).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the cleaned text's digest stand for the cleaned text."""
    out = line_dedup(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    weights = quality.train(docs, _read(spark, sf_dir, "labels"), doc_bucket("doc_id", 5) != 0)
    return quality.score(docs, weights).select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_read(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs, doc_bucket("doc_id", 4) != 2)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(prepared(_read(spark, sf_dir, "embeddings"), label=label), F.col("vec_id") % 100 == 0)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests stand for the ids and for the text that they decode to."""
    path = public_tokenizers.path(PIECES)
    rows = decode(encode(_read(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_token_counts": op2_token_counts,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_near_dedup": op4_near_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality": op7_quality,
        "op8_secret_scan": op8_secret_scan,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_language_id": op10_language_id,
        "op11_lexical_search": op11_lexical_search,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_pieces": op13_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
