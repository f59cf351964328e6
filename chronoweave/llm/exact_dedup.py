"""Exact dedup with a heavy-hitter split, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import materialize

#: Digests that the frequent-items summary tracks, and those of them that it returns. Both bound the broadcast.
TRACKED, RETURNED = 8192, 1024


def normalized_text(text: Column) -> Column:
    """Null as empty; each run of space and \\x09-\\x0D becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def heavy_hitters(keys: DataFrame, key: str, tracked: int = TRACKED, returned: int = RETURNED) -> DataFrame:
    """At most ``returned`` frequent values of ``key``, from a mergeable Misra-Gries summary of ``tracked`` counters.

    Each task sends one summary of fixed size. A value that makes up more than about 4 / ``tracked`` of the rows is
    among them as long as there are no more than ``returned`` such values.
    """
    top = keys.select(F.expr(f"approx_top_k({key}, {returned}, {tracked})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(key))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Rows with equal normalised texts form a group; its least id stays. Frequent digests are found by a Misra-Gries
    summary, counted exactly (that verifies them), and their winners, at most ``RETURNED`` rows, are broadcast, so rows
    of hot groups never shuffle. The other digests, each a small share of the rows, shuffle as usual.

    Null text counts as empty. Null ids lose to any other id; where all ids of a group are null, keep_id is null and
    each row is kept. Rows that repeat the kept id with the same text are that same document and are all kept. Other
    columns of ``docs``, whatever their names, are not read. Texts are hashed whole, whatever their length; only digests
    move. An empty table gives no rows.
    """
    keyed = materialize(docs.select(F.col(id_col).alias("doc_id"), F.sha2(normalized_text(F.col(text_col)), 256).alias("text_sha256")), "digests")
    frequent = heavy_hitters(keyed, "text_sha256")
    winners = (
        keyed.join(F.broadcast(frequent), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.min("doc_id").alias("hot_keep"), F.count("*").alias("hot_size"))
        .where("hot_size > 1")
    )
    marked = keyed.join(F.broadcast(winners), "text_sha256", "left")
    hot = marked.where(F.col("hot_size").isNotNull()).select("doc_id", F.col("hot_keep").alias("keep_id"), F.col("hot_size").alias("group_size"), "text_sha256")
    same = Window.partitionBy("text_sha256")
    cold = (
        marked.where(F.col("hot_size").isNull())
        .select("doc_id", "text_sha256")
        .select("doc_id", F.min("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"), "text_sha256")
    )
    return hot.unionByName(cold).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
