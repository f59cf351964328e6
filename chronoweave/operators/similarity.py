"""Similarity joins and searches: Hamming radius, sampled-bit buckets, nearest vectors, votes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.vectors import hamming
from chronoweave.operators.coarse import coarse_hits, cosine_scores

#: Ids of queries and of rows in one cell of a search.
BLOCK = 32_768


def hamming_pairs(df: DataFrame, hash_col: str, radius: int, bits: int = 60, agree: int = 3) -> DataFrame:
    """(a, b, distance): different hash values at most ``radius`` bits apart, a < b; members of one value are not paired.

    Of ``radius`` + ``agree`` bands of bits, values within the radius agree in ``agree`` at least, so the join on (which
    bands, their bits) finds all of them. A key has half of all bits or so: with radius 3, 30 of 60, so unrelated values
    hardly meet. Values are made distinct first: copies never multiply.
    """
    values = df.select(F.col(hash_col).alias("h")).where("h is not null").distinct()
    n = radius + agree
    edges = [round(i * bits / n) for i in range(n + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in some) for some in combinations(range(n), agree)]
    keys = F.array(*[F.struct(F.lit(i).alias("bands"), F.col("h").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    keyed = values.select("h", F.explode(keys).alias("s")).select("h", "s.bands", "s.bits")
    pairs = keyed.alias("x").join(keyed.alias("y"), ["bands", "bits"]).where("x.h < y.h")
    found = pairs.select(F.col("x.h").alias("a"), F.col("y.h").alias("b"), hamming(F.col("x.h"), F.col("y.h")).alias("distance"))
    return found.where(F.col("distance") <= radius).distinct()


def sampled_masks(tables: int, bits: int, width: int = 60, seed: int = 42) -> list[list[int]]:
    """Bit places of each table, sampled without replacement."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return [sorted(int(x) for x in rng.choice(width, bits, replace=False)) for _ in range(tables)]


def bucket_pairs(queries: DataFrame, rows: DataFrame, radius: int, masks: list[list[int]], q: str = "query", r: str = "row") -> DataFrame:
    """(query, row, distance) of hashes that share a bucket in one table and lie within ``radius``."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("h").bitwiseAND(F.lit(sum(1 << b for b in m))).alias("k")) for i, m in enumerate(masks)])
    keyed = lambda df, name: df.select(name, "h", F.explode(tables).alias("s")).select(F.col(name), F.col("h").alias(f"h_{name}"), "s.t", "s.k")
    pairs = keyed(queries, q).join(keyed(rows, r), ["t", "k"]).select(q, r, hamming(F.col(f"h_{q}"), F.col(f"h_{r}")).alias("distance"))
    return pairs.where(F.col("distance") <= radius).distinct()


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_id: str, row_id: str, vector: str = "embedding", same: bool = False, block: int = BLOCK, missing: bool = False) -> DataFrame:
    """(query, row, similarity, rank): the ``k`` rows of highest inner product for each query; ties go to the lower row id.

    Queries and rows meet in cells of ``block`` ids on either side: one pass, and nothing goes through the driver. A cell
    keeps its best rows for each query, so the final ranking sees a few rows for each query and block. ``same``: whether
    a row with the query's own id counts; if not, nor does one without an id. ``missing``: whether queries and rows
    without a vector count, with a similarity of null that ranks last.
    """
    side = lambda df, own: df.select(F.lit(0).alias("all"), F.col(own).cast("long").alias("id"), F.lit(0).cast("long").alias("hash"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    q, r = side(queries, query_id), side(rows, row_id)
    q, r = (q, r) if same else (q.where("id is not null"), r.where("id is not null"))
    q = q.withColumnRenamed("id", "query").withColumn("q_time", F.col("query").cast("double"))
    hits = coarse_hits(q, r.withColumnRenamed("id", "time"), "all", k, cosine_scores, block=float(block), others=not same, missing=missing)
    hits = hits.select("query", F.col("time").alias("row"), F.col("coarse").alias("similarity"))
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("similarity"), "row")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bucket_vote(hits: DataFrame, query_group: str, offset: str, hit_time: str, similarity: str, step: float) -> DataFrame:
    """(group, bucket, support, mean_similarity): each hit votes for the start it implies, rounded to ``step``."""
    bucket = F.round((F.col(hit_time) - F.col(offset)) / step) * step
    return hits.groupBy(query_group, bucket.alias("bucket")).agg(F.count("*").alias("support"), F.avg(similarity).alias("mean_similarity"))
