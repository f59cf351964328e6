"""What several training-data operators share: the shared folder, word hashing, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch to a Python worker: texts can be long, so batches stay small.
ARROW_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a batch of very long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def bounded_batches(spark: SparkSession, size: str = "16m") -> None:
    """Arrow batches to Python workers that end at ``size`` bytes, whatever the length of their texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    small_batches(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local master gets a temporary folder; any other master is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in whatever case."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name in taken:
        name += "_"
    return name


def doc_bucket(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % parts


def row_text(doc_id: Column, text: Column) -> Column:
    """Id and text of a row as one string that no other pair gives: the id's length stands before it."""
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.concat(F.when(doc_id.isNull(), F.lit("-")).otherwise(F.length(own).cast("string")), F.lit(":"), own, F.coalesce(text, F.lit("")))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at runs of space and \\x09-\\x0D (what ``bytes`` methods do)."""
    return text.lower().split() if text else []


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BYTE = np.random.Generator(np.random.PCG64(20240909)).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes of a text that are hashed at a time.
_PART = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def hash_words(text: bytes | None) -> np.ndarray:
    """A 64-bit hash for each word of ``words_of(text)``, in order, without making the words.

    Sums of byte values times powers of a base, as prefix sums over the text: a word's hash is a difference of two of
    them, shifted to the word's start. Long texts are hashed in parts of fixed length; the sum of a word that a part cuts
    is carried on, so one unbroken run of any length needs no more memory than a part.
    """
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.lower(), np.uint8)
    up, down = _power_tables(min(len(raw), _PART) + 1)
    out, carried, length = [], 0, 0
    for at in range(0, len(raw), _PART):
        part = raw[at : at + _PART]
        gap = np.ones(len(part) + 2, np.int8)
        gap[1:-1] = _SPACE[part]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        start, stop = edges[0::2], edges[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        sums, sizes = (total[stop] - total[start]) * down[start], (stop - start).astype(np.uint64)
        if length and gap[1]:
            out.append(mix64(np.array([carried], np.uint64) + np.uint64(length)))
        elif length:
            sums[0] = np.uint64((carried + int(sums[0]) * pow(_BASE, length, 2**64)) % 2**64)
            sizes[0] += np.uint64(length)
        carried = length = 0
        if len(stop) and stop[-1] == len(part) and at + len(part) < len(raw):
            carried, length = int(sums[-1]), int(sizes[-1])
            sums, sizes = sums[:-1], sizes[:-1]
        out.append(mix64(sums + sizes))
    return np.concatenate(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words in order; fewer words give one hash, none gives none."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(size, n)
    out = word_hashes[: n - width + 1].copy()
    for i in range(1, width):
        out = out * _STEP + word_hashes[i : n - width + 1 + i]
    return mix64(out + np.uint64(width))


#: Edges that one task contracts at most.
LOCAL_EDGES = 400_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's edges: each id with the least id that it reaches here."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    rows = [(find(x), x) for x in list(parent)]
    rows = [(a, b) for a, b in rows if a != b]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 60, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for each id in ``edges`` (columns a, b), component being the least id reachable.

    Each round first contracts the edges of each partition, at most about ``local_edges`` of them, to stars; edges that
    fit one partition are then done. More go on with alternating large-star and small-star contraction: two grouped minima
    and two joins a round, linear in the edges, in a logarithmic number of rounds. No component is ever gathered.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.where("a <> b").distinct()

    def settled(e: DataFrame) -> bool:
        """Whether all edges lead from a least id to one that has no other edge."""
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("v").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 or (up = 1 and down > 0)").isEmpty()

    current = materialize(edges.select("a", "b").where("a <> b"), "edges")
    for _ in range(max_rounds):
        parts = -(-current.count() // local_edges)
        if parts == 0:
            break
        current = materialize(current.repartition(parts).mapInArrow(_contract, "a bigint, b bigint"), "edges")
        if parts == 1 or settled(current):
            break
        current = materialize(star(star(current, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(current.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
