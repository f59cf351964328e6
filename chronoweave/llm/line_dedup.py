"""Line dedup over content-defined chunks of lines, and over runs of lines of many words."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, md5
from zlib import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from chronoweave.llm.common import materialize, row_text, small_batches, unused_name

#: A boundary falls after one line in DIVISOR on average; chunks of fewer lines or words are left alone.
DIVISOR, MIN_LINES, MIN_WORDS = 3, 2, 10
#: Runs of lines of so many words go wherever boundaries fall.
RUN_WORDS = 50


def line_values(lines: list[bytes]) -> np.ndarray:
    """24 bits of each line's MD5."""
    return np.fromiter((int.from_bytes(md5(line).digest()[:3], "big") for line in lines), dtype=np.int64, count=len(lines))


def chunk_bounds(lines: list[bytes], divisor: int = DIVISOR) -> list[tuple[int, int]]:
    """(first line, end line) of each chunk.

    A rolling hash over the last two line hashes decides whether a chunk ends after a line. As it sees two lines only,
    a passage is cut alike wherever it stands, but for its margins.
    """
    if not lines:
        return []
    v = line_values(lines)
    rolled = v + 31 * np.concatenate([[0], v[:-1]])
    ends = [*(np.flatnonzero(rolled[:-1] % divisor == 0) + 1), len(lines)]
    return list(zip([0, *ends[:-1]], ends, strict=True))


def run_bounds(words: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first line, end line) of the shortest run of at least ``least`` words from each line on, and up to each line; ``words``: words before each line, and in all.

    A run of lines with that many words holds the one from its first line, the one up to its last line, and for each
    line between them one that covers it. What they hold depends on the run alone, so the runs that two texts share
    are just the union of the shortest ones that they share.
    """
    if words[-1] < least:
        return []
    ends = np.searchsorted(words, words[:-1] + least)
    firsts = np.searchsorted(words, words[1:] - least, side="right") - 1
    return sorted({(a, int(b)) for a, b in enumerate(ends) if b < len(words)} | {(int(a), b) for b, a in enumerate(firsts, 1) if a >= 0})


def passages(text: bytes | None, rule: tuple[int, int, int, int]) -> Iterator[tuple[int, int, bytes | None, bytes]]:
    """(first line, end line, bytes, digest) of each chunk that is long enough to be taken out, and of each run, without its bytes."""
    if not text:
        return
    divisor, min_lines, min_words, run_words = rule
    lines = text.split(b"\n")
    words = np.concatenate([[0], np.cumsum([len(line.split()) for line in lines], dtype=np.int64)])
    starts = np.concatenate([[0], np.cumsum([len(line) + 1 for line in lines])])
    for a, b in chunk_bounds(lines, divisor):
        if b - a >= min_lines and words[b] - words[a] >= min_words:
            chunk = text[starts[a] : starts[b] - 1]
            yield a, b, chunk, blake2b(chunk, digest_size=16, person=b"chunk").digest()
    for a, b in run_bounds(words, run_words):
        yield a, b, None, blake2b(text[starts[a] : starts[b] - 1], digest_size=16, person=b"run").digest()


def _digests(batches: Iterator[pa.RecordBatch], rule: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = b"".join(d[:8] for t in batch.column(0).to_pylist() for *_, d in passages(t, rule))
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(found, np.int64))], ["short"])


def _passages(batches: Iterator[pa.RecordBatch], rule: tuple) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, *p) for i, t in enumerate(batch.column(2).to_pylist()) for p in passages(t, rule)]
        if rows:
            at, first, end, chunk, digest = zip(*rows, strict=True)
            take, short = pa.array(at), np.frombuffer(b"".join(d[:8] for d in digest), np.int64)
            chunk = [None if c is None else compress(c, 1) for c in chunk]
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(chunk, pa.binary()), pa.array(digest, pa.binary()), pa.array(short)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k", "first", "end", "chunk", "digest", "short"])


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("n_removed", LongType())]))
def _cut(texts: pd.Series, firsts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """Each text without the lines of its cuts, which may overlap, and how many those are."""
    out = []
    for text, first, end in zip(texts, firsts, ends, strict=True):
        if text is None:
            out.append((None, 0))
            continue
        lines = text.split("\n")
        depth = np.zeros(len(lines) + 1, np.int64)
        np.add.at(depth, first, 1)
        np.add.at(depth, end, -1)
        keep = np.cumsum(depth[:-1]) == 0
        out.append(("\n".join(line for line, stays in zip(lines, keep, strict=True) if stays), int((~keep).sum())))
    return pd.DataFrame(out, columns=["text", "n_removed"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with the text cleaned, and n_lines (of the text as read) and n_removed (lines taken out) behind its columns.

    Lines end at a line feed. Content-defined boundaries cut each text into chunks of lines. Of a chunk of at least
    ``min_lines`` lines and ``min_words`` words that occurs more than once in all texts, the occurrence first by
    (doc_id, text's digest, line) stays and the others are taken out. Digests only find candidates: chunks count as
    equal when their bytes are, which travel deflated. Boundaries miss the margins of a passage, and passages of a few long lines. So a line
    also goes if it is part of a run of lines of at least ``run_words`` words that stands at an earlier place by the
    same order, in another text or its own; runs are equal when their 128-bit digests are. Every line taken out has an
    equal one at an earlier place, so the first place of each passage keeps it.

    First, half digests are counted with map-side sums, so a frequent passage costs a row for each task; only passages
    whose half digest repeats then go on. The winner of each is a minimum, again with map-side sums. Texts with nothing to remove don't shuffle at all if the list
    of others is small, else they are joined by row.

    Null text stays null and has no lines. An emptied text is the empty string. Null ids come last. Rows that repeat id
    and text are one document and are cleaned alike. Other columns pass through; ones named n_lines or n_removed are
    replaced. Very long texts are read whole; a text's passages are one row each. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind, rule = docs.schema[id_col].dataType.simpleString(), (divisor, min_lines, min_words, run_words)
    key = F.unhex(F.md5(row_text(F.col(id_col), F.col(text_col))))
    read = docs.select(F.col(id_col).alias("doc_id"), key.alias("k"), F.col(text_col).cast("binary").alias("text"))
    repeated = read.select("text").mapInArrow(lambda it: _digests(it, rule), "short bigint").groupBy("short").agg(F.count("*").alias("n")).where("n > 1").select("short")
    found = read.mapInArrow(lambda it: _passages(it, rule), f"doc_id {kind}, k binary, first int, end int, chunk binary, digest binary, short bigint")
    seen = materialize(found.join(repeated, "short").drop("short"), "repeated-passages")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "first")
    winners = seen.groupBy("digest", "chunk").agg(F.min(place).alias("winner"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = (F.col("s.digest") == F.col("w.digest")) & F.col("s.chunk").eqNullSafe(F.col("w.chunk"))
    gone = seen.alias("s").join(winners.alias("w"), same).where((F.col("s.k") != F.col("winner.k")) | (F.col("s.first") != F.col("winner.first")))
    own_key, cut_names = unused_name(docs, "key"), unused_name(docs, "cuts")
    cuts = gone.groupBy(F.col("s.k").alias(own_key)).agg(F.collect_set(F.struct(F.col("s.first").alias("first"), F.col("s.end").alias("end"))).alias(cut_names))
    out = unused_name(docs, "out")
    joined = docs.drop("n_lines", "n_removed").withColumn(own_key, key).join(cuts, own_key, "left")
    cut = F.col(cut_names).isNotNull()
    # Only texts with cuts go to Python.
    joined = joined.withColumn(out, _cut(F.when(cut, F.col(text_col)), F.col(f"{cut_names}.first"), F.col(f"{cut_names}.end")))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.when(cut, F.col(f"{out}.text")).otherwise(F.col(text_col))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(F.split(F.col(text_col), "\n", -1))).cast("long")
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], n_lines.alias("n_lines"), F.coalesce(f"{out}.n_removed", F.lit(0)).cast("long").alias("n_removed"))
