"""Token counts by a two-tier map-side lookup."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.bpe import LONGEST, LengthCache, encoder
from chronoweave.llm.common import small_batches

#: Entries of the broadcast table, of each partition's summary, and counters held while a summary is made; none is longer than ``LONGEST`` characters.
TABLE, SUMMARY, COUNTERS = 16_384, 4_096, 65_536


def _shrink(counts: Counter, keep: int) -> Counter:
    """Misra-Gries pruning: subtract the count of rank ``keep`` from all and drop what is left with nothing."""
    if len(counts) <= keep:
        return counts
    cut = sorted(counts.values(), reverse=True)[keep]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _summaries(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    split = encoder(path).pieces
    for batch in batches:
        for text in batch.column(0).to_pylist():
            pieces = split(text) if text else None
            if pieces:
                counts.update([p for p in pieces[1:] if len(p) <= LONGEST])
        if len(counts) > COUNTERS:
            counts = _shrink(counts, COUNTERS // 2)
    top = _shrink(counts, SUMMARY)
    if top:
        yield pa.RecordBatch.from_arrays([pa.array([list(top)]), pa.array([list(top.values())], pa.list_(pa.int64()))], ["pieces", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for pieces, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total.update(dict(zip(pieces, counts, strict=True)))
            total = _shrink(total, COUNTERS)
    if total:
        total = _shrink(total, TABLE)
        yield pa.RecordBatch.from_arrays([pa.array([list(total)]), pa.array([list(total.values())], pa.list_(pa.int64()))], ["pieces", "counts"])


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Token counts of the most frequent pre-token groups of all texts, at most ``TABLE`` of them.

    Each partition makes one Misra-Gries summary of fixed size; summaries merge in two steps. No pre-token is shuffled.
    Groups beyond ``LONGEST`` characters are left out, so counters, summaries and the table are bounded in bytes too.
    """
    schema = "pieces array<string>, counts array<bigint>"
    each = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda it: _summaries(it, path), schema)
    partial = each.repartition(16).mapInArrow(_merged, schema)
    rows = partial.repartition(1).mapInArrow(_merged, schema).collect()
    core = encoder(path).core
    return {p: len(core.encode_ordinary(" " + p)) for r in rows for p in r["pieces"]}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``; over_limit: more than ``limit`` tokens.

    Tokens are those of the file's tokenizer without begin, end or added tokens; an added token's string inside a text
    counts as that token. The frequent table only saves work: counts don't depend on it. Null text counts as empty: no
    bytes, no tokens. Ids, null or repeated, pass through. Other columns, whatever their names, are not read. Texts are
    tokenised whole, whatever their length. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    frequent = frequent_lengths(docs, tokenizer_path, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = LengthCache(tokenizer_path, frequent)
        for batch in batches:
            n = [cache(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    return read.mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
