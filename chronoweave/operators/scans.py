"""Ordered scans: each key's rows in order through a chain of generators.

Rows are dealt out by key and sorted inside Spark's partitions, and a task streams through them. A scan holds the rows
that its rule looks at, a few, so a key of any length needs no more memory than a short one.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of one batch that a scan gives back.
OUT_ROWS = 4096


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], scan: Callable[[Iterator], Iterable[tuple]], schema: str, read: dict[str, Callable[[pa.Array], list]] | None = None) -> DataFrame:
    """What ``scan`` makes of each key's rows: it gets them in order, as named tuples, and yields tuples of ``schema`` behind the key's columns.

    ``read``: how a column's values are read from Arrow, other than as Python's plain ones.
    """
    names = tuple(df.columns)
    row = namedtuple("row", names)  # noqa: PYI024  columns are not known before
    key_kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    out = StructType.fromDDL(f"{key_kinds}, {schema}")
    arrow = to_arrow_schema(out)
    at = [names.index(k) for k in keys]
    values_of = [(read or {}).get(name, lambda column: column.to_pylist()) for name in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(*values) for batch in batches for values in zip(*(of(c) for of, c in zip(values_of, batch.columns, strict=True)), strict=True))
        held: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: tuple(r[i] for i in at)):
            for made in scan(group):
                held.append(key + tuple(made))
                if len(held) == OUT_ROWS:
                    yield _batch(held, arrow)
                    held = []
            for _ in group:  # what a scan leaves unread belongs to its key still
                pass
        if held:
            yield _batch(held, arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def with_neighbours(rows: Iterable, mend: Callable[[object, object, object], object]) -> Iterator:
    """Each row after ``mend(before, row, after)``: the one before as it was mended, the one after as it came. The first and the last row stay."""
    before = row = None
    for after in rows:
        if row is not None:
            row = row if before is None else mend(before, row, after)
            yield row
        before, row = row, after
    if row is not None:
        yield row


def joined(rows: Iterable, joins: Callable[[object, object], bool], merge: Callable[[object, object], object]) -> Iterator:
    """Rows, each merged into the one before it, as that stands by then, where ``joins`` says so."""
    last = None
    for row in rows:
        if last is None:
            last = row
        elif joins(last, row):
            last = merge(last, row)
        else:
            yield last
            last = row
    if last is not None:
        yield last


def near_any(df: DataFrame, keys: list[str], row_id: list[str], place: str | Column, marks: DataFrame, mark: str, within: float, name: str) -> DataFrame:
    """``df`` with a column ``name``: whether a mark of the row's key lies within ``within`` of its ``place``.

    Both meet in buckets of time, so a key with many marks is spread; rows that meet none stay.
    """
    width = 2 * within
    place = F.col(place) if isinstance(place, str) else place
    m = marks.select(*keys, F.col(mark).alias("__mark"))
    m = m.withColumn("__bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("__mark") - within) / width), F.floor((F.col("__mark") + within) / width))))).distinct()
    at = df.select(*keys, *(r for r in row_id if r not in keys), place.alias("__place"))
    hits = at.withColumn("__bucket", F.floor(F.col("__place") / width)).join(m, [*keys, "__bucket"])
    hits = hits.where((F.col("__mark") >= F.col("__place") - within) & (F.col("__mark") <= F.col("__place") + within)).select(*dict.fromkeys([*keys, *row_id])).distinct()
    return df.join(hits.withColumn(name, F.lit(True)), list(dict.fromkeys([*keys, *row_id])), "left").withColumn(name, F.coalesce(name, F.lit(False)))
