"""MinHash near-dedup by a chosen-path set similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import connected_components, hash_words, materialize, mix64, shingle_hashes, small_batches, words_of

#: Minwise tokens in a sketch, independent trees, and levels below the root.
WIDTH, TREES, LEVELS = 64, 10, 6
#: Trees whose leaves are compared first; the leaves of the others then compare components only.
FIRST = 3
#: Members of a node, and shingles of all its members together, up to which a node is a leaf that is compared exhaustively.
SMALL, WEIGHT = 2_048, 1 << 22
#: A pair goes to the exact test if the share of its sketch that agrees is at most so many standard errors below the threshold.
ERRORS = 5.6
#: Columns of the incidence matrix that are held at a time.
COLUMNS = 8_192

_RNG = np.random.Generator(np.random.PCG64(20240101))
_MULTIPLY = (_RNG.integers(0, 2**32, WIDTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 2**32, WIDTH, dtype=np.uint64).astype(np.uint32)


def maybe(percent: int) -> float:
    """The share of a sketch that a pair at the threshold is bound to agree in: 0.60 for 85, 0.52 for 80."""
    s = percent / 100
    return s - ERRORS * (s * (1 - s) / WIDTH) ** 0.5


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each of ``WIDTH`` hash functions."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(WIDTH, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 4096):  # blocks that stay in a core's cache
        out = np.minimum(out, (x[None, i : i + 4096] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same, size, marks, short = [], [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            if not words:
                same.append(None), size.append(0), marks.append(None), short.append(None)
                continue
            shingles = np.unique(shingle_hashes(hash_words(text)))
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
            size.append(len(shingles))
            found = sketch(shingles)
            marks.append(found.tobytes())
            short.append(found.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(marks, pa.binary()), pa.array(short, pa.binary())], ["doc_id", "same", "n_shingles", "sketch", "short"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's identity and its shingles, sorted."""
    for batch in batches:
        same, sets = [], []
        for text in batch.column(0).to_pylist():
            words = words_of(text)
            if words:
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sets.append(np.unique(shingle_hashes(hash_words(text))).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), pa.array(sets, pa.binary())], ["same", "shingles"])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), WIDTH)


def _children(batch: pa.RecordBatch, tree: np.ndarray, node: np.ndarray, marks: np.ndarray, extra: np.uint64) -> pa.RecordBatch:
    """Children of members: each node picks one of the ``WIDTH`` minwise tokens, and with the chance that ``extra`` gives, another.

    The pick depends on the node alone, so all its members branch alike; members with the same token share a child.
    """
    first = mix64(node + np.uint64(0x51ED270B))
    one = (first % np.uint64(WIDTH)).astype(np.int64)
    two = (one + 1 + ((first >> np.uint64(32)) % np.uint64(WIDTH - 1)).astype(np.int64)) % WIDTH
    more = np.flatnonzero(mix64(node + np.uint64(0xA2BF8C13)) < extra)
    at = np.concatenate([np.arange(len(node)), more])
    pick = np.concatenate([one, two[more]])
    child = mix64(node[at] * np.uint64(0x9E3779B97F4A7C15) + (pick.astype(np.uint64) << np.uint64(32)) + marks[at, pick].astype(np.uint64))
    take = pa.array(at)
    return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(tree[at].astype(np.int32)), pa.array(child.view(np.int64))], ["rid", "n", "tree", "node"])


def branch(similarity: float, trees: int = 0):
    """The next level: of rows (rid, n, sketch, tree, node), or with ``trees`` of the roots of so many trees, for rows (rid, n, sketch).

    Nodes branch into ``1 / similarity`` children on average, so a pair at that similarity expects to share one.
    """
    extra = np.uint64(min(max(1 / similarity - 1, 0.0), 1.0) * (2**64 - 1))

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            marks = _matrix(batch.column(2), np.uint32)
            if trees:
                for tree in range(trees):
                    yield _children(batch, np.full(n, tree), np.full(n, tree + 1, np.uint64), marks, extra)
            else:
                yield _children(batch, batch.column(3).to_numpy(), batch.column(4).to_numpy().view(np.uint64), marks, extra)

    return children


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From rows sorted by their first two columns, tables of whole runs and where the runs start. A run's length has a bound."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = last is not None and (a[0], b[0]) != last
        last = (a[-1], b[-1])
        cuts = np.flatnonzero(new)
        if not len(cuts):
            held.append(batch)
            continue
        yield _cut([*held, batch.slice(0, cuts[-1])])
        held = [batch.slice(cuts[-1])]
    if held:
        yield _cut(held)


def _cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    a, b = table.column(0).to_numpy(), table.column(1).to_numpy()
    return table, np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]])


def _contested(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of rows (node, cell, rid, tree, component, asks, short), sorted: those that the sketches favour as partner of a row of another component.

    One of the two must ask. Rows of one cell are compared with those ``d`` places behind, for all ``d`` and all cells at a time.
    """
    for table, starts in _runs(batches):
        size = np.diff(starts)
        left = np.repeat(starts[1:], size) - np.arange(len(table))  # rows of the cell from here on
        component, asks = table["component"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False).astype(bool)
        marks = _matrix(table["short"].combine_chunks(), np.uint8)
        found, need = np.zeros(len(table), bool), np.ceil(least * WIDTH)
        for d in range(1, int(size.max())):
            i = np.flatnonzero(left > d)
            i = i[(component[i] != component[i + d]) & (asks[i] | asks[i + d])]
            for block in range(0, len(i), 8_192):
                x = i[block : block + 8_192]
                x = x[np.count_nonzero(marks[x] == marks[x + d], axis=1) >= need]
                found[x] = found[x + d] = True
        yield from table.select([0, 1, 2, 3, 4, 5]).filter(pa.array(found)).to_batches()


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share: set bits in common, a bit for each element that more than one holds."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    owner, new = owner[several], new[several]
    column = np.cumsum(new) - 1
    out = np.zeros((len(sets), len(sets)), np.int32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        width = -(-(int(column[b - 1]) - lo + 1) // 64) * 64
        held = np.zeros((len(sets), width), bool)
        held[owner[a:b], column[a:b] - lo] = True
        bits = np.packbits(held, axis=1).view(np.uint64)
        for i in range(len(sets)):
            out[i, i:] += np.bitwise_count(bits[i:] & bits[i]).sum(axis=1, dtype=np.int32)
    return out + np.triu(out, 1).T


def _forest(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (node, cell, rid, tree, component, asks, shingles), sorted: links between components, at most one fewer than a cell has components.

    All pairs of a cell that may link are held against each other on full sets; the links that are written span them.
    """
    for table, starts in _runs(batches):
        rid, component = table["rid"].to_numpy(), table["component"].to_numpy()
        asks, packed = table["asks"].to_numpy(zero_copy_only=False).astype(bool), table["shingles"].combine_chunks()
        a, b = [], []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in packed[lo:hi]]
            n, both = np.fromiter(map(len, sets), np.int64, hi - lo), _shared(sets)
            linked = np.zeros(both.shape, bool)
            for i, row in enumerate(both):
                linked[i] = (100 * row.astype(np.int64) >= percent * (n[i] + n - row)) & (asks[lo + i] | asks[lo:hi]) & (component[lo:hi] != component[lo + i])
            _, group = np.unique(component[lo:hi], return_inverse=True)
            seen = np.zeros(hi - lo, bool)
            for root in range(hi - lo):
                if seen[root]:
                    continue
                todo = [root]
                while todo:
                    i = todo.pop()
                    same = group == group[i]
                    if not seen[i]:
                        seen |= same
                        todo.extend(np.flatnonzero(same))
                        continue
                    for j in np.flatnonzero(linked[i] & ~seen):
                        if not seen[j]:
                            a.append(rid[lo + i]), b.append(rid[lo + j])
                            same = group == group[j]
                            seen |= same
                            todo.extend(np.flatnonzero(same))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (node, rid, component, ...) of nodes of more than one component."""
    return rows.join(rows.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("node"), "node")


def _plain(rows: DataFrame) -> DataFrame:
    """Each leaf within the bounds is one cell, in which all ask."""
    return rows.select("node", F.lit(0).cast("long").alias("cell"), "rid", "tree", "component", F.lit(True).alias("asks"))


def _blocks(leaves: DataFrame, fresh: bool) -> DataFrame:
    """Cells of leaves that are still above the bounds at the last level, from rows (node, size, weight, first, rid, component).

    Members stand in blocks, those who ask in blocks too; each cell holds one of either. While all is ``fresh``, the
    leaf's first member asks; later, all outside that member's component do. So a large group of near copies costs a
    multiple of its size once its first member has linked most of them.
    """
    if fresh:
        rest = leaves.withColumn("asks", F.col("rid") == F.col("first"))
    else:
        head = leaves.where("rid = first").select("node", F.col("component").alias("head"))
        rest = _mixed(leaves).join(head, "node").withColumn("asks", F.col("component") != F.col("head"))
    rest = rest.withColumn("blocks", F.ceil(F.greatest(F.col("size") / SMALL, F.col("weight") / WEIGHT)))
    asked = rest.where("asks").groupBy("node").agg(F.ceil(F.count("*") / SMALL).alias("asked"))
    rest = rest.join(asked, "node").withColumn("member", F.pmod(F.xxhash64("rid"), "blocks")).withColumn("query", F.pmod(F.xxhash64("rid", F.lit(1)), "asked"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = rest.where(~F.col("asks")).withColumn("q", each("asked")).withColumn("cell", F.col("q") * F.col("blocks") + F.col("member"))
    queries = rest.where("asks").withColumn("m", each("blocks")).withColumn("cell", F.col("query") * F.col("blocks") + F.col("m"))
    # Blocks of those who ask also meet each other.
    among = rest.where("asks and asked > 1").withColumn("o", each("asked")).where("o <> query").withColumn("cell", -1 - (F.least("o", "query") * F.col("asked") + F.greatest("o", "query")))
    columns = ("node", "cell", "rid", F.lit(-1).alias("tree"), "component", "asks")
    return members.select(*columns).unionByName(queries.select(*columns)).unionByName(among.select(*columns))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Words are A-Z lower-cased runs without white space; a document's set holds its distinct five-word shingles, or its
    whole sequence if it has fewer words. Documents are linked if 100 * intersection >= ``percent`` * union, and
    component_id is the least id reachable over links.

    1. Texts with one word sequence are one representative; copies never meet again until the end.
    2. Each representative walks ``trees`` trees. A node branches on one or two minwise tokens chosen by the node, so
       that a pair at the threshold is expected to share one child; nodes above ``SMALL`` members or ``WEIGHT`` shingles
       branch again, up to ``LEVELS`` times. A pair at similarity 0.85 shares no leaf of one tree with a chance of 0.13
       after one level, 0.36 after four and 0.44 after six: with ten trees that is 1e-9, 4e-5 and 3e-4. At 0.80 it is
       0.16, 0.42 and 0.50, with ten trees 1e-8, 2e-4 and 1e-3.
    3. Each leaf compares all its members by their sketches. Those with a favoured partner bring their full sets to the
       leaf, where all of them are held against each other exactly. What a leaf writes is links that span its
       components, fewer than it has members, and no pair is passed over.
    4. First the leaves of ``FIRST`` trees do so. Their links make components, and leaves of the other trees compare
       members of different components only.

    Null or blank text: an empty set, linked with nothing; component_id is the row's own id. Null ids lose to any other
    id; a group of null ids alone has a null component_id and is kept. Rows that repeat an id are all kept or none.
    Other columns, whatever their names, are not read. Texts are read whole; a very long one needs memory for its words
    and eight bytes for each of its shingles. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    least = maybe(percent)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    each = materialize(texts.mapInArrow(_describe, f"doc_id {kind}, same binary, n_shingles bigint, sketch binary, short binary"), "described")
    groups = each.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short"))
    reps = materialize(groups.withColumn("rid", F.monotonically_increasing_id()), "representatives")
    marks, short = reps.select("rid", "n", "sketch"), reps.select("rid", "short")

    walked = "rid bigint, n bigint, tree int, node bigint"
    above = (F.col("size") > SMALL) | ((F.col("weight") > WEIGHT) & (F.col("size") > 2))
    grown, leaves, large = marks.mapInArrow(branch(percent / 100, trees), walked), None, None
    for depth in range(LEVELS):
        sizes = grown.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("rid").alias("first")).where("size > 1")
        members = materialize(grown.join(sizes, "node"), "members")
        done = members.where(~above).select("node", "rid", "tree")
        leaves = done if leaves is None else leaves.unionByName(done)
        if members.where(above).isEmpty():
            break
        if depth == LEVELS - 1:
            large = members.where(above).select("node", "size", "weight", "first", "rid")
        else:
            grown = members.where(above).select("rid", "tree", "node").join(marks, "rid").select("rid", "n", "sketch", "tree", "node").mapInArrow(branch(percent / 100), walked)

    row = "node bigint, cell bigint, rid bigint, tree int, component bigint, asks boolean"

    def sorted_cells(rows: DataFrame) -> DataFrame:
        return rows.repartition("node", "cell").sortWithinPartitions("node", "cell")

    def contested(cells: DataFrame) -> DataFrame:
        full = cells.join(short, "rid").select("node", "cell", "rid", "tree", "component", "asks", "short")
        return materialize(sorted_cells(full).mapInArrow(lambda it: _contested(it, least), row), "contested")

    def links(rows: DataFrame) -> DataFrame:
        full = rows.join(sets, "rid").select("node", "cell", "rid", "tree", "component", "asks", "shingles")
        return sorted_cells(full).mapInArrow(lambda it: _forest(it, percent), "a bigint, b bigint")

    def labelled(of: DataFrame, components: DataFrame) -> DataFrame:
        named = components.select(F.col("id").alias("rid"), F.col("component").alias("found"))
        return of.join(named, "rid", "left").withColumn("component", F.coalesce("found", "rid")).drop("found")

    cells = _plain(leaves.withColumn("component", F.col("rid")))
    start = contested(cells if large is None else cells.unionByName(_blocks(large.withColumn("component", F.col("rid")), True)))
    wanted = start.select("rid") if large is None else start.select("rid").union(large.select("rid"))
    wanted = wanted.distinct().join(reps.select("rid", "same", "first_id"), "rid")
    # Texts are picked by id before their sets are made; of several texts under one id, the identity picks the right one.
    picked = texts.join(wanted.select("first_id").distinct(), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select("text")
    sets = picked.mapInArrow(_sets, "same binary, shingles binary").join(wanted.select("rid", "same"), "same")
    sets = materialize(sets.groupBy("rid").agg(F.first("shingles").alias("shingles")), "sets")

    components = connected_components(links(start.where(F.col("tree") < FIRST)))
    cells = _plain(_mixed(labelled(start.where(F.col("tree") >= FIRST).select("node", "rid", "tree"), components)))
    again = contested(cells if large is None else cells.unionByName(_blocks(labelled(large, components), False)))
    known = components.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    components = connected_components(links(again).unionByName(known))

    lowest = labelled(reps.select("same", "rid", "first_id"), components)
    least_id = lowest.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_text = lowest.join(least_id, "component").select("same", "component_id")
    out = each.select("doc_id", "same", "n_shingles").join(by_text, "same", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
