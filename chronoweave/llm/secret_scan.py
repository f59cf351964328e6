"""Secret scan with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import row_text

#: Characters between two parts of one credential at most: the scope.
SCOPE = 256


@dataclass(frozen=True)
class Kind:
    """A kind of span. ``group`` is the group whose match ``keep`` (an SQL pattern) must accept; ``hint``: lower-case strings of which a text must hold one.

    ``pattern`` defines the spans. Where it would read on from each of many starts in one long run, ``linear`` finds the
    same ones in one pass: it starts with the run, its group 1 is what comes before the span, and the number of the
    group to keep is one higher.
    """

    name: str
    role: str
    pattern: str
    group: int
    keep: str
    hint: tuple[str, ...]
    weak: bool
    linear: str = ""


#: In the order in which kinds of one start are listed. The first three are the base kinds.
KINDS = (
    Kind(
        "assign", "secret",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2, "^.{8,}$", ("passw", "secret", "token", "api"), False,
    ),
    Kind("access", "id", "AKIA[A-Z0-9]+", 0, "^.{16,}$", ("akia",), False),
    Kind("hex", "secret", "[0-9a-f]{32,}", 0, "^.{32,}$", (), False),
    Kind(
        "weak_id", "id",
        "([Cc]lient|CLIENT|[Aa]ccess|ACCESS|[Aa]ccount|ACCOUNT|[Uu]ser|USER|[Ll]ogin|LOGIN)[A-Za-z_-]*[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)",
        2, "^.{4,}$", ("client", "access", "account", "user", "login"), True,
        # A run of these letters goes on as far for each name in it, so its first name decides.
        "(?<![A-Za-z_-])(?>([A-Za-z_-]*?)([Cc]lient|CLIENT|[Aa]ccess|ACCESS|[Aa]ccount|ACCOUNT|[Uu]ser|USER|[Ll]ogin|LOGIN))[A-Za-z_-]*+[\"']?\\x20*+[:=]\\x20*+[\"']?([A-Za-z0-9_.@-]++)",
    ),
    Kind("weak_secret", "secret", "[A-Za-z0-9+/_=-]{20,}", 0, "[0-9]", (), True),
    Kind(
        "endpoint", "endpoint", "[A-Za-z][A-Za-z0-9+:.]*://[^\\x00-\\x20\"'<>]+", 0, "^.{8,}$", ("://",), True,
        # The run before // starts with its first letter and ends with a colon.
        "(?<![A-Za-z0-9+:.])([0-9+:.]*+)([A-Za-z][A-Za-z0-9+:.]*+(?<=:)//[^\\x00-\\x20\"'<>]++)",
    ),
)


def _hinted(kind: Kind, lowered: Column, text: Column) -> Column:
    if kind.hint:
        found = F.lit(False)
        for h in kind.hint:
            found = found | lowered.contains(h)
        return found
    return text.rlike(kind.pattern)


def _matches(kind: Kind, rank: int, text: Column) -> Column:
    """An array with a struct for each match: kind, place among the kind's matches, characters before it since the last match, its length, whether it holds."""
    pattern, group = (kind.linear, kind.group + 1 + (kind.group == 0)) if kind.linear else (kind.pattern, kind.group)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    lead = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind.linear else F.transform(whole, lambda _: F.lit(""))
    between = F.split(text, pattern, -1)

    def row(pair: Column, i: Column) -> Column:
        holds = pair["p"].rlike(kind.keep)
        if kind.name == "weak_secret":
            holds = holds & pair["p"].rlike("[a-z]") & pair["p"].rlike("[A-Z]")
        before = F.length(pair["l"])
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), (F.length(F.coalesce(pair["b"], F.lit(""))) + before).alias("gap"), (F.length(pair["m"]) - before).alias("len"), holds.alias("holds"))

    zipped = F.arrays_zip(F.slice(between, 1, F.greatest(F.size(whole), F.lit(1))).alias("b"), whole.alias("m"), part.alias("p"), lead.alias("l"))
    return F.filter(F.transform(zipped, row), lambda r: r["len"].isNotNull())


def find_spans(rows: DataFrame) -> DataFrame:
    """(k, rank, start, end) of each span in ``rows`` (k, text), before weak ones are judged. Offsets are in code points, end exclusive.

    Pieces between matches and the matches give offsets by a running sum in each (row, kind), so a text with very many
    matches costs no more than its sort.
    """
    text, lowered = F.col("text"), F.lower("text")
    empty = F.array().cast("array<struct<rank:int,i:int,gap:int,len:int,holds:boolean>>")
    arrays = [F.when(_hinted(kind, lowered, text), _matches(kind, rank, text)).otherwise(empty) for rank, kind in enumerate(KINDS)]
    found = rows.select("k", F.explode(F.flatten(F.array(*arrays))).alias("s")).select("k", "s.*").groupBy("k", "rank", "i").agg(F.max("gap").alias("gap"), F.max("len").alias("len"), F.max("holds").alias("holds"))
    before = Window.partitionBy("k", "rank").orderBy("i")
    ended = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    return ended.where("holds").select("k", "rank", (F.col("end") - F.col("len")).alias("start"), "end")


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base spans, and those weak ones that have a part of another role at most ``scope`` characters away in their row.

    This is an interval join of each weak span with the parts of its row. As only the existence of a partner counts,
    the nearest parts on either side decide: running extremes along the row's spans replace the pairs, and no pair is
    ever written out.
    """
    role = F.element_at(F.array(*[F.lit(k.role) for k in KINDS]), F.col("rank") + 1)
    weak = F.element_at(F.array(*[F.lit(k.weak) for k in KINDS]), F.col("rank") + 1)
    ahead = Window.partitionBy("k").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("k").orderBy(F.desc("start"), F.desc("end"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    out = spans.withColumn("role", role).withColumn("weak", weak)
    near = F.lit(False)
    for name in ("id", "secret", "endpoint"):
        out = out.withColumn(f"end_{name}", F.max(F.when(F.col("role") == name, F.col("end"))).over(ahead))
        out = out.withColumn(f"start_{name}", F.min(F.when(F.col("role") == name, F.col("start"))).over(back))
        close = (F.col("start") - F.col(f"end_{name}") <= scope) | (F.col(f"start_{name}") - F.col("end") <= scope)
        near = near | ((F.col("role") != name) & F.coalesce(close, F.lit(False)))
    return out.where(~F.col("weak") | near).select("k", "rank", "start", "end", "weak")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked), a row for each row of ``docs``.

    ``spans`` lists kind:start:end of all spans, comma-joined, by start and then kind in the order of ``KINDS``; the
    digest is of the base spans alone. Null text counts as empty; a text without spans has zero counts, an empty list
    and the digest of the empty string. Rows are told apart by id and text, so rows that repeat both share their
    result and null ids are rows like others. Other columns, whatever their names, are not read. Texts are read whole,
    in time that grows with their length, be they one unbroken run of letters. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = base.withColumn("k", F.sha2(row_text(F.col("doc_id"), F.col("text")), 256))
    kept = link_parts(find_spans(keyed.select("k", "text")), scope)
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("rank") + 1)
    text = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    by_row = kept.groupBy("k").agg(
        *[F.count(F.when(F.col("rank") == i, 1)).alias(f"n_{k.name}") for i, k in enumerate(KINDS[:3])],
        F.count(F.when(F.col("weak"), 1)).alias("n_linked"),
        F.sort_array(F.collect_list(F.struct("start", "rank", "end", "weak", text.alias("s")))).alias("all"),
    )
    by_row = by_row.select(
        "k", "n_assign", "n_access", "n_hex", "n_linked",
        F.array_join(F.col("all.s"), ",").alias("spans"),
        F.array_join(F.transform(F.filter("all", lambda x: ~x["weak"]), lambda x: x["s"]), ",").alias("base"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return keyed.select("doc_id", "k").join(by_row, "k", "left").select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))
