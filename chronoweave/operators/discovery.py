"""Where narration lines stand in a source's lines: four signals, anchors among them, and their fusion.

Lines are rows of a project: (key, n_id, n_start, n_end, text) and (key, m_id, m_start, m_end, text). Every signal is a
join within the project, and all four meet in one row for each narration line. Both sides are dealt out by project once, as
text; what is made of it (runs of words, entities, pairs) is many times as large and stays in the task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from chronoweave.functions import text as X
from chronoweave.functions.scoring import fuzzy_confidence
from chronoweave.operators.sequence import in_increasing_subset

c = F.col

#: Weights of the signals, of shared runs of words, and of entities: fixed values.
WEIGHTS = {"english": 0.45, "entity": 0.25, "timeline": 0.15, "context": 0.15}
GRAMS = ((5, 3.0), (4, 2.0), (3, 1.0))
NAMED, COMMON = 3.0, 0.5
#: Candidates that are compared, least confidences of anchors by line and by entity, above which entities aren't asked, and of an entity match.
CANDIDATES, ANCHOR_LINE, ANCHOR_ENTITY, LINE_IS_ENOUGH, LEAST_SHARE = 5, 0.5, 0.4, 0.7, 0.15
#: How often a learned entity occurs; seconds of a bucket of lines, lines on either side of a window, least score of a bucket.
LEARNED, BUCKET, WINDOW, LEAST_BUCKET = (2, 50), 30.0, 3, 0.5
#: Parts of a shuffle of text for each of Spark's.
PARTS = 4
#: Frequent words that are no entities: fixed values.
STOP_WORDS = """the is are was were be been being have has had do does did will would could should may might shall can need and but or nor not no yes you your
he him his she her it its they them their we our my me who what which that this these those there here where when how why all any some one two
with for from about into than then just don didn doesn won wouldn couldn very too also only now out well get got going know think want like say said
tell told come came take took make made let look see saw give gave back over""".split()


@F.pandas_udf(DoubleType())
def word_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the number of common words, each as often as in both, over the number of words of both normalised lines."""

    def ratio(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        left, right = x.split(" "), y.split(" ")
        return 2.0 * (Counter(left) & Counter(right)).total() / (len(left) + len(right))

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def gathered(narration: DataFrame, movie: DataFrame, key: str) -> DataFrame:
    """(key, said, id, start, end, text): rows of both sides with a key, those of a project together; whatever goes by project next needs no other shuffle.

    Parts are several times as many as Spark's own, since a part grows in its task. Joins by project and something else
    would be dealt out anew for the sake of projects much larger than others; the session is told not to.
    """
    narration.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = PARTS * int(narration.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda df, p, said: df.select(key, F.lit(said).alias("said"), c(f"{p}_id").alias("id"), c(f"{p}_start").alias("start"), c(f"{p}_end").alias("end"), "text")
    lines = side(narration, "n", True).unionByName(side(movie, "m", False)).where(c(key).isNotNull())
    rows = F.collect_list(F.struct("said", "id", "start", "end", "text")).alias("rows")
    return lines.repartition(parts, key).groupBy(key).agg(rows).select(key, F.inline("rows"))


def one_side(lines: DataFrame, key: str, said: bool) -> DataFrame:
    """The narration or the source of ``gathered`` rows."""
    p = "n" if said else "m"
    return lines.where(c("said") == said).select(key, c("id").alias(f"{p}_id"), c("start").alias(f"{p}_start"), c("end").alias(f"{p}_end"), "text")


def line_signal(narration: DataFrame, movie: DataFrame, key: str, ratio: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, n_id, english_time, english): the most similar of the five source lines that share most runs of three to five words, and its confidence.

    A line of fewer words than a run is one run. Lines of one word are not looked for. A row is a place in a line with
    the runs that start there: who shares a longer run shares the shortest at the same places, so one join finds all.
    """
    shortest = min(n for n, _ in GRAMS)

    def runs(df: DataFrame, prefix: str, *keep: str) -> DataFrame:
        word = lambda k: F.get("w", c("at") + k)
        w = df.select(*keep, X.words(X.normalized(c("text"))).alias("w"))
        # Outer, and asked for the second word afterwards, as conditions on the words alone would have them made once more.
        w = w.select(*keep, "w", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("w") - shortest, F.lit(0)))).alias("at")).where(word(1).isNotNull())
        run = lambda n: F.when((c("at") == 0) | (c("at") + n <= F.size("w")), F.xxhash64(*[word(k) for k in range(n)]))
        return w.select(*keep, *[run(n).alias(f"{prefix}{n}") for n, _ in GRAMS])

    asked, held = runs(narration, "g", key, "n_id"), runs(movie, "h", key, "m_id").withColumnRenamed(f"h{shortest}", f"g{shortest}")
    same = [F.when(c(f"g{n}") == c(f"h{n}"), v).otherwise(0.0) if n > shortest else F.lit(v) for n, v in GRAMS]
    hits = asked.join(held, [f"g{shortest}", key]).groupBy(key, "n_id", "m_id").agg(F.sum(sum(same[1:], same[0])).alias("shared"))
    by_line = Window.partitionBy(key, "n_id")
    top = hits.withColumn("rank", F.row_number().over(by_line.orderBy(F.desc("shared"), "m_id"))).where(c("rank") <= CANDIDATES)
    top = top.join(narration.select(key, "n_id", c("text").alias("n_text")), [key, "n_id"]).join(movie.select(key, "m_id", "m_start", c("text").alias("m_text")), [key, "m_id"])
    top = top.withColumns({"n_norm": X.normalized(c("n_text")), "m_norm": X.normalized(c("m_text"))})
    best = top.withColumn("ratio", F.round(ratio(c("n_norm"), c("m_norm")), 9)).groupBy(key, "n_id").agg(F.max_by(F.struct("ratio", "m_start"), F.struct("ratio", -c("rank"))).alias("b"))
    return best.select(key, "n_id", c("b.m_start").alias("english_time"), fuzzy_confidence(c("b.ratio")).alias("english")).where("english is not null")


def entities(lines: DataFrame, movie: DataFrame, aliases: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, keep, entity, weight) of ``lines``: names by any of their ``aliases`` (alias, name), and words that the project's source uses 2 to 50 times."""
    words = lambda df, *k: df.select(key, *k, F.explode_outer(F.expr(r"regexp_extract_all(text, '[a-zA-Z\']{2,}', 0)")).alias("word")).where("word is not null").withColumn("word", F.lower("word"))
    learned = words(movie).where((F.length("word") >= 3) & ~c("word").isin(STOP_WORDS)).groupBy(key, "word").agg(F.count("*").alias("times")).where(c("times") >= LEARNED[0])
    named = aliases.select(F.lower("alias").alias("word"), "name")
    known = learned.join(F.broadcast(named), "word", "left").where(c("name").isNotNull() | (c("times") <= LEARNED[1]))
    known = known.groupBy(key, F.coalesce("name", "word").alias("entity")).agg(F.max(F.when(c("name").isNotNull(), NAMED).otherwise(COMMON)).alias("weight"))
    by_word = words(lines, *keep).join(F.broadcast(named), "word", "left").select(key, *keep, F.coalesce("name", "word").alias("entity")).distinct().join(known, [key, "entity"])
    # A name that the text holds anywhere counts even where the source never uses it as a word.
    inside = lines.select(key, *keep, F.lower("text").alias("low")).join(F.broadcast(named), F.col("low").contains(c("word"))).select(key, *keep, c("name").alias("entity")).distinct()
    by_name = inside.join(known, [key, "entity"], "left").withColumn("weight", F.coalesce("weight", F.lit(COMMON)))
    return by_word.unionByName(by_name.select(by_word.columns)).groupBy(key, *keep, "entity").agg(F.max("weight").alias("weight"))


def entity_signal(said: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """(key, n_id, entity_time, entity): the source line with the greatest share of a narration line's entities by weight."""
    said = said.withColumn("total", F.sum("weight").over(Window.partitionBy(key, "n_id")))
    shared = said.join(shown.drop("weight"), [key, "entity"]).groupBy(key, "n_id", "m_id", "m_start").agg(F.sum("weight").alias("w"), F.first("total").alias("total"))
    shared = shared.withColumn("entity", F.least(F.lit(1.0), c("w") / F.greatest("total", F.lit(1.0)))).where(c("entity") >= LEAST_SHARE)
    best = shared.groupBy(key, "n_id").agg(F.max_by(F.struct("m_start", "entity"), F.struct("entity", -c("m_id"))).alias("b"))
    return best.select(key, "n_id", c("b.m_start").alias("entity_time"), c("b.entity").alias("entity"))


def shared_entities(lines: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """(key, n_id, entity_time, entity, total, seen) of ``gathered`` rows: as ``entity_signal`` of ``entities``, the weight of a line's entities, and the buckets that hold them.

    ``seen`` has (bucket, score) of each bucket of source lines, rare entities scoring above all. Words of both sides
    meet by project in one row for each entity, which has the lines that hold it, so that text is read once.
    """
    kind = f"struct<said: boolean, id: {dict(lines.dtypes)['id']}, start: double>"
    place, none = F.struct("said", "id", c("start").cast("double").alias("start")), F.array().cast(f"array<{kind}>")
    named = aliases.select(F.lower("alias").alias("word"), "name").distinct()
    # A line's words, and the names that it holds anywhere.
    said = F.transform(F.expr(r"regexp_extract_all(text, '[a-zA-Z\']{2,}', 0)"), lambda w: F.struct(F.lower(w).alias("word"), F.lit(None).cast("string").alias("held")))
    held = F.transform(F.filter("named", lambda a: F.lower("text").contains(a["word"])), lambda a: F.struct(F.lit(None).cast("string").alias("word"), a["name"].alias("held")))
    words = lines.where("text is not null").crossJoin(F.broadcast(named.agg(F.collect_list(F.struct("word", "name")).alias("named"))))
    words = words.select(key, place.alias("place"), F.explode_outer(F.concat(said, held)).alias("x")).select(key, "place", "x.*").where("word is not null or held is not null")
    words = words.groupBy("word", "held", key).agg(F.count(F.when(~c("place.said"), True)).alias("times"), F.collect_list("place").alias("places")).join(F.broadcast(named), "word", "left")
    learned = (F.length("word") >= 3) & ~c("word").isin(STOP_WORDS) & (c("times") >= LEARNED[0])
    words = words.withColumn("weight", F.when(learned & c("name").isNotNull(), NAMED).when(learned & (c("times") <= LEARNED[1]), COMMON)).withColumn("entity", F.coalesce("held", "name", "word"))
    # A word that is no entity by itself may still be a name that another word makes one.
    names = named.select(c("name").alias("entity"), F.lit(True).alias("is_name")).distinct()
    words = words.join(F.broadcast(names), "entity", "left").where("weight is not null or is_name")
    by = lambda some: F.flatten(F.collect_list(F.when(some, c("places"))))
    held = words.groupBy("entity", key).agg(F.max("weight").alias("weight"), by(c("held").isNull()).alias("by_word"), by(c("held").isNotNull()).alias("inside"))
    held = held.select(key, F.coalesce("weight", F.lit(COMMON)).alias("weight"), F.array_distinct(F.when(c("weight").isNotNull(), F.concat("by_word", "inside")).otherwise(c("inside"))).alias("places"))
    bucket = lambda start: F.floor(start / BUCKET)
    buckets = one_side(lines, key, False).groupBy(key).agg(F.countDistinct(bucket(c("m_start"))).alias("buckets"))
    held = held.select(key, "weight", F.filter("places", lambda p: p["said"]).alias("said"), F.filter("places", lambda p: ~p["said"]).alias("shown")).where("size(said) > 0").join(buckets, key, "left")
    rarity = F.log(c("buckets") / (1 + F.size(F.array_distinct(F.transform("shown", lambda p: bucket(p["start"]))))))
    pairs = held.select(key, "weight", (c("weight") * rarity).alias("rare"), F.explode("said").alias("n"), "shown")
    # Every entity counts once for its line, without a source line.
    pairs = pairs.select(key, c("n.id").alias("n_id"), "weight", "rare", F.explode(F.concat(F.array(F.lit(None).cast(kind)), "shown")).alias("m"))
    pairs = pairs.groupBy(key, "n_id", c("m.id").alias("m_id"), c("m.start").alias("m_start")).agg(F.sum("weight").alias("w"), F.sum("rare").alias("rare"))
    parts = pairs.groupBy(key, "n_id", bucket(c("m_start")).alias("bucket")).agg(F.max(F.struct("w", -c("m_id"), "m_start")).alias("best"), F.sum("rare").alias("score"))
    some = c("bucket").isNotNull()
    found = parts.groupBy(key, "n_id").agg(F.max(F.when(some, c("best"))).alias("best"), F.max(F.when(~some, c("best.w"))).alias("total"), F.collect_list(F.when(some, F.struct("bucket", "score"))).alias("seen"))
    share = F.when(c("best").isNotNull(), F.least(F.lit(1.0), c("best.w") / F.greatest("total", F.lit(1.0))))
    found = found.withColumn("entity", F.when(share >= LEAST_SHARE, share))
    return found.select(key, "n_id", F.when(c("entity").isNotNull(), c("best.m_start")).alias("entity_time"), "entity", "total", "seen")


def with_context(lines: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, keep, context_time, context) of ``lines`` (place, total, seen): the bucket of source lines that holds most of what a line and its neighbours name.

    A line adds its scores to the places around it and itself to its own; numbers alone are kept.
    """
    own = F.struct(F.lit(None).cast("bigint").alias("bucket"), F.lit(None).cast("double").alias("score"))
    near = lines.select(key, *keep, "total", c("place").alias("at"), F.explode(F.concat(F.array(own), F.coalesce("seen", F.array().cast("array<struct<bucket: bigint, score: double>>")))).alias("s"))
    near = near.select(key, *keep, "total", "at", "s.*", F.explode(F.sequence(c("at") - WINDOW, c("at") + WINDOW)).alias("place"))
    mine = c("bucket").isNull() & (c("place") == c("at"))
    score = near.groupBy(key, "place", "bucket").agg(F.round(F.sum("score"), 9).alias("score"), F.sum("total").alias("total"), F.max(F.when(mine, c("at"))).alias("at"), *[F.max(F.when(mine, c(x))).alias(x) for x in keep])
    some = c("bucket").isNotNull()
    best = score.groupBy(key, "place").agg(F.max(F.when(some, F.struct("score", (-c("bucket")).alias("back")))).alias("b"), F.max(F.when(~some, c("total"))).alias("total"), F.max("at").alias("at"), *[F.max(x).alias(x) for x in keep])
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(0.7), c("b.score") / F.greatest(c("total") * 3, F.lit(1.0))))
    sure = c("b.score") >= LEAST_BUCKET
    return best.where("at is not null").select(key, *keep, F.when(sure, (-c("b.back") + 0.5) * BUCKET).alias("context_time"), F.when(sure, confidence).alias("context"))


def _anchored(j: DataFrame) -> DataFrame:
    """``j`` with anchor_time, confidence and source, null where neither signal places the line."""
    line = F.when(c("english") >= ANCHOR_LINE, c("english")).otherwise(F.lit(0.0))
    by_entity = (line < LINE_IS_ENOUGH) & (c("entity") >= ANCHOR_ENTITY) & (c("entity") > line)
    j = j.withColumn("source", F.when(by_entity, "entity").when(line > 0, "english"))
    pick = lambda a, b: F.when(c("source") == "entity", c(a)).when(c("source") == "english", c(b))
    return j.withColumns({"anchor_time": pick("entity_time", "english_time"), "confidence": pick("entity", "english")})


def discovered_anchors(lines: DataFrame, english: DataFrame, entity: DataFrame, key: str) -> DataFrame:
    """(key, n_id, n_start, anchor_time, confidence, source): lines placed by a sure line match, else by a better entity match."""
    j = lines.select(key, "n_id", "n_start").join(english, [key, "n_id"], "left").join(entity, [key, "n_id"], "left")
    return _anchored(j).where("source is not null").select(key, "n_id", "n_start", "anchor_time", "confidence", "source")


def timeline_signal(lines: DataFrame, movie: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, n_id, timeline_time, timeline): between the anchors on both sides, or an anchor and the start or end; by the lengths' ratio without any."""
    placed = lines.select(key, "n_id", "n_start", "n_end").join(anchors.select(key, "n_id", c("n_start").alias("a_n"), c("anchor_time").alias("a_m")), [key, "n_id"], "left")
    return timed(placed, movie, key).select(key, "n_id", "timeline_time", "timeline")


def timed(lines: DataFrame, movie: DataFrame, key: str) -> DataFrame:
    """``lines`` (n_id, n_start, n_end, and a_n, a_m where the line is an anchor) with timeline_time and timeline."""
    ends = movie.groupBy(key).agg(F.max("m_end").alias("m_len"))
    j = lines.withColumn("n_len", F.max("n_end").over(Window.partitionBy(key))).join(ends, key, "left").na.fill(0.0, ["m_len"])
    w = Window.partitionBy(key).orderBy("n_start", "n_id")
    here = F.when(c("a_n").isNotNull(), F.struct("a_n", "a_m"))
    j = j.withColumn("before", F.last(here, True).over(w)).withColumn("after", F.first(here, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    n0, m0 = F.coalesce(c("before.a_n"), F.lit(0.0)), F.coalesce(c("before.a_m"), F.lit(0.0))
    n1, m1 = F.coalesce(c("after.a_n"), c("n_len")), F.coalesce(c("after.a_m"), c("m_len"))
    none = c("before").isNull() & c("after").isNull()
    between = F.when(F.abs(n1 - n0) < 0.01, m0).otherwise(m0 + (c("n_start") - n0) / (n1 - n0) * (m1 - m0))
    time = F.when(none, c("n_start") * (c("m_len") / F.greatest("n_len", F.lit(0.1)))).otherwise(between)
    near = F.least(F.abs(c("n_start") - c("before.a_n")), F.abs(c("after.a_n") - c("n_start")))
    sure = F.when(none, F.lit(0.3)).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(0.7), 0.7 * F.exp(-near / 60.0) + 0.2)))
    return j.select(*lines.columns, F.greatest(F.lit(0.0), F.least(time, c("m_len"))).alias("timeline_time"), sure.alias("timeline"))


def matched_lines(narration: DataFrame, movie: DataFrame, aliases: DataFrame, key: str, ratio: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, n_id, english, entity, timeline, context, anchor, movie_start, movie_end, confidence, source) of every narration line.

    Anchors are found by line and entity, those that contradict the order of the others go, and what is left carries the
    timeline. Each signal is null where it says nothing; the timeline always does. The place is the signals' mean by
    weight and confidence, the confidence their mean by weight; the source is the signal that counts most. Lines without
    text are placed by timeline and context alone, lines without a key nowhere. A project's lines have ids of their own.
    """
    rest = narration.where(c(key).isNull()).select(key, "n_id")
    both = gathered(narration, movie, key)
    narration, movie = one_side(both, key, True), one_side(both, key, False)
    found = line_signal(narration, movie, key, ratio), shared_entities(both, aliases, key)
    lines = narration.select(key, "n_id", "n_start", "n_end").join(found[0], [key, "n_id"], "left").join(found[1], [key, "n_id"], "left")
    lines = _anchored(lines).drop("source")
    # A project's lines in order are one row for the chain, which is added to them, so that no signal is made twice.
    rows = F.sort_array(F.collect_list(F.struct("n_start", "n_id", *[x for x in lines.columns if x not in (key, "n_start", "n_id")])))
    rows = lines.groupBy(key).agg(rows.alias("rows")).withColumn("kept", in_increasing_subset(c("rows.anchor_time"), c("rows.confidence")))
    lines = rows.select(key, F.posexplode(F.arrays_zip("rows", "kept")).alias("place", "x")).select(key, "place", "x.rows.*", "x.kept").drop("confidence")
    lines = timed(lines.withColumns({"a_n": F.when(c("kept"), c("n_start")), "a_m": F.when(c("kept"), c("anchor_time"))}), movie, key).withColumnRenamed("a_m", "anchor")
    j = with_context(lines, key, "n_id", "n_start", "n_end", "english_time", "english", "entity_time", "entity", "timeline_time", "timeline", "anchor")
    some = lambda name, x: F.coalesce(F.when(c(name).isNotNull(), x), F.lit(0.0))
    counts = {name: some(name, w * c(name)) for name, w in WEIGHTS.items()}
    total, weight, moved = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for name, w in WEIGHTS.items():
        total, weight, moved = total + counts[name], weight + some(name, F.lit(w)), moved + some(name, c(f"{name}_time") * counts[name])
    strongest = F.greatest(*counts.values())
    source = F.coalesce(*[F.when((counts[name] == strongest) & (strongest > 0), F.lit(name)) for name in WEIGHTS])
    j = j.withColumn("movie_start", moved / total).withColumn("movie_end", c("movie_start") + F.greatest(c("n_end") - c("n_start"), F.lit(0.5)))
    j = j.select(key, "n_id", *WEIGHTS, "anchor", "movie_start", "movie_end", (total / weight).alias("confidence"), source.alias("source"))
    return j.unionByName(rest, allowMissingColumns=True)
