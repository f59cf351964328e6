"""Refinement of segments, and rules around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators import refine as R
from chronoweave.plans.bindings import SEGMENT_SQL, segments
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)
TOLERANCE = 2.5


def scene_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of narrated rows at the nearest start of a row without narration, if within 2.5 hours."""
    s = segments(spark, sf_dir).withColumn("stop", c("start") + c("dur"))
    out = R.snapped(s.where("kind = 'has_narration'"), s.where("kind <> 'has_narration'").select("project", c("start").alias("at")), "project", "id", "start", "stop", "at", TOLERANCE)
    return out.select("id", E6(c("start")).alias("start"), E6(c("stop")).alias("stop"))


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the hours that they and up to four neighbours cover, until thirty."""
    s = segments(spark, sf_dir).select("project", "idx", "id", "start", (c("start") + c("dur")).alias("stop"), (c("kind") != "non_movie").alias("eligible"))
    out = R.context_window(s, "project", "idx", "start", "stop", "eligible", least=30.0)
    return out.select("id", E6(c("context_start")).alias("context_start"), E6(c("context_end")).alias("context_end"))


def coalesced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts named after their parent, three to a parent for two of three parents, merged over gaps of up to twelve hours; error rows are manual."""
    s = segments(spark, sf_dir).select("project", "idx", "start", (c("start") + c("dur")).alias("stop"), (c("event_type") == "error").alias("manual"), F.floor(c("idx") / 3).alias("b"))
    name = F.when(c("b") % 3 == 2, F.concat(F.lit("s"), c("b"))).otherwise(F.concat(F.lit("s"), c("b"), F.lit("_v0"), c("idx") % 3))
    out = R.coalesced_parts(s.withColumn("name", name), "project", "idx", "name", "start", "stop", "manual", r"^(.+)_[vc]\d+$", 12.0)
    return out.select("project", c("idx").cast("long").alias("idx"), "name", E6(c("start")).alias("start"), E6(c("stop")).alias("stop"), "parts")


def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations cut into pieces of speech: a word lasts 0.06 s a character and 0.08 s pass to the next, 0.7 s behind a comma."""
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    w = F.filter(F.split("text", " "), lambda x: x != "")
    gap = lambda x: F.when(x.endswith(","), 70).otherwise(8)
    # Times in hundredths, so that sums are exact.
    ends = F.aggregate(w, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(x) * 6 + gap(x))))
    words = F.transform(F.arrays_zip(w.alias("w"), ends.alias("e")), lambda z: F.struct(F.concat(z["w"], F.lit(" ")).alias("word"), ((z["e"] - gap(z["w"]) - F.length(z["w"]) * 6) / 100).alias("start"), ((z["e"] - gap(z["w"])) / 100).alias("end")))
    out = R.split_words(t.select("conv_id", "turn", words.alias("words")), ["conv_id", "turn"], "words", endings="。！？!?；;….")
    return out.select("conv_id", "turn", c("piece").cast("long").alias("piece"), F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), F.md5("text").alias("text_md5"), c("n").cast("long").alias("n"))


def sample_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows moved or split by verified samples: each row whose number divides by three is a sample of the row before it in its group of four."""
    s = segments(spark, sf_dir).select("project", "idx", "id", "start", (c("start") + c("dur")).alias("stop"), c("movie_start").alias("m"), (c("movie_start") + c("dur")).alias("m_end"))
    k = F.explode(F.sequence(F.lit(1), (c("idx") % 4).cast("int")))
    p = s.where("idx % 4 > 0").select("id", "start", "stop", k.alias("k"), (c("idx") % 4 + 1).alias("parts")).select("id", (c("start") + (c("stop") - c("start")) * c("k") / c("parts")).alias("sample"), (c("start") * 3 + c("k") * 5 - c("id") % 7).alias("source"))
    out = R.split_at_samples(s, p, "id", "start", "stop", "m", "m_end", 0.3)
    return out.select("id", c("piece").cast("long").alias("piece"), *[E6(c(x)).alias(x) for x in ("start", "stop", "m", "m_end")])


def jump_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a better candidate is accepted: by its gain, or because the row's source jumps and the candidate moves it without losing much."""
    w = Window.partitionBy("project").orderBy("idx")
    s = segments(spark, sf_dir).withColumn("jump", (c("movie_start") - F.lag("movie_start").over(w)) / 3 - (c("start") - F.lag("start").over(w)))
    score, current, shift = c("verify"), c("visual"), F.abs(c("gap") - 2) / 2
    bad = (F.abs(F.coalesce("jump", F.lit(0.0))) >= 1.2) & (shift >= 0.35) & (score >= F.greatest(F.lit(0.63), current - 0.025))
    return s.select("id", ((score >= 0.6) & ((score >= current + 0.08) | bad)).alias("accepted"))


def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a row goes next: taken as it is, looked at with its context first, or searched; by the looser rule in sequential projects."""
    s = segments(spark, sf_dir)
    # The thresholds of both rules are fixed values.
    low_info, sequential = c("gap") / 5, c("project") % 2 == 0
    direct = c("movie_start").isNotNull() & F.when(sequential, (c("visual") >= 0.80) & (c("stability") >= 0.48) & (low_info <= 0.55) & (c("temporal") >= 0.22)).otherwise((c("visual") >= 0.88) & (c("stability") >= 0.60) & (low_info <= 0.40) & (c("temporal") >= 0.50))
    context = (c("dur") <= 2.2) | ((c("dur") <= 3.0) & (c("visual") < 0.85)) | ((c("dur") <= 3.5) & (c("audio") < 0.3) & (c("visual") < 0.86))
    return s.select("id", F.when(direct, "direct").when(context, "context").otherwise("search").alias("route"))


def context_sufficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a group's two best candidates settle it: the best is firm, and leads, fits in time or is verified."""
    s = segments(spark, sf_dir).select("project", F.floor(c("idx") / 4).alias("grp"), "id", "visual", "temporal", "verify")
    best = F.row_number().over(Window.partitionBy("project", "grp").orderBy(F.desc("visual"), "id"))
    s = s.withColumn("r", best).where("r <= 2")
    of = lambda name, r: F.max(F.when(c("r") == r, c(name)))
    g = s.groupBy("project", "grp").agg(of("visual", 1).alias("v"), of("visual", 2).alias("v2"), of("temporal", 1).alias("t"), of("verify", 1).alias("y"))
    lead = F.when(c("v2").isNotNull(), c("v") - c("v2")).otherwise(F.lit(0.03))
    return g.select("project", "grp", ((c("v") >= 0.84) & ((lead >= 0.012) | (c("t") >= 0.22) | (c("y") >= 0.38))).alias("sufficient"))


def strong_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a group that are kept: the strong ones where they are a third and two at least, else the best three quarters by quality."""
    s = segments(spark, sf_dir).select("project", F.floor(c("idx") / 8).alias("grp"), "id", c("stability").alias("quality"), (c("gap") > 4).alias("low"))
    whole = Window.partitionBy("project", "grp")
    strong = (c("quality") >= 0.2) & ~c("low")
    s = s.withColumn("n", F.count("*").over(whole)).withColumn("strong", strong).withColumn("k", F.count_if("strong").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(F.desc("quality"), "id")))
    some = F.greatest(F.lit(2), F.least(c("n"), F.greatest(F.lit(3), F.floor(c("n") * 0.75))))
    keep = F.when(c("k") >= F.greatest(F.lit(2), F.floor(c("n") / 3)), c("strong")).otherwise(c("r") <= some)
    return s.where(keep).select("project", "grp", "id")


QUERIES = {f.__name__: f for f in (scene_snap, context_windows, coalesced_parts, word_pieces, sample_repairs, jump_repairs, routed_rows, context_sufficient, strong_features)}


def _turns() -> str:
    """One step of the context rule after another, as the survey words it."""
    out, last = "", "x0"
    for k in range(1, 5):
        out += f""", y{k} AS (SELECT *, go AND e - s < 30 AND n < 4 AND l{k} IS NOT NULL AS ul FROM {last}), z{k} AS (SELECT * EXCLUDE (s, n), n AS was, CASE WHEN ul THEN l{k} ELSE s END AS s, n + ul::INT AS n FROM y{k}),
u{k} AS (SELECT *, go AND e - s < 30 AND n < 4 AND r{k} IS NOT NULL AS ur FROM z{k}), x{k} AS (SELECT * EXCLUDE (e, n, go, was, ul, ur), CASE WHEN ur THEN r{k} ELSE e END AS e, n + ur::INT AS n, go AND n + ur::INT > was AS go FROM u{k})"""
        last = f"x{k}"
    return out


ORACLES = {
    "scene_snap": f"""WITH {SEGMENT_SQL}, b AS (SELECT project, list_sort(list(start)) AS b FROM seg WHERE kind <> 'has_narration' GROUP BY project),
n AS (SELECT id, start, start + dur AS stop, list_sort(list_transform(b, lambda v: struct_pack(d := abs(v - start), v := v)))[1].v AS s, list_sort(list_transform(b, lambda v: struct_pack(d := abs(v - (start + dur)), v := v)))[1].v AS e FROM seg LEFT JOIN b USING (project) WHERE kind = 'has_narration'),
m AS (SELECT *, CASE WHEN abs(s - start) <= 2.5 THEN s ELSE start END AS ns FROM n)
SELECT id, round(ns + 1e-9, 6) AS start, round(CASE WHEN abs(e - stop) <= 2.5 AND e <> stop THEN greatest(ns, e) ELSE stop END + 1e-9, 6) AS stop FROM m""",
    "context_windows": f"""WITH {SEGMENT_SQL}, x0 AS (SELECT id, start, start + dur AS stop, start AS s, start + dur AS e, 0 AS n, TRUE AS go,
 {", ".join(f"lag(CASE WHEN kind <> 'non_movie' THEN start END, {k}) OVER w AS l{k}, lead(CASE WHEN kind <> 'non_movie' THEN start + dur END, {k}) OVER w AS r{k}" for k in range(1, 5))} FROM seg WINDOW w AS (PARTITION BY project ORDER BY idx)){_turns()}
SELECT id, CASE WHEN e - s > stop - start + 0.8 THEN round(s + 1e-9, 6) END AS context_start, CASE WHEN e - s > stop - start + 0.8 THEN round(e + 1e-9, 6) END AS context_end FROM x4""",
    "coalesced_parts": f"""WITH RECURSIVE {SEGMENT_SQL}, r AS (SELECT project, idx, start, start + dur AS stop, event_type = 'error' AS manual, CASE WHEN idx // 3 % 3 = 2 THEN NULL ELSE 's' || idx // 3 END AS base,
 CASE WHEN idx // 3 % 3 = 2 THEN 's' || idx // 3 ELSE 's' || idx // 3 || '_v0' || idx % 3 END AS name FROM seg),
f AS (SELECT project, idx, start, stop, manual, base, name, 0::BIGINT AS run FROM r WHERE idx = 0
 UNION ALL SELECT r.project, r.idx, r.start, r.stop, r.manual, r.base, r.name, CASE WHEN r.base = f.base AND r.start - f.stop <= 12 THEN f.run ELSE r.idx END FROM f JOIN r ON r.project = f.project AND r.idx = f.idx + 1),
m AS (SELECT *, max(idx) FILTER (manual) OVER (PARTITION BY project, run) AS lm FROM f), g AS (SELECT *, CASE WHEN base IS NULL OR idx <= lm THEN idx ELSE -1 END AS grp FROM m)
SELECT project, min(idx) AS idx, CASE WHEN count(*) > 1 THEN any_value(base) ELSE any_value(name) END AS name, round(arg_min(start, idx) + 1e-9, 6) AS start, round(arg_max(stop, idx) + 1e-9, 6) AS stop, count(*) AS parts FROM g GROUP BY project, run, grp""",
    "word_pieces": """WITH RECURSIVE t AS (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations), k AS (SELECT conv_id, turn, w[i] AS word, i, len(w) AS n FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
g AS (SELECT *, length(word) * 6 AS d, CASE WHEN suffix(word, ',') THEN 70 ELSE 8 END AS gap FROM k), e AS (SELECT *, (sum(d + gap) OVER (PARTITION BY conv_id, turn ORDER BY i))::BIGINT AS upto FROM g),
o AS (SELECT *, (upto - gap - d) / 100 AS start, (upto - gap) / 100 AS stop, gap / 100 AS pause FROM e),
f AS (SELECT conv_id, turn, i, word, start AS first, 0::BIGINT AS piece, CASE WHEN (regexp_matches(word, '[。！？!?；;….]$') AND stop - start >= 1.2) OR i = n OR (pause >= 0.55 AND stop - start >= 1.2) OR stop - start >= 8 THEN 1 ELSE 0 END AS closes, stop FROM o WHERE i = 1
 UNION ALL SELECT o.conv_id, o.turn, o.i, o.word, x.first, f.piece + f.closes, CASE WHEN (regexp_matches(o.word, '[。！？!?；;….]$') AND o.stop - x.first >= 1.2) OR o.i = o.n OR (o.pause >= 0.55 AND o.stop - x.first >= 1.2) OR o.stop - x.first >= 8 THEN 1 ELSE 0 END, o.stop
 FROM f JOIN o ON o.conv_id = f.conv_id AND o.turn = f.turn AND o.i = f.i + 1, LATERAL (SELECT CASE WHEN f.closes = 1 THEN o.start ELSE f.first END AS first) AS x)
SELECT conv_id, turn, piece, round(min(first), 2) AS start, round(max(stop), 2) AS "end", md5(string_agg(word, ' ' ORDER BY i)) AS text_md5, count(*) AS n FROM f GROUP BY conv_id, turn, piece""",
    "sample_repairs": f"""WITH {SEGMENT_SQL}, s AS (SELECT id, idx % 4 AS parts, start, start + dur AS stop, movie_start AS m, movie_start + dur AS m_end FROM seg),
p AS (SELECT id, k, start + (stop - start) * k / (parts + 1) AS sample, start * 3 + k * 5 - id % 7 AS source FROM (SELECT *, unnest(range(1, parts + 1)) AS k FROM s)),
j AS (SELECT s.*, p.k, p.sample, p.source, lag(sample) OVER (PARTITION BY s.id ORDER BY k) AS a, lead(sample) OVER (PARTITION BY s.id ORDER BY k) AS b FROM s LEFT JOIN p ON p.id = s.id),
h AS (SELECT *, coalesce((a + sample) / 2, start) AS lo, coalesce((sample + b) / 2, stop) AS hi FROM j),
v AS (SELECT id, coalesce(k, 0) AS piece, CASE WHEN parts > 1 THEN lo ELSE start END AS start, CASE WHEN parts > 1 THEN hi ELSE stop END AS stop,
 CASE WHEN parts > 1 THEN greatest(0, source - (sample - lo)) WHEN parts = 1 AND m_end - m > 0 THEN source ELSE m END AS m, m AS m0, m_end AS e0, parts, lo, hi FROM h WHERE parts <= 1 OR hi - lo > 0.3)
SELECT id, piece, round(start + 1e-9, 6) AS start, round(stop + 1e-9, 6) AS stop, round(m + 1e-9, 6) AS m, round(CASE WHEN parts > 1 THEN m + (hi - lo) WHEN parts = 1 AND e0 - m0 > 0 THEN m + (e0 - m0) ELSE e0 END + 1e-9, 6) AS m_end FROM v""",
    "jump_repairs": f"""WITH {SEGMENT_SQL}, j AS (SELECT *, (movie_start - lag(movie_start) OVER w) / 3 - (start - lag(start) OVER w) AS jump FROM seg WINDOW w AS (PARTITION BY project ORDER BY idx))
SELECT id, CASE WHEN verify < 0.6 THEN FALSE WHEN verify >= visual + 0.08 THEN TRUE ELSE abs(coalesce(jump, 0)) >= 1.2 AND abs(gap - 2) / 2 >= 0.35 AND verify >= greatest(0.63, visual - 0.025) END AS accepted FROM j""",
    "routed_rows": f"""WITH {SEGMENT_SQL} SELECT id, CASE WHEN movie_start IS NOT NULL AND project % 2 = 0 AND visual >= 0.80 AND stability >= 0.48 AND gap / 5 <= 0.55 AND temporal >= 0.22 THEN 'direct'
 WHEN movie_start IS NOT NULL AND project % 2 = 1 AND visual >= 0.88 AND stability >= 0.60 AND gap / 5 <= 0.40 AND temporal >= 0.50 THEN 'direct'
 WHEN dur <= 2.2 OR dur <= 3.0 AND visual < 0.85 OR dur <= 3.5 AND audio < 0.3 AND visual < 0.86 THEN 'context' ELSE 'search' END AS route FROM seg""",
    "context_sufficient": f"""WITH {SEGMENT_SQL}, r AS (SELECT *, idx // 4 AS grp, row_number() OVER (PARTITION BY project, idx // 4 ORDER BY visual DESC, id) AS rn FROM seg),
g AS (SELECT project, grp, max(visual) FILTER (rn = 1) AS v, max(visual) FILTER (rn = 2) AS v2, max(temporal) FILTER (rn = 1) AS t, max(verify) FILTER (rn = 1) AS y FROM r GROUP BY ALL)
SELECT project, grp, v >= 0.84 AND (CASE WHEN v2 IS NULL THEN 0.03 ELSE v - v2 END >= 0.012 OR t >= 0.22 OR y >= 0.38) AS sufficient FROM g""",
    "strong_features": f"""WITH {SEGMENT_SQL}, r AS (SELECT project, idx // 8 AS grp, id, stability >= 0.2 AND gap <= 4 AS strong, count(*) OVER (PARTITION BY project, idx // 8) AS n, row_number() OVER (PARTITION BY project, idx // 8 ORDER BY stability DESC, id) AS rn FROM seg),
k AS (SELECT *, count(*) FILTER (strong) OVER (PARTITION BY project, grp) AS k FROM r)
SELECT project, grp, id FROM k WHERE CASE WHEN k >= greatest(2, n // 3) THEN strong ELSE rn <= greatest(2, least(n, greatest(3, floor(n * 0.75)))) END""",
}
