"""Decision tables, sampling grids, plans and rankings over segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.scoring import clip, colour_similarity, prefilter
from chronoweave.operators.intervals import overlap
from chronoweave.operators.sequence import fit_line
from chronoweave.plans.bindings import SEGMENT_SQL, segments
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)
#: Levels, their pixels and costs: fixed values.
PIXEL_CLASSES = (("240p", 102_240, 10.0), ("360p", 230_400, 15.0), ("480p", 409_920, 20.0), ("720p", 921_600, 30.0), ("1080p", 2_073_600, 50.0), ("1440p", 3_686_400, 80.0), ("2160p", 8_294_400, 150.0))


def anchor_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows firm enough to lean on."""
    s = segments(spark, sf_dir)
    strong = c("movie_start").isNotNull() & (c("kind") == "has_narration") & (c("visual") >= F.when(c("id") % 2 == 0, F.lit(0.82)).otherwise(F.lit(0.85))) & (c("stability") >= 0.45)
    return s.where(strong).select("id", E6(c("visual")).alias("confidence"))


def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of four candidates whose two best are too close to call, from one ranking turned to columns."""
    w = Window.partitionBy("project", "grp").orderBy(F.desc("visual"), "id")
    s = segments(spark, sf_dir).withColumn("grp", F.floor(c("idx") / 4)).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    two = lambda col, k: F.max(F.when(c("rn") == k, c(col)))
    g = s.groupBy("project", "grp").agg(two("visual", 1).alias("v1"), two("visual", 2).alias("v2"), two("verify", 1).alias("ver1"), two("temporal", 1).alias("t1"), two("temporal", 2).alias("t2"))
    gap = c("v1") - F.coalesce("v2", F.lit(0.0))
    rule = F.when(c("v1") < 0.65, "low").when(gap < 0.02, "close").when((c("ver1") < 0.42) & (c("t1") < 0.16), "unverified").when((c("t2") > c("t1") + 0.25) & (gap < 0.05), "late").otherwise("keep")
    return g.select("project", "grp", E6(gap).alias("lead"), rule.alias("reason"))


def validation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    passes = (c("verify") >= 0.85) | ((c("dur") <= 1.35) & (c("verify") >= 0.82) & (c("stability") >= 0.86) & (c("temporal") >= 0.86))
    need = c("movie_start").isNotNull() & ((c("visual") < 0.82) | (c("rank_gap") < 0.015) | (c("stability") < 0.35))
    return s.select("id", need.alias("needs_validation"), passes.alias("passes"))


def sampling_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-point samples of each row, more of them for longer rows."""
    s = segments(spark, sf_dir)
    n = F.when(c("dur") <= 1.0, 2).when(c("dur") <= 2.0, 3).when(c("dur") <= 4.0, 4).when(c("dur") <= 6.0, 5).otherwise(6)
    s = s.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), c("n") - 1)))
    return s.select("id", "i", E6(c("start") + c("dur") * (c("i") + 0.5) / c("n")).alias("at"))


def cut_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a row and the one before it are parted by a cut."""
    w = Window.partitionBy("project").orderBy("idx")
    s = segments(spark, sf_dir).withColumn("gap_before", c("start") - F.lag(c("start") + c("dur")).over(w))
    cut = c("gap_before").isNull() | (c("gap_before") > 8) | (c("visual") < 0.25) | ((c("audio") > 0.7) & (c("stability") < 0.3))
    s = s.withColumn("cut", cut)
    grp = F.sum(F.when(c("cut"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return s.select("id", "cut", grp.alias("shot"))


def shot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row as one to three shots by its length, in whole microseconds; the last takes what rounding leaves."""
    s = segments(spark, sf_dir).where("movie_start is not null").withColumn("us", (c("dur") * 1_000_000).cast("long"))
    shares = F.when(c("dur") < 2.2, F.array(F.lit(1.0))).when(c("dur") < 5.0, F.array(F.lit(0.46), F.lit(0.54))).otherwise(F.array(F.lit(0.24), F.lit(0.34), F.lit(0.42)))
    s = s.withColumn("shares", shares).withColumn("n", F.size("shares")).select("id", "us", "n", F.posexplode("shares").alias("k", "share"))
    w = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    part = (c("us") * c("share")).cast("long")
    s = s.withColumn("offset_us", F.coalesce(F.sum(part).over(w), F.lit(0)))
    return s.select("id", "k", "offset_us", F.when(c("k") == c("n") - 1, c("us") - c("offset_us")).otherwise(part).alias("length_us"))


def export_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playback speed where a change is allowed, capped above with the source shortened; else one."""
    s = segments(spark, sf_dir)
    src, allowed = 0.3 + c("value") % 25, c("stability") >= 0.5
    speed = F.when(allowed, F.least(F.lit(2.0), src / c("dur"))).otherwise(F.lit(1.0))
    return s.select("id", E6(speed).alias("speed"), ((F.when(allowed, F.least(src, c("dur") * 2)).otherwise(c("dur")) + 1e-9) * 1_000_000).cast("long").alias("source_us"))


def verify_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read back from the reasons that carry them."""
    s = segments(spark, sf_dir)
    reason = F.when(c("id") % 3 == 0, F.lit("direct")).otherwise(F.concat(F.lit("kept; post_verify="), F.format_string("%.2f", c("verify")), F.lit("; end")))
    return s.select("id", F.regexp_extract(reason, "post_verify=([0-9.]+)", 1).try_cast("double").alias("score"))


def resolution_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pixel class of each part's size, with its cost."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("px", c("p_size").cast("long") * c("p_size") * 3_000)
    # The least of a row's own seven structs, so that rows don't become seven before they are grouped.
    near = F.array_min(F.array(*[F.struct(F.abs(c("px") - pixels).alias("off"), F.lit(pixels).cast("long").alias("pixels"), F.lit(level).alias("level"), F.lit(cost).alias("cost"), c("px")) for level, pixels, cost in PIXEL_CLASSES]))
    least = p.select("p_partkey", near.alias("m")).groupBy("p_partkey").agg(F.min("m").alias("m"))
    return least.select("p_partkey", c("m.level").alias("level"), F.round(c("m.px") / 1e6 * c("m.cost"), 6).alias("ms_per_second"))


def hash_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    base = F.when(c("visual") >= 0.8, 6).when(c("visual") >= 0.5, 8).otherwise(10)
    return s.select("id", F.least(F.lit(12), base + F.when(c("dur") < 1.5, 2).otherwise(0)).alias("threshold"))


def review_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    tag = lambda cond, name: F.when(cond, F.lit(name))
    tags = F.array_compact(F.array(tag(c("movie_start").isNull(), "unmatched"), tag(c("visual") < 0.5, "low"), tag(c("audio") < 0.1, "silent"), tag(c("dur") > 7, "long"), tag(c("id") % 17 == 0, "manual")))
    return s.select("id", F.array_join(tags, "|").alias("tags"), F.size(tags).alias("n_tags"))


def rescore_with_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group's candidates, those within 0.06 of the best (four at most) are blended with audio and ranked anew."""
    w = Window.partitionBy("project", "grp")
    s = segments(spark, sf_dir).withColumn("grp", F.floor(c("idx") / 8))
    s = s.withColumn("rn", F.row_number().over(w.orderBy(F.desc("visual"), "id"))).withColumn("best", F.max("visual").over(w))
    s = s.withColumn("rescored", (c("rn") <= 4) & (c("visual") >= c("best") - 0.06)).withColumn("score", F.round(F.when(c("rescored"), clip(0.9 * c("visual") + 0.1 * c("audio"))).otherwise(c("visual")), 9))
    return s.select("id", "rescored", E6(c("score")).alias("score"), F.row_number().over(w.orderBy(F.desc("score"), "id")).alias("rank"))


def capped_reruns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to look at again: by priority, a share of each project's rows within bounds."""
    w = Window.partitionBy("project")
    s = segments(spark, sf_dir).withColumn("n", F.count("*").over(w)).withColumn("priority", F.round(F.greatest(F.lit(0.0), 0.88 - c("visual")) + F.when(c("dur") <= 1.5, 0.25).otherwise(0.0) + F.when(c("verify") <= 0, 0.55).when(c("verify") < 0.72, 0.35).otherwise(0.0), 9))
    cap = F.least(F.lit(96), F.greatest(F.lit(3), F.ceil(c("n") * 0.12)))
    s = s.withColumn("rank", F.row_number().over(w.orderBy(F.desc("priority"), "id")))
    return s.where(c("rank") <= cap).select("id", "rank", E6(c("priority")).alias("priority"))


def sequence_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    t, ver = c("temporal"), c("verify")
    d = F.when(t >= 0.65, 0.04).when(t >= 0.35, 0.02).otherwise(0.0) + F.when((c("id") % 2 == 0) & (t >= 0.22), 0.03).otherwise(0.0)
    d = d - F.when((t < 0.08) & (ver < 0.42), F.when(c("visual") >= 0.93, 0.08).otherwise(0.14)).when((t < 0.16) & (c("rank_gap") < 0.01) & (ver < 0.40), 0.05).otherwise(0.0)
    d = d + F.when((c("rank_gap") >= 0.04) & (t >= 0.25), 0.02).otherwise(0.0)
    return s.select("id", E6(clip(c("visual") + d)).alias("score"))


def manual_edits_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows' edits carried to the new rows that overlap them most, by at least 0.45 of the shorter."""
    s = segments(spark, sf_dir).select("project", "id", "start", (c("start") + c("dur")).alias("end"))
    old = s.where("id % 4 = 0").select("project", c("id").alias("old_id"), c("start").alias("os"), c("end").alias("oe")).withColumn("b", F.explode(F.sequence(F.floor(c("os") / 10), F.floor(c("oe") / 10))))
    new = s.where("id % 4 <> 0").withColumn("b", F.explode(F.sequence(F.floor(c("start") / 10), F.floor(c("end") / 10))))
    j = new.join(old, ["project", "b"]).select("id", "old_id", F.round(overlap(c("start"), c("end"), c("os"), c("oe")) / F.least(c("end") - c("start"), c("oe") - c("os")), 9).alias("share")).where("share >= 0.45").distinct()
    best = j.groupBy("id").agg(F.max(F.struct("share", (-c("old_id")).alias("o"))).alias("m"))
    return best.select("id", (-c("m.o")).alias("old_id"), E6(c("m.share")).alias("share"))


def targets_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least score of four rows that follow each other, over those that look bad and those that are unstable; the fifty lowest."""
    s = segments(spark, sf_dir).withColumn("key", c("project") * 1000 + F.floor(c("idx") / 4))
    both = s.where("visual < 0.66").select("key", "visual").unionByName(s.where("stability < 0.1").select("key", (c("stability") + 0.05).alias("visual")))
    return both.groupBy("key").agg(E6(F.min("visual")).alias("least")).orderBy("least", "key").limit(50)


def _shots(spark, sf_dir) -> DataFrame:
    """Anchors with their shot (a new one after a day without a row), its duration and the end of the project's source."""
    w = Window.partitionBy("project").orderBy("idx")
    s = segments(spark, sf_dir).where("movie_start is not null").withColumn("movie", c("movie_start") / 3)
    s = s.withColumn("cut", F.coalesce(c("start") - F.lag(c("start") + c("dur")).over(w) > 24, F.lit(False)).cast("int"))
    s = s.withColumn("shot", c("project") * 10_000 + F.sum("cut").over(w))
    whole = Window.partitionBy("shot")
    s = s.withColumn("first", F.min("start").over(whole)).withColumn("duration", F.max(c("start") + c("dur")).over(whole) - c("first"))
    s = s.withColumn("source_end", F.max(c("movie") + c("dur")).over(Window.partitionBy("project")))
    return s.select("shot", "id", (c("start") - c("first")).alias("offset"), "movie", (1.5 * c("visual") + 1.4 * c("verify") + 0.7 * c("stability")).alias("weight"), "duration", "source_end")


def shot_line_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line through each shot's anchors, chosen by weighted inliers."""
    return fit_line(_shots(spark, sf_dir), "shot", "offset", "movie", "weight", "id", "duration", "source_end")


def shot_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a shot moved to its line where that changes their source by more than 0.18."""
    out = _shots(spark, sf_dir).join(shot_line_fit(spark, sf_dir), "shot").withColumn("planned", F.greatest(F.lit(0.0), c("speed") * c("offset") + c("intercept")))
    return out.select("id", "shot", E6(c("planned")).alias("planned"), (F.abs(c("planned") - c("movie")) > 0.18).alias("moved"))


def sequential_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row is expected in a strictly forward pass: no earlier than the last accepted start before it."""
    w = Window.partitionBy("project").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    s = segments(spark, sf_dir)
    accepted = F.max(F.when(c("movie_start").isNotNull() & (c("visual") >= 0.5), c("movie_start"))).over(w)
    expected = F.greatest(c("start") * 3, F.coalesce(accepted, F.lit(0.0)))
    return s.select("id", E6(expected).alias("expected"), E6(c("movie_start") - expected).alias("off"))


def colour_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    alike = colour_similarity([c("visual"), c("stability"), c("temporal"), c("audio"), c("verify")], c("rank_gap") * 10)
    return s.select("id", E6(alike).alias("alike"), prefilter(1 - c("visual"), c("stability")).alias("stage"))


def phase_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best offset of each row on a grid, taken when it gains enough."""
    s = segments(spark, sf_dir).where("movie_start is not null and dur between 0.5 and 3.2")
    g = s.withColumn("offset", F.explode(F.array(*[F.lit(x) for x in (-1.4, -1.05, -0.7, -0.35, -0.18, 0.0, 0.18, 0.35, 0.7, 1.05, 1.4)])))
    score = F.round(clip(c("visual") + 0.3 - F.abs(c("offset") - (c("gap") % 2 - 1)) * 0.2), 9)
    g = g.withColumn("score", score)
    b = g.groupBy("id").agg(F.max(F.struct("score", (-F.abs("offset")).alias("near"), "offset")).alias("m"), F.max(F.when(c("offset") == 0, c("score"))).alias("now"))
    gain = c("m.score") - c("now")
    taken = (F.abs("m.offset") >= 0.08) & (c("m.score") >= 0.70) & (gain >= F.when(c("now") < 0.70, 0.038).otherwise(0.050))
    return b.select("id", c("m.offset").alias("offset"), E6(c("m.score")).alias("best"), taken.alias("taken"))


QUERIES = {f.__name__: f for f in (anchor_predicate, second_pass, validation_gate, sampling_grid, cut_predicate, shot_windows, export_speed, verify_scores, resolution_profile, hash_threshold, review_tags, rescore_with_audio, capped_reruns, sequence_bias, manual_edits_kept, targets_by_score, shot_line_fit, shot_continuity, sequential_expectation, colour_prefilter, phase_grid)}

ORACLES = {
    "anchor_predicate": f"WITH {SEGMENT_SQL} SELECT id, round(visual + 1e-9, 6) AS confidence FROM seg WHERE movie_start IS NOT NULL AND kind = 'has_narration' AND visual >= CASE WHEN id % 2 = 0 THEN 0.82 ELSE 0.85 END AND stability >= 0.45",
    "second_pass": f"""WITH {SEGMENT_SQL}, r AS (SELECT *, idx // 4 AS grp, row_number() OVER (PARTITION BY project, idx // 4 ORDER BY visual DESC, id) AS rn FROM seg),
g AS (SELECT project, grp, max(visual) FILTER (rn = 1) AS v1, max(visual) FILTER (rn = 2) AS v2, max(verify) FILTER (rn = 1) AS ver1, max(temporal) FILTER (rn = 1) AS t1, max(temporal) FILTER (rn = 2) AS t2 FROM r GROUP BY ALL),
x AS (SELECT *, v1 - coalesce(v2, 0) AS gap FROM g)
SELECT project, grp, round(gap + 1e-9, 6) AS lead, CASE WHEN v1 < 0.65 THEN 'low' WHEN gap < 0.02 THEN 'close' WHEN ver1 < 0.42 AND t1 < 0.16 THEN 'unverified' WHEN t2 > t1 + 0.25 AND gap < 0.05 THEN 'late' ELSE 'keep' END AS reason FROM x""",
    "validation_gate": f"""WITH {SEGMENT_SQL} SELECT id, movie_start IS NOT NULL AND (visual < 0.82 OR rank_gap < 0.015 OR stability < 0.35) AS needs_validation,
 verify >= 0.85 OR (dur <= 1.35 AND verify >= 0.82 AND stability >= 0.86 AND temporal >= 0.86) AS passes FROM seg""",
    "sampling_grid": f"""WITH {SEGMENT_SQL}, n AS (SELECT *, CASE WHEN dur <= 1 THEN 2 WHEN dur <= 2 THEN 3 WHEN dur <= 4 THEN 4 WHEN dur <= 6 THEN 5 ELSE 6 END AS n FROM seg), e AS (SELECT *, unnest(range(0, n))::INT AS i FROM n)
SELECT id, i, round(start + dur * (i + 0.5) / n + 1e-9, 6) AS "at" FROM e""",
    "cut_predicate": f"""WITH {SEGMENT_SQL}, g AS (SELECT *, start - lag(start + dur) OVER (PARTITION BY project ORDER BY idx) AS gb FROM seg), k AS (SELECT *, gb IS NULL OR gb > 8 OR visual < 0.25 OR (audio > 0.7 AND stability < 0.3) AS cut FROM g)
SELECT id, cut, sum(cut::INT) OVER (PARTITION BY project ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS shot FROM k""",
    "shot_windows": f"""WITH {SEGMENT_SQL}, u AS (SELECT id, trunc(dur * 1000000)::BIGINT AS us, CASE WHEN dur < 2.2 THEN [1e0] WHEN dur < 5 THEN [0.46e0, 0.54e0] ELSE [0.24e0, 0.34e0, 0.42e0] END AS sh FROM seg WHERE movie_start IS NOT NULL),
e AS (SELECT id, us, len(sh) AS n, unnest(range(0, len(sh)))::INT AS k, unnest(sh) AS share FROM u),
o AS (SELECT *, trunc(us * share)::BIGINT AS part, coalesce(sum(trunc(us * share)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_us FROM e)
SELECT id, k, offset_us, CASE WHEN k = n - 1 THEN us - offset_us ELSE part END AS length_us FROM o""",
    "export_speed": f"""WITH {SEGMENT_SQL}, x AS (SELECT *, 0.3 + value % 25 AS src, stability >= 0.5 AS ok FROM seg)
SELECT id, round(CASE WHEN ok THEN least(2e0, src / dur) ELSE 1e0 END + 1e-9, 6) AS speed, trunc((CASE WHEN ok THEN least(src, dur * 2) ELSE dur END + 1e-9) * 1000000)::BIGINT AS source_us FROM x""",
    "verify_scores": f"WITH {SEGMENT_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE round(verify, 2) END AS score FROM seg",
    "resolution_profile": """WITH k AS (SELECT * FROM (VALUES ('240p', 102240, 10e0), ('360p', 230400, 15e0), ('480p', 409920, 20e0), ('720p', 921600, 30e0), ('1080p', 2073600, 50e0), ('1440p', 3686400, 80e0), ('2160p', 8294400, 150e0)) t(level, pixels, cost)),
p AS (SELECT p_partkey, p_size::BIGINT * p_size * 3000 AS px FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(px - pixels), pixels) AS rn FROM p, k)
SELECT p_partkey, level, round(px / 1e6 * cost, 6) AS ms_per_second FROM r WHERE rn = 1""",
    "hash_threshold": f"WITH {SEGMENT_SQL} SELECT id, least(12, CASE WHEN visual >= 0.8 THEN 6 WHEN visual >= 0.5 THEN 8 ELSE 10 END + CASE WHEN dur < 1.5 THEN 2 ELSE 0 END) AS threshold FROM seg",
    "review_tags": f"""WITH {SEGMENT_SQL}, t AS (SELECT id, list_filter([CASE WHEN movie_start IS NULL THEN 'unmatched' END, CASE WHEN visual < 0.5 THEN 'low' END, CASE WHEN audio < 0.1 THEN 'silent' END, CASE WHEN dur > 7 THEN 'long' END, CASE WHEN id % 17 = 0 THEN 'manual' END], lambda x: x IS NOT NULL) AS t FROM seg)
SELECT id, coalesce(array_to_string(t, '|'), '') AS tags, len(t)::INT AS n_tags FROM t""",
    "rescore_with_audio": f"""WITH {SEGMENT_SQL}, g AS (SELECT *, idx // 8 AS grp FROM seg), r AS (SELECT *, row_number() OVER (PARTITION BY project, grp ORDER BY visual DESC, id) AS rn, max(visual) OVER (PARTITION BY project, grp) AS best FROM g),
s AS (SELECT *, rn <= 4 AND visual >= best - 0.06 AS rescored FROM r), t AS (SELECT *, round(CASE WHEN rescored THEN greatest(0e0, least(1e0, 0.9 * visual + 0.1 * audio)) ELSE visual END, 9) AS sc FROM s)
SELECT id, rescored, round(sc + 1e-9, 6) AS score, row_number() OVER (PARTITION BY project, grp ORDER BY sc DESC, id)::INT AS rank FROM t""",
    "capped_reruns": f"""WITH {SEGMENT_SQL}, p AS (SELECT *, count(*) OVER (PARTITION BY project) AS n, round(greatest(0e0, 0.88 - visual) + CASE WHEN dur <= 1.5 THEN 0.25 ELSE 0 END + CASE WHEN verify <= 0 THEN 0.55 WHEN verify < 0.72 THEN 0.35 ELSE 0 END, 9) AS pr FROM seg),
r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY pr DESC, id)::INT AS rank FROM p) SELECT id, rank, round(pr + 1e-9, 6) AS priority FROM r WHERE rank <= least(96, greatest(3, ceil(n * 0.12)))""",
    "sequence_bias": f"""WITH {SEGMENT_SQL} SELECT id, round(greatest(0e0, least(1e0, visual + (CASE WHEN temporal >= 0.65 THEN 0.04 WHEN temporal >= 0.35 THEN 0.02 ELSE 0 END + CASE WHEN id % 2 = 0 AND temporal >= 0.22 THEN 0.03 ELSE 0 END
 - CASE WHEN temporal < 0.08 AND verify < 0.42 THEN CASE WHEN visual >= 0.93 THEN 0.08 ELSE 0.14 END WHEN temporal < 0.16 AND rank_gap < 0.01 AND verify < 0.4 THEN 0.05 ELSE 0 END + CASE WHEN rank_gap >= 0.04 AND temporal >= 0.25 THEN 0.02 ELSE 0 END))) + 1e-9, 6) AS score FROM seg""",
    "manual_edits_kept": f"""WITH {SEGMENT_SQL}, s AS (SELECT project, id, start AS a, start + dur AS b FROM seg),
j AS (SELECT n.id, o.id AS old_id, round(greatest(0e0, least(n.b, o.b) - greatest(n.a, o.a)) / least(n.b - n.a, o.b - o.a), 9) AS share FROM s n JOIN s o ON n.project = o.project AND n.id % 4 <> 0 AND o.id % 4 = 0 AND o.a <= n.b AND n.a <= o.b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, old_id) AS rn FROM j WHERE share >= 0.45) SELECT id, old_id, round(share + 1e-9, 6) AS share FROM r WHERE rn = 1""",
    "targets_by_score": f"""WITH {SEGMENT_SQL}, u AS (SELECT project * 1000 + idx // 4 AS key, visual FROM seg WHERE visual < 0.66 UNION ALL SELECT project * 1000 + idx // 4, stability + 0.05 FROM seg WHERE stability < 0.1)
SELECT key, round(min(visual) + 1e-9, 6) AS least FROM u GROUP BY key ORDER BY least, key LIMIT 50""",
    "sequential_expectation": f"""WITH {SEGMENT_SQL}, x AS (SELECT *, greatest(start * 3, coalesce(max(CASE WHEN visual >= 0.5 THEN movie_start END) OVER (PARTITION BY project ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS e FROM seg)
SELECT id, round(e + 1e-9, 6) AS expected, round(movie_start - e + 1e-9, 6) AS off FROM x""",
    "colour_prefilter": f"""WITH {SEGMENT_SQL} SELECT id, round(CASE WHEN rank_gap * 10 < 0.2 THEN 0.3 * visual + 0.2 * stability + 0.2 * temporal + 0.15 * audio + 0.15 * verify
 WHEN rank_gap * 10 < 0.5 THEN 0.2 * visual + 0.15 * stability + 0.2 * temporal + 0.2 * audio + 0.25 * verify ELSE 0.1 * visual + 0.1 * stability + 0.2 * temporal + 0.25 * audio + 0.35 * verify END + 1e-9, 6) AS alike,
 CASE WHEN 1 - visual > 0.35 THEN 'colour' WHEN stability < 0.55 THEN 'edge' ELSE 'pass' END AS stage FROM seg""",
    "phase_grid": f"""WITH {SEGMENT_SQL}, g AS (SELECT id, visual, gap, unnest([-1.4e0, -1.05e0, -0.7e0, -0.35e0, -0.18e0, 0e0, 0.18e0, 0.35e0, 0.7e0, 1.05e0, 1.4e0]) AS o FROM seg WHERE movie_start IS NOT NULL AND dur BETWEEN 0.5 AND 3.2),
s AS (SELECT *, round(greatest(0e0, least(1e0, visual + 0.3 - abs(o - (gap % 2 - 1)) * 0.2)), 9) AS sc FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, abs(o), o DESC) AS rn, max(sc) FILTER (o = 0) OVER (PARTITION BY id) AS now FROM s)
SELECT id, o AS "offset", round(sc + 1e-9, 6) AS best, abs(o) >= 0.08 AND sc >= 0.7 AND sc - now >= CASE WHEN now < 0.7 THEN 0.038 ELSE 0.05 END AS taken FROM r WHERE rn = 1""",
}
