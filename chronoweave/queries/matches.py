"""What becomes of matches, and how alike frames are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import vectors as V
from chronoweave.operators import matches as M
from chronoweave.plans.bindings import SHOT_SQL, shots
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)


def cleared_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots as matched rows; doubtful ones lose their match, views are skipped, every seventeenth starts anew."""
    s = shots(spark, sf_dir).select("id", "event_type", c("m0").alias("movie_start"), c("m1").alias("movie_end"), c("visual").alias("visual_confidence"), c("confidence").alias("match_confidence"), F.lit("matched").alias("match_reason"), F.lit("exact").alias("match_type"), F.lit("auto_accepted").alias("alignment_status"), F.lit(False).alias("review_required"), F.lit(False).alias("skip_matching"))
    s = M.cleared(s, c("match_confidence") < 0.2, "unmatched", "no candidate")
    s = M.skipped(s, c("event_type") == "view")
    s = M.reset(s, c("id") % 17 == 0)
    return s.drop("event_type").withColumns({x: E6(c(x)) for x in ("movie_start", "movie_end", "visual_confidence", "match_confidence")})


def chunk_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of four shots, matched where the first of them is, shared out over the shots."""
    s = shots(spark, sf_dir).withColumn("chunk", c("project") * 1000 + F.floor(c("idx") / 4))
    first = s.groupBy("chunk").agg(F.min("t0").alias("c0"), F.max("t1").alias("c1"), F.min_by(F.struct("m0", "visual", "id"), "idx").alias("f"))
    n = c("f.id")
    chunks = first.select("chunk", "c0", "c1", c("f.m0").alias("start"), F.when(n % 3 == 0, (c("c1") - c("c0")) * (1 + (n % 5) / 10)).alias("length"), (0.6 + c("f.visual") / 3).alias("confidence"), (n % 7 == 0).alias("inferred"), (n % 3 == 0).alias("speed_changed"))
    out = M.shared_out(s.select("chunk", "id", "t0", "t1"), chunks, "chunk", 590.0)
    return out.select("chunk", "id", E6(c("s0")).alias("s0"), E6(c("s1")).alias("s1"), E6(c("duration_gap")).alias("duration_gap"), "temporal", "status", "review", "match_type")


def candidates_put_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's own offer put before those of its order."""
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", F.struct((c("l_partkey") % 13).alias("id"), c("l_partkey").alias("part")).alias("own")).where("l_linenumber <= 7")
    offers = t.groupBy("l_orderkey").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "own"))), lambda x: x["own"])).alias("all"))
    out = t.distinct().join(offers, "l_orderkey").select("l_orderkey", "l_linenumber", c("own.part").alias("part"), M.put_first(c("own"), c("all")).alias("now"))
    return out.select("l_orderkey", "l_linenumber", "part", F.array_join(c("now.part").cast("array<string>"), ",").alias("parts"))


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row as a frame against the next one: hashes of four runs of its signs and of all, and its elements' histogram."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    hist = F.transform(F.sequence(F.lit(-4), F.lit(3)), lambda k: F.size(F.filter("embedding", lambda x: F.least(F.greatest(F.floor(x.cast("double") * 16), F.lit(-4)), F.lit(3)) == k)).cast("double"))
    f = e.select("vec_id", F.array(*[V.sign_bits(F.slice("embedding", a, 32), 32) for a in (1, 9, 17, 33)]).alias("hash"), V.sign_bits(c("embedding")).alias("phash"), hist.alias("hist"))
    n = f.select((c("vec_id") - 1).alias("vec_id"), *[c(x).alias(f"n_{x}") for x in ("hash", "phash", "hist")])
    return f.join(n, "vec_id").select("vec_id", F.round(M.frame_score(c("hash"), c("phash"), c("hist"), c("n_hash"), c("n_phash"), c("n_hist")), 6).alias("score"))


QUERIES = {f.__name__: f for f in (cleared_matches, chunk_members, candidates_put_first, frame_scores)}

_BITS = lambda lo, n: f"list_sum(list_transform(range(0, {n}), lambda i: CASE WHEN embedding[i + {lo}] > 0 THEN (1::BIGINT << i::INT) ELSE 0 END))::BIGINT"
_CENTRED = lambda h: f"list_transform({h}, lambda x: x - list_avg({h}))"

ORACLES = {
    "cleared_matches": f"""WITH {SHOT_SQL}, c AS (SELECT *, confidence < 0.2 AS un, event_type = 'view' AS sk, id % 17 = 0 AS re FROM shot), d AS (SELECT *, un OR sk OR re AS gone FROM c)
SELECT id, CASE WHEN NOT gone THEN round(m0 + 1e-9, 6) END AS movie_start, CASE WHEN NOT gone THEN round(m1 + 1e-9, 6) END AS movie_end, CASE WHEN gone THEN 0 ELSE round(visual + 1e-9, 6) END AS visual_confidence, CASE WHEN gone THEN 0 ELSE round(confidence + 1e-9, 6) END AS match_confidence,
 CASE WHEN re THEN '' WHEN sk THEN 'Skipped from matching by user' WHEN un THEN 'no candidate' ELSE 'matched' END AS match_reason, CASE WHEN re THEN 'exact' WHEN sk OR un THEN 'fallback' ELSE 'exact' END AS match_type,
 CASE WHEN re THEN 'pending' WHEN sk THEN 'skipped' WHEN un THEN 'unmatched' ELSE 'auto_accepted' END AS alignment_status, un AND NOT sk AND NOT re AS review_required, sk AS skip_matching FROM d""",
    "chunk_members": f"""WITH {SHOT_SQL}, m AS (SELECT *, project * 1000 + idx // 4 AS chunk FROM shot), k AS (SELECT chunk, min(t0) AS c0, max(t1) AS c1, arg_min(id, idx) AS n, min(idx) AS i FROM m GROUP BY chunk),
h AS (SELECT k.*, m0 AS start, CASE WHEN n % 3 = 0 THEN (c1 - c0) * (1 + (n % 5) / 10e0) END AS length, 0.6 + visual / 3 AS conf, n % 7 = 0 AS inferred, n % 3 = 0 AS sp, greatest(0.05e0, c1 - c0) AS target FROM k JOIN m ON m.id = k.n WHERE m0 IS NOT NULL),
w AS (SELECT m.chunk, m.id, m.t0, m.t1, h.* EXCLUDE (chunk), CASE WHEN length > 0 THEN greatest(0.05e0, length) ELSE target END AS whole FROM m JOIN h USING (chunk)),
x AS (SELECT *, greatest(0.05e0, whole * ((t1 - t0) / target)) AS take, greatest(0e0, start + whole * (greatest(0e0, t0 - c0) / target)) AS a FROM w), y AS (SELECT *, CASE WHEN a + take > 590 THEN 590 ELSE a + take END AS s1, CASE WHEN a + take > 590 THEN greatest(0e0, 590 - take) ELSE a END AS s0, NOT inferred AND conf < 0.74 AS review FROM x)
SELECT chunk, id, round(s0 + 1e-9, 6) AS s0, round(s1 + 1e-9, 6) AS s1, round(abs(s1 - s0 - (t1 - t0)) + 1e-9, 6) AS duration_gap, CASE WHEN inferred THEN 0.72 ELSE 0.92 END::DOUBLE AS temporal, CASE WHEN review THEN 'needs_review' ELSE 'auto_accepted' END AS status, review,
 CASE WHEN inferred OR review THEN 'inferred' WHEN sp THEN 'speed_changed' ELSE 'exact' END AS match_type FROM y WHERE s1 > s0""",
    "candidates_put_first": """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey AS part, l_partkey % 13 AS i FROM lineitem WHERE l_linenumber <= 7), d AS (SELECT l_orderkey, part, i, min(l_linenumber) AS at_ FROM t GROUP BY ALL),
a AS (SELECT l_orderkey, list(part ORDER BY at_, i, part) AS parts FROM d GROUP BY ALL) SELECT DISTINCT l_orderkey, l_linenumber, part, array_to_string(list_prepend(part, list_filter(parts, lambda p: p % 13 <> part % 13)[1:7]), ',') AS parts FROM t JOIN a USING (l_orderkey)""",
    "frame_scores": f"""WITH f AS (SELECT vec_id, [{", ".join(_BITS(a, 32) for a in (1, 9, 17, 33))}] AS h, {_BITS(1, 60)} AS p, list_transform(range(-4, 4), lambda k: len(list_filter(embedding, lambda x: least(greatest(floor(x::DOUBLE * 16), -4), 3) = k))::DOUBLE) AS g FROM embeddings),
j AS (SELECT a.vec_id, list_sum(list_transform(list_zip(a.h, b.h), lambda z: bit_count(xor(z[1], z[2])))) AS off, bit_count(xor(a.p, b.p)) AS poff, a.g AS ga, b.g AS gb FROM f AS a JOIN f AS b ON b.vec_id = a.vec_id + 1),
k AS (SELECT *, {_CENTRED("ga")} AS za, {_CENTRED("gb")} AS zb FROM j), c AS (SELECT *, CASE WHEN list_max(ga) = list_min(ga) OR list_max(gb) = list_min(gb) THEN 1 ELSE list_dot_product(za, zb) / sqrt(list_dot_product(za, za)) / sqrt(list_dot_product(zb, zb)) END AS cor FROM k)
SELECT vec_id, round(greatest(0e0, least(1e0, (1 - off / 256e0) * 0.35 + (1 - poff / 64e0) * 0.45 + greatest(0e0, least(1e0, (cor + 1) / 2)) * 0.2)), 6) AS score FROM c""",
}
