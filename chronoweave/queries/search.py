"""Search of shots in a source by their samples, and rules on texts and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import text as X
from chronoweave.functions import vectors as V
from chronoweave.operators import search as S
from chronoweave.plans.bindings import SEGMENT_SQL, segments
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)
SCALES = (0.95, 1.0, 1.05)
#: Elements that a row's three scales look at.
SCALE_LENGTHS = (24, 32, 48)


def _frames(spark, sf_dir) -> DataFrame:
    """A frame every half second, with quality and little content by its number."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select((c("vec_id") / 2).alias("time"), c("embedding").alias("frame"), ((c("vec_id") * 37 % 100) / 100).alias("f_quality"), (c("vec_id") % 9 == 0).alias("f_low"))


def _samples(spark, sf_dir) -> DataFrame:
    """Shots of ten seconds; each frame is a sample of its shot."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return e.select(F.floor(c("vec_id") / 20).alias("shot"), c("vec_id").alias("sample"), (c("vec_id") % 20 / 2).alias("offset"), c("embedding").alias("vector"), ((c("vec_id") * 53 % 100) / 100).alias("q_quality"), (c("vec_id") % 7 == 0).alias("q_low"))


def _starts(spark, sf_dir) -> DataFrame:
    """Five starts of each shot around its own."""
    shots = table(spark, sf_dir, "embeddings", "vec_id").select(F.floor(c("vec_id") / 20).alias("shot")).distinct()
    return shots.select("shot", F.explode(F.array(*[c("shot") * 10 + x for x in (-4.0, -1.0, 0.0, 0.25, 3.0)])).alias("start")).where("start >= 0")


def start_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of shots at given starts, at the best of three time scales."""
    samples = _samples(spark, sf_dir)
    near = S.aligned(samples, _starts(spark, sf_dir), _frames(spark, sf_dir), "shot", 0.75, SCALES)
    out = S.sequence_scores(near, samples, "shot", V.dot(c("vector"), c("frame")))
    return out.select("shot", "start", "scale", F.round("score", 5).alias("score"), "matched", F.round(c("stability") + 1e-9, 5).alias("stability"), F.round(c("low_ratio") + 1e-9, 5).alias("low_ratio"))


def shot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best start of each shot and its lead over the next one."""
    s = start_scores(spark, sf_dir)
    w = Window.partitionBy("shot").orderBy(F.desc("score"), "start")
    s = s.withColumn("r", F.row_number().over(w)).withColumn("lead", c("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return s.where("r = 1").select("shot", "start", "score", F.round("lead", 5).alias("lead"))


def identity_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _samples(spark, sf_dir)
    out = S.identity_scores(S.aligned(samples, _starts(spark, sf_dir), _frames(spark, sf_dir), "shot", 0.55), samples, "shot", F.round(V.dot(c("vector"), c("frame")), 9))
    return out.select("shot", "start", F.round("score", 5).alias("score"), F.round("mean", 5).alias("mean"), F.round("least", 5).alias("least"), "matched")


#: Names by which a thing goes, and the weight of each thing.
ALIASES = (("the", "article", 0.5), ("and", "joint", 0.5), ("of the", "genitive", 0.8), ("tion", "noun", 0.3), ("der", "article", 0.5), ("les", "article", 0.4), ("password", "secret", 1.0), ("token", "secret", 0.9))


def entity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Things that a conversation's turn names by any of their aliases, with the greatest weight."""
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    low = F.lower("text")
    named = F.array_compact(F.array(*[F.when(low.contains(a), F.struct(F.lit(n).alias("entity"), F.lit(w).alias("weight"))) for a, n, w in ALIASES]))
    return t.select("conv_id", "turn", F.explode(named).alias("n")).groupBy("conv_id", "turn", "n.entity").agg(F.max("n.weight").alias("weight"))


def window_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of entities over a turn and the three on either side."""
    e = entity_weights(spark, sf_dir)
    spread = e.select("conv_id", F.explode(F.sequence(c("turn") - 3, c("turn") + 3)).alias("turn"), "entity", "weight").groupBy("conv_id", "turn", "entity").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return spread.join(table(spark, sf_dir, "conversations", "conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi")


def rewrite_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of four rewrites of a document for its time: by the logarithm of the duration's ratio, bands of ratio and length, and phrases about the rewrite."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "n_chars").where(F.trim("text") != "")
    first = lambda share: F.array_join(F.slice(F.split("text", " "), F.lit(1), F.greatest(F.lit(1), F.floor(F.size(F.split("text", " ")) * share).cast("int"))), " ")
    made = F.array(F.lit(""), first(0.5), F.concat(F.lit("Rewritten version: "), first(0.8)), c("text"))
    d = d.select("doc_id", "text", "lang", F.posexplode(made).alias("k", "candidate")).withColumn("candidate", F.trim("candidate")).where("candidate <> ''")
    target = F.greatest(F.lit(1.0), F.length("text") / 8.0)
    ratio = F.greatest(X.polish_seconds(c("candidate"), c("lang")) / F.greatest(target, F.lit(0.1)), F.lit(0.0))
    length = F.length("candidate") / F.greatest(F.length(F.trim("text")), F.lit(1))
    score = -F.abs(F.log(F.greatest(ratio, F.lit(0.01)))) + F.when(ratio.between(0.78, 1.18), 0.7).when(ratio.between(0.65, 1.35), 0.2).otherwise(-0.8)
    score = score + F.when(length.between(0.55, 1.45), 0.3).otherwise(-F.abs(length - 1))
    # Bands, weights and phrases are fixed values.
    score = score - F.when((c("lang") == "en") & F.lower("candidate").rlike("(as a narrator|this narration|rewritten version|polished version)"), 1.0).otherwise(0.0)
    best = d.withColumn("score", F.round(score, 9)).groupBy("doc_id").agg(F.max(F.struct("score", (-c("k")).alias("k"))).alias("b"))
    return best.select("doc_id", (-c("b.k")).cast("long").alias("choice"), F.round("b.score", 5).alias("score"))


def polish_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two more estimates of speaking time: by words or dense characters, and by all characters with pauses."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return d.select("doc_id", E6(X.polish_seconds(c("text"), c("lang"))).alias("polish"), X.client_seconds(c("text")).alias("client"))


def hash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal hashes as bits, lowest first, and back."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.substring(F.md5("text"), 1, 16).alias("hex"))
    bits = V.hex_bits(c("hex"))
    return d.select("doc_id", F.array_join(bits.cast("array<string>"), "").alias("bits"), V.bits_hex(bits).alias("hex"))


def fused_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of three scales of a row, runs of its signs, fused bit by bit: softmax weights of the scales' powers vote; and how many bits the fused hash differs from that of the next row."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    signs = lambda n: F.array_join(F.transform(F.slice("embedding", 1, n), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    power = lambda n: F.round(F.aggregate(F.slice("embedding", 1, n), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 6)
    fused = e.select("vec_id", V.fused_bits([V.hex_bits(F.substring(F.md5(signs(n)), 1, 16)) for n in SCALE_LENGTHS], [power(n) for n in SCALE_LENGTHS]).alias("bits"))
    other = fused.select((c("vec_id") - 1).alias("vec_id"), c("bits").alias("next"))
    off = F.aggregate(F.zip_with("bits", "next", lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return fused.join(other, "vec_id", "left").select("vec_id", V.bits_hex(c("bits")).alias("fused"), off.alias("distance"))


def active_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a project that hold at a row's start: those without times always, the others inside theirs; clamped to the unit square."""
    s = segments(spark, sf_dir).select("project", "id", "idx", "start", "dur", "gap", "audio")
    regions = s.where("idx < 6").select("project", c("id").alias("region"), F.when(c("idx") % 3 > 0, c("start")).alias("from_time"), F.when(c("idx") % 3 > 1, c("start") + 100).alias("to_time"), (c("gap") / 4 - 0.2).alias("x"), (c("audio") * 1.3 - 0.1).alias("y"))
    box = [E6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))) for v in (c("x"), c("y"), c("x") + 0.5, c("y") + 0.2)]
    regions = regions.select("project", "region", "from_time", "to_time", *[b.alias(n) for b, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)]).where("x2 - x1 >= 0.01 and y2 - y1 >= 0.01")
    holds = (c("from_time").isNull() | (c("start") >= c("from_time"))) & (c("to_time").isNull() | (c("start") <= c("to_time")))
    return s.select("project", "id", "start").join(regions, "project").where(holds).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum((c("x2") - c("x1")) * (c("y2") - c("y1"))), 6).alias("area"))


QUERIES = {f.__name__: f for f in (start_scores, shot_search, identity_at, entity_weights, window_entities, rewrite_choice, polish_durations, hash_bits, fused_hashes, active_regions)}

_NEAR = lambda radius, scales: f"""s AS (SELECT vec_id // 20 AS shot, vec_id AS sample, vec_id % 20 / 2 AS "offset", embedding::DOUBLE[] AS v, vec_id * 53 % 100 / 100 AS qq, vec_id % 7 = 0 AS ql FROM embeddings),
f AS (SELECT vec_id / 2 AS time, embedding::DOUBLE[] AS w, vec_id * 37 % 100 / 100 AS fq, vec_id % 9 = 0 AS fl FROM embeddings),
t AS (SELECT DISTINCT vec_id // 20 AS shot FROM embeddings), a AS (SELECT shot, shot * 10 + unnest([-4e0, -1e0, 0e0, 0.25e0, 3e0]) AS start FROM t),
q AS (SELECT s.*, start, unnest([{scales}]) AS scale FROM s JOIN a USING (shot) WHERE start >= 0), n AS (SELECT q.*, f.*, list_dot_product(v, w) AS dot FROM q JOIN f ON abs(time - (start + "offset" * scale)) <= {radius}), tot AS (SELECT shot, count(*) AS total FROM s GROUP BY shot)"""  # noqa: E731
_SCORES = f"""{_NEAR(0.75, "0.95e0, 1e0, 1.05e0")}, z AS (SELECT *, dot * (0.82 + 0.18 * least(qq, fq)) AS sc FROM n), b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY shot, start, scale, sample ORDER BY sc DESC, time) = 1), p AS (SELECT * FROM b WHERE sc > 0),
g AS (SELECT shot, start, scale, list_sort(list(sc), 'DESC') AS l, count(*) AS matched, avg(qq) AS q, avg(fq) AS f, avg((fl OR ql)::INT) AS low FROM p GROUP BY ALL),
k AS (SELECT g.*, matched / total AS cov, l[:CASE WHEN matched <= 3 THEN matched ELSE greatest(2, floor(matched * 0.75)) END::BIGINT] AS top FROM g JOIN tot USING (shot)),
m AS (SELECT *, least(1, cov * 0.5 + q * 0.25 + f * 0.25) AS stab, list_avg(top) AS mean, CASE WHEN len(top) > 1 THEN list_stddev_pop(top) ELSE 0 END AS sd FROM k),
r AS (SELECT *, round(greatest(0, least(1, mean * 0.74 + top[-1] * 0.13 + cov * 0.09 + stab * 0.02 + CASE WHEN len(top) > 1 THEN 0.06 * (1 - least(1, sd / (mean + 1e-6) * 2)) ELSE 0 END - greatest(0, low - 0.25) * 0.25)), 9) AS score FROM m),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY shot, start ORDER BY score DESC, scale) = 1), start_scores AS (SELECT shot, start, scale, round(score, 5) AS score, matched, round(stab + 1e-9, 5) AS stability, round(low + 1e-9, 5) AS low_ratio FROM o)"""
_ENTITIES = f"e AS (SELECT conv_id, turn, entity, max(weight) AS weight FROM conversations JOIN (VALUES {', '.join(f'({a!r}, {n!r}, {w}e0)' for a, n, w in ALIASES)}) AS v(alias, entity, weight) ON contains(lower(text), alias) GROUP BY ALL)"
_POLISH = lambda text: f"CASE WHEN {text} = '' THEN 0 ELSE greatest(len(list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')) / 2.6e0, 0.1) END"
_BITS16 = lambda h: f"list_transform(range(0, 64), lambda i: (('0x' || substr({h}, 16 - i::INT // 4, 1))::BIGINT >> (i % 4)::INT) & 1)"
_HEX16 = lambda b: f"array_to_string(list_transform(range(0, 16), lambda j: lower(to_hex({b}[64 - 4 * j] * 8 + {b}[63 - 4 * j] * 4 + {b}[62 - 4 * j] * 2 + {b}[61 - 4 * j]))), '')"

ORACLES = {
    "start_scores": f"WITH {_SCORES} SELECT * FROM start_scores",
    "shot_search": f"WITH {_SCORES}, w AS (SELECT *, row_number() OVER x AS r, score - coalesce(lead(score) OVER x, 0) AS lead FROM start_scores WINDOW x AS (PARTITION BY shot ORDER BY score DESC, start)) SELECT shot, start, score, round(lead, 5) AS lead FROM w WHERE r = 1",
    "identity_at": f"""WITH {_NEAR(0.55, "1e0")}, b AS (SELECT shot, start, sample, max(round(dot, 9)) AS sim FROM n GROUP BY ALL), g AS (SELECT shot, start, avg(sim) AS mean, min(sim) AS least, count(*) AS matched FROM b GROUP BY ALL),
k AS (SELECT *, matched / total AS cov, greatest(0, least(1, greatest(0, least(1, (mean - 0.18) / 0.62)) * 0.9 + matched / total * 0.1)) AS sc FROM g JOIN tot USING (shot))
SELECT shot, start, round(sc * CASE WHEN cov < 0.75 THEN greatest(0.55, cov) ELSE 1 END * CASE WHEN matched >= 2 AND least < mean - 0.18 THEN 0.92 ELSE 1 END, 5) AS score, round(mean, 5) AS mean, round(least, 5) AS least, matched FROM k""",
    "entity_weights": f"WITH {_ENTITIES} SELECT * FROM e",
    "window_entities": f"WITH {_ENTITIES}, t AS (SELECT DISTINCT conv_id, turn FROM conversations) SELECT t.conv_id, t.turn, entity, round(sum(weight), 6) AS weight FROM t JOIN e ON e.conv_id = t.conv_id AND e.turn BETWEEN t.turn - 3 AND t.turn + 3 GROUP BY ALL",
    "rewrite_choice": f"""WITH d AS (SELECT doc_id, text, lang, string_split(text, ' ') AS w FROM documents WHERE trim(text, ' ') <> ''),
m AS (SELECT doc_id, text, lang, k, CASE k WHEN 0 THEN '' WHEN 1 THEN array_to_string(w[:greatest(1, floor(len(w) * 0.5))::BIGINT], ' ') WHEN 2 THEN 'Rewritten version: ' || array_to_string(w[:greatest(1, floor(len(w) * 0.8))::BIGINT], ' ') ELSE text END AS raw FROM d, range(4) AS r(k)),
x AS (SELECT *, trim(raw, ' ') AS cand FROM m WHERE trim(raw, ' ') <> ''), y AS (SELECT *, {_POLISH('cand')} / greatest(1, length(text) / 8e0) AS ratio, length(cand) / greatest(length(trim(text, ' ')), 1) AS len FROM x),
z AS (SELECT *, round(-abs(ln(greatest(ratio, 0.01))) + CASE WHEN ratio BETWEEN 0.78 AND 1.18 THEN 0.7 WHEN ratio BETWEEN 0.65 AND 1.35 THEN 0.2 ELSE -0.8 END + CASE WHEN len BETWEEN 0.55 AND 1.45 THEN 0.3 ELSE -abs(len - 1) END
 - CASE WHEN lang = 'en' AND regexp_matches(lower(cand), '(as a narrator|this narration|rewritten version|polished version)') THEN 1 ELSE 0 END, 9) AS score FROM y)
SELECT doc_id, k AS choice, round(score, 5) AS score FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) = 1""",
    "polish_durations": f"SELECT doc_id, round({_POLISH('text')} + 1e-9, 6) AS polish, round(length(text) / 4e0 + length(regexp_replace(text, '[^，。！？、；：（）\"]', '', 'g')) * 0.2e0 + 1e-9, 2) AS client FROM documents",
    "hash_bits": f"WITH d AS (SELECT doc_id, substr(md5(text), 1, 16) AS hex FROM documents) SELECT doc_id, array_to_string({_BITS16('hex')}, '') AS bits, hex FROM d",
    "fused_hashes": f"""WITH e AS (SELECT vec_id, {", ".join(f"substr(md5(array_to_string(list_transform(embedding[1:{k}], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')), 1, 16) AS h{k}, round(list_dot_product(embedding[1:{k}]::DOUBLE[], embedding[1:{k}]::DOUBLE[]), 6) AS v{k}" for k in SCALE_LENGTHS)} FROM embeddings),
x AS (SELECT *, (v24 + v32 + v48) / 3 + 1e-6 AS mv FROM e), w AS (SELECT *, exp(v24 / mv) AS e24, exp(v32 / mv) AS e32, exp(v48 / mv) AS e48 FROM x),
b AS (SELECT *, {_BITS16('h24')} AS b24, {_BITS16('h32')} AS b32, {_BITS16('h48')} AS b48 FROM w),
f AS (SELECT vec_id, list_transform(range(1, 65), lambda i: ((b24[i] * e24 + b32[i] * e32 + b48[i] * e48) / (e24 + e32 + e48) > 0.5)::INT) AS bits FROM b)
SELECT a.vec_id, {_HEX16('a.bits')} AS fused, list_sum(list_transform(list_zip(a.bits, n.bits), lambda z: (z[1] <> z[2])::INT))::BIGINT AS distance FROM f AS a LEFT JOIN f AS n ON n.vec_id = a.vec_id + 1""",
    "active_regions": f"""WITH {SEGMENT_SQL}, r AS (SELECT project, id AS region, CASE WHEN idx % 3 > 0 THEN start END AS f, CASE WHEN idx % 3 > 1 THEN start + 100 END AS t,
 {", ".join(f"round(greatest(0, least(1, {v})) + 1e-9, 6) AS {n}" for v, n in (("gap / 4 - 0.2", "x1"), ("audio * 1.3 - 0.1", "y1"), ("gap / 4 - 0.2 + 0.5", "x2"), ("audio * 1.3 - 0.1 + 0.2", "y2")))} FROM seg WHERE idx < 6)
SELECT s.id, count(*) AS n, round(sum((x2 - x1) * (y2 - y1)), 6) AS area FROM seg AS s JOIN r ON s.project = r.project AND x2 - x1 >= 0.01 AND y2 - y1 >= 0.01 AND (f IS NULL OR s.start >= f) AND (t IS NULL OR s.start <= t) GROUP BY s.id""",
}
