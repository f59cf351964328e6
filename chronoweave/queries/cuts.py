"""Scenes, and rows split where their frames cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import cuts as C
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)
#: Frames of one film, four a second; difference of histograms of 64 points that ends a scene.
FILM, THRESHOLD = 500, 2.0
#: A row's elements as brightness, in shots of up to 18 frames that share most of it.
_SHOT = "vec_id - vec_id % (5 + vec_id // 60 % 14)"


def film_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(film, frame, time, duration, pixels, hist, edges): frames of a shot are those of its first row, a little moved by their own."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("shot", F.expr(_SHOT.replace("//", "div")))
    first = e.select(c("vec_id").alias("shot"), c("embedding").alias("base"))
    e = e.join(first, "shot").withColumn("pixels", F.transform(F.zip_with("base", "embedding", lambda a, b: a.cast("double") + b.cast("double") / 16), lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(x * 400 + 128).cast("double")))))
    hist = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.size(F.filter("pixels", lambda p: F.floor(p / 8) == k)).cast("double"))
    edges = F.transform(F.zip_with(F.slice("pixels", 1, 63), F.slice("pixels", 2, 63), lambda a, b: F.abs(a - b)), lambda x: F.when(x > 60, F.lit(255.0)).otherwise(F.lit(0.0)))
    return e.select(F.floor(c("vec_id") / FILM).alias("film"), (c("vec_id") % FILM).alias("frame"), (c("vec_id") % FILM * 0.25).alias("time"), F.lit(FILM * 0.25).alias("duration"), "pixels", hist.alias("hist"), edges.alias("edges"))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.scenes(film_frames(spark, sf_dir), "film", THRESHOLD).select("film", E6(c("start")).alias("start"), E6(c("end")).alias("stop"))


def cut_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three to six seconds, each from a tenth of a second behind every twelfth frame, split at their frames' cuts; those of label 9 stay whole."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label").where("vec_id % 12 = 0").select(F.floor(c("vec_id") / FILM).alias("film"), c("vec_id").alias("id"), (c("vec_id") % FILM * 0.25 + 0.1).alias("start"), (c("label") == 9).alias("keep"), "label")
    rows = rows.withColumn("stop", c("start") + 0.6 + c("label") * 0.6)
    out = C.split_on_cuts(rows.drop("label"), film_frames(spark, sf_dir), "film")
    return out.select("film", "id", c("part").cast("long").alias("part"), E6(c("start")).alias("start"), E6(c("stop")).alias("stop"), c("parts").cast("long").alias("parts"))


QUERIES = {f.__name__: f for f in (scenes, cut_rows)}


def _chi(a: str, b: str) -> str:
    u = lambda h: f"list_transform({h}, lambda x: x / sqrt(list_dot_product({h}, {h})))"
    return f"list_sum(list_transform(list_zip({u(a)}, {u(b)}), lambda z: CASE WHEN z[1] > 0 THEN (z[1] - z[2]) * (z[1] - z[2]) / z[1] ELSE 0e0 END))"


def _mean(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) / len({a}) / 255e0"


_FRAMES = f"""g AS (SELECT e.vec_id, list_transform(list_zip(b.embedding, e.embedding), lambda z: greatest(0e0, least(255e0, floor((z[1]::DOUBLE + z[2]::DOUBLE / 16) * 400 + 128)))) AS pixels FROM embeddings AS e JOIN embeddings AS b ON b.vec_id = ({_SHOT.replace("vec_id", "e.vec_id")})),
fr AS (SELECT vec_id // {FILM} AS film, vec_id % {FILM} AS frame, vec_id % {FILM} * 0.25e0 AS time, pixels, list_transform(range(0, 32), lambda k: len(list_filter(pixels, lambda p: floor(p / 8) = k))::DOUBLE) AS hist,
 list_transform(list_zip(pixels[1:63], pixels[2:64]), lambda z: CASE WHEN abs(z[1] - z[2]) > 60 THEN 255e0 ELSE 0e0 END) AS edges FROM g)"""
_STRONG = "hd >= 80 OR hd >= 24 AND md >= 0.12 OR md >= 0.55 OR ed >= 0.3 AND md >= 0.08 OR md >= 0.46 AND ed >= 0.22 OR stop - start >= 2.4 AND (md >= 0.22 OR md >= 0.18 AND ed >= 0.2)"

ORACLES = {
    "scenes": f"""WITH RECURSIVE {_FRAMES}, h AS (SELECT film, time, {_chi("lag(hist) OVER w", "hist")} > {THRESHOLD} AS cut FROM fr WINDOW w AS (PARTITION BY film ORDER BY time)),
k AS (SELECT film, time, row_number() OVER (PARTITION BY film ORDER BY time) AS k FROM h WHERE cut),
f AS (SELECT DISTINCT film, 0::BIGINT AS k, 0e0 AS start, NULL::DOUBLE AS closed FROM h UNION ALL SELECT f.film, f.k + 1, CASE WHEN t.time - f.start >= 1 THEN t.time ELSE f.start END, CASE WHEN t.time - f.start >= 1 THEN f.start END FROM f JOIN k AS t ON t.film = f.film AND t.k = f.k + 1)
SELECT film, round(closed + 1e-9, 6) AS start, round(start + 1e-9, 6) AS stop FROM f WHERE closed IS NOT NULL UNION ALL SELECT film, round(arg_max(start, k) + 1e-9, 6), round({FILM * 0.25} + 1e-9, 6) FROM f GROUP BY film""",
    "cut_rows": f"""WITH RECURSIVE {_FRAMES}, r0 AS (SELECT vec_id // {FILM} AS film, vec_id AS id, vec_id % {FILM} * 0.25e0 + 0.1e0 AS start, label, label = 9 AS keep FROM embeddings WHERE vec_id % 12 = 0), r AS (SELECT *, start + 0.6e0 + label * 0.6e0 AS stop FROM r0),
s0 AS (SELECT *, unnest(range(0, n + 1)) AS place FROM (SELECT *, greatest(ceil((stop - start - 0.05e0) / 0.25e0), 0)::BIGINT AS n FROM r WHERE NOT keep AND stop - start > 0.55 * 1.35)),
s AS (SELECT *, CASE WHEN place < n THEN start + place * 0.25e0 ELSE stop END AS time FROM s0), v AS (SELECT s.*, hist, pixels, edges FROM s LEFT JOIN fr ON fr.film = s.film AND fr.frame = round(greatest(0e0, s.time) / 0.25e0)::BIGINT),
b AS (SELECT *, lag(hist) OVER w AS hb, lag(pixels) OVER w AS pb, lag(edges) OVER w AS eb, lag(time) OVER w AS tb FROM v WINDOW w AS (PARTITION BY film, id ORDER BY place)),
d AS (SELECT *, {_chi("hb", "hist")} AS hd, {_mean("pb", "pixels")} AS md, {_mean("eb", "edges")} AS ed FROM b),
k AS (SELECT film, id, start, stop, CASE WHEN stop - time < 0.55 THEN tb ELSE time END AS mark, row_number() OVER (PARTITION BY film, id ORDER BY place) AS k FROM d WHERE {_STRONG}),
f AS (SELECT film, id, 0::BIGINT AS k, [start] AS kept FROM r UNION ALL SELECT f.film, f.id, f.k + 1, CASE WHEN k.mark - f.kept[-1] >= 0.55 AND k.stop - k.mark >= 0.55 THEN list_append(f.kept, k.mark) ELSE f.kept END FROM f JOIN k ON k.film = f.film AND k.id = f.id AND k.k = f.k + 1),
l AS (SELECT film, id, list_append(arg_max(kept, k), any_value(stop)) AS e FROM f JOIN r USING (film, id) GROUP BY film, id), p AS (SELECT *, unnest(range(1, len(e))) AS i FROM l)
SELECT film, id, CASE WHEN len(e) > 2 THEN i ELSE 0 END AS part, round(e[i] + 1e-9, 6) AS start, round(e[i + 1] + 1e-9, 6) AS stop, len(e) - 1 AS parts FROM p WHERE len(e) = 2 OR e[i + 1] - e[i] > 0.05""",
}
