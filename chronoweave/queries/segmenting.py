"""Raw speech rows made fit for editing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators import segmenting as S
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)


def refined_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, six hundredths of a second a character and a tenth apart, with full stops as ending marks; every third turn begins a scene a quarter of a second later."""
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("text", F.translate("text", ".,", "!;"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    length = F.length("text") * 6 + F.when(c("turn") % 4 == 1, 50).otherwise(10)
    t = t.withColumn("c1", F.sum(length).over(w)).withColumn("c0", c("c1") - length)
    rows = t.select("conv_id", "turn", (c("c0") / 100).alias("start"), ((c("c1") - 10) / 100).alias("end"), F.when(c("role") == "user", "has_narration").otherwise("no_narration").alias("kind"), "text")
    borders = t.where("turn % 3 = 0").select("conv_id", ((c("c0") + 25) / 100).alias("at"))
    out = S.refined(rows, borders, "conv_id", ["turn"])
    return out.select("conv_id", "id", E6(c("start")).alias("start"), E6(c("end")).alias("stop"), "kind", F.md5("text").alias("text_md5"))


QUERIES = {f.__name__: f for f in (refined_segments,)}

_E = S.ENDINGS
_SENT = lambda t: f"CASE WHEN {t} = '' THEN [''] ELSE regexp_extract_all({t}, '[^{_E}]*[{_E}]|[^{_E}]+') END"
_BARE = lambda t: f"trim({t}, e' \\t\\n\\r')"


def _timed(name: str, source: str) -> str:
    """Pieces (list ps) of rows with their share of the time."""
    return f"""{name}_w AS (SELECT *, list_transform(ps, lambda p: greatest(1, length({_BARE('p')}))) AS ws FROM {source}),
{name}_i AS (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM {name}_w),
{name} AS (SELECT * EXCLUDE (ps, ws, start, stop, text), start + (stop - start) * (coalesce(list_sum(ws[1:i - 1]), 0) / list_sum(ws)) AS start, CASE WHEN i = len(ps) THEN stop ELSE start + (stop - start) * (list_sum(ws[1:i]) / list_sum(ws)) END AS stop, {_BARE('ps[i]')} AS text FROM {name}_i)"""


ORACLES = {
    "refined_segments": f"""WITH RECURSIVE t0 AS (SELECT conv_id, turn, role, translate(text, '.,', '!;') AS text FROM conversations), t1 AS (SELECT *, length(text) * 6 + CASE WHEN turn % 4 = 1 THEN 50 ELSE 10 END AS len FROM t0),
t AS (SELECT *, (sum(len) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS c1 FROM t1), b AS (SELECT conv_id, list_sort(list((c1 - len + 25) / 100)) AS marks FROM t WHERE turn % 3 = 0 GROUP BY conv_id),
r AS (SELECT conv_id, turn, (c1 - len) / 100 AS start, (c1 - 10) / 100 AS stop, CASE WHEN role = 'user' THEN 'has_narration' ELSE 'no_narration' END AS kind, {_BARE('text')} AS text FROM t WHERE c1 - 10 > c1 - len),
s0 AS (SELECT *, {_SENT('text')} AS ps0 FROM r), s1 AS (SELECT * EXCLUDE (ps0), CASE WHEN len(ps0) = 1 AND stop - start <= 8 THEN [text] ELSE ps0 END AS ps FROM s0), {_timed('sp', 's1')},
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS k FROM sp),
f AS (SELECT conv_id, k, start, stop, kind, text, k AS run FROM n WHERE k = 1 UNION ALL SELECT n.conv_id, n.k, CASE WHEN j THEN f.start ELSE n.start END, n.stop, n.kind, CASE WHEN j THEN {_BARE('f.text || n.text')} ELSE n.text END, CASE WHEN j THEN f.run ELSE n.k END FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1,
 LATERAL (SELECT f.kind = n.kind AND greatest(0e0, n.start - f.stop) <= 0.35 AND (f.stop - f.start < 1.2 OR n.stop - n.start < 1.2) AND n.stop - f.start <= 8 AS j) AS x),
m AS (SELECT * FROM f QUALIFY k = max(k) OVER (PARTITION BY conv_id, run)),
z AS (SELECT m.*, list_sort(list_transform(marks, lambda v: struct_pack(d := abs(v - start), v := v)))[1].v AS s, list_sort(list_transform(marks, lambda v: struct_pack(d := abs(v - stop), v := v)))[1].v AS e FROM m LEFT JOIN b USING (conv_id)),
y AS (SELECT *, CASE WHEN abs(s - start) <= 0.4 THEN s ELSE start END AS ns FROM z), sn AS (SELECT conv_id, run, kind, text, ns AS start, CASE WHEN abs(e - stop) <= 0.4 AND e <> stop THEN greatest(ns, e) ELSE stop END AS stop FROM y),
c0 AS (SELECT *, greatest(2, ceil((stop - start) / 8))::BIGINT AS n, {_SENT('text')} AS by_text FROM sn), c1 AS (SELECT *, greatest(1, ceil(length(text) / n))::BIGINT AS st FROM c0),
c2 AS (SELECT * EXCLUDE (by_text, st, n), CASE WHEN stop - start <= 8 THEN [text] WHEN len(by_text) >= n THEN by_text WHEN text = '' THEN list_transform(range(0, n), lambda q: '') ELSE list_transform(range(0, length(text), st), lambda q: substr(text, q + 1, st)) END AS ps FROM c1), {_timed('cp', 'c2')},
o AS (SELECT * FROM cp WHERE (text <> '' OR kind = 'no_narration') AND stop > start)
SELECT conv_id, printf('seg_%04d', row_number() OVER (PARTITION BY conv_id ORDER BY run, i) - 1) AS id, round(start + 1e-9, 6) AS start, round(stop + 1e-9, 6) AS stop, kind, md5(text) AS text_md5 FROM o""",
}
