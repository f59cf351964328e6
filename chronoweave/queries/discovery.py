"""Narration lines placed among a source's lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import discovery as D
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)
#: Names of the tables' invented prose and of what stands in it.
ALIASES = (("password", "secret"), ("token", "secret"), ("licensed", "licence"), ("license", "licence"), ("copyright", "licence"))


def narrated_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document's lines, four seconds each, as the source; the narration tells two of three of them anew in 3 seconds a line: word for word, in reverse, or half of it."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    movie = d.select("doc_id", c("i").cast("long").alias("m_id"), (c("i") * 4.0).alias("m_start"), (c("i") * 4.0 + 3.5).alias("m_end"), "text")
    words = F.split("text", " ")
    told = F.when(c("i") % 6 < 3, c("text")).when(c("i") % 6 == 3, F.array_join(F.reverse(words), " ")).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.floor(F.size(words) / 2).cast("int"), F.lit(1))), " "))
    narration = d.where("i % 3 < 2").select("doc_id", c("i").cast("long").alias("n_id"), (c("i") * 3.0).alias("n_start"), (c("i") * 3.0 + 2.0).alias("n_end"), told.alias("text"))
    return narration, movie


def matched_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four signals and their fusion for each line; lines are compared by their common words."""
    narration, movie = narrated_documents(spark, sf_dir)
    aliases = spark.createDataFrame(list(ALIASES), "alias string, name string")
    out = D.matched_lines(narration, movie, aliases, "doc_id", D.word_ratio)
    return out.select("doc_id", "n_id", *[E6(c(x)).alias(x) for x in ("english", "entity", "timeline", "context", "anchor", "movie_start", "movie_end", "confidence")], "source")


QUERIES = {f.__name__: f for f in (matched_lines,)}

_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}\s'']', ' ', 'g'), '\s+', ' ', 'g'))"
_GRAM = lambda n, v: f"list_transform(range(1, greatest(len(w) - {n - 1}, 1) + 1), lambda i: struct_pack(n := {n}, v := {v}, g := array_to_string(w[i:i + {n - 1}], ' ')))"
_EACH = f"list_concat({_GRAM(5, 3.0)}, list_concat({_GRAM(4, 2.0)}, {_GRAM(3, 1.0)}))"
_ENT = lambda src, keep: f"""SELECT doc_id, {keep}, entity, max(weight) AS weight FROM (
 SELECT DISTINCT w.doc_id, {keep}, entity, weight FROM (SELECT doc_id, {keep}, coalesce(name, word) AS entity FROM (SELECT doc_id, {keep}, lower(unnest(regexp_extract_all(text, '[a-zA-Z'']{{2,}}'))) AS word FROM {src}) LEFT JOIN al ON alias = word) AS w JOIN known USING (doc_id, entity)
 UNION ALL SELECT DISTINCT i.doc_id, {keep}, name, coalesce(k.weight, 0.5) FROM {src} AS i JOIN al ON contains(lower(text), alias) LEFT JOIN known AS k ON k.doc_id = i.doc_id AND k.entity = name) GROUP BY ALL"""  # noqa: E731
_STOP = ", ".join(f"'{w}'" for w in D.STOP_WORDS)

ORACLES = {
    "matched_lines": f"""WITH RECURSIVE d AS (SELECT doc_id, unnest(range(1, len(l) + 1)) - 1 AS i, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
m AS (SELECT doc_id, i AS m_id, i * 4e0 AS m_start, i * 4e0 + 3.5e0 AS m_end, text FROM d),
n AS (SELECT doc_id, i AS n_id, i * 3e0 AS n_start, i * 3e0 + 2e0 AS n_end, CASE WHEN i % 6 < 3 THEN text WHEN i % 6 = 3 THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') ELSE array_to_string(string_split(text, ' ')[1:greatest(len(string_split(text, ' ')) // 2, 1)], ' ') END AS text FROM d WHERE i % 3 < 2),
al AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in ALIASES)}) AS t(alias, name)),
learned AS (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z'']{{2,}}'))) AS word FROM m) WHERE length(word) >= 3 AND word NOT IN ({_STOP}) GROUP BY ALL HAVING count(*) >= 2),
known AS (SELECT doc_id, coalesce(name, word) AS entity, max(CASE WHEN name IS NOT NULL THEN 3.0 ELSE 0.5 END)::DOUBLE AS weight FROM learned LEFT JOIN al ON alias = word WHERE name IS NOT NULL OR times <= 50 GROUP BY ALL),
said AS ({_ENT("n", "n_id")}), shown AS ({_ENT("m", "m_id, m_start")}),
nw AS (SELECT doc_id, n_id, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS w FROM n), mw AS (SELECT doc_id, m_id, m_start, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS w FROM m),
hit AS (SELECT a.doc_id, n_id, m_id, sum(a.s.v) AS shared FROM (SELECT doc_id, n_id, unnest({_EACH}) AS s FROM nw WHERE len(w) >= 2) AS a JOIN (SELECT doc_id, m_id, unnest({_EACH}) AS s FROM mw WHERE len(w) > 0) AS b ON a.doc_id = b.doc_id AND a.s.n = b.s.n AND a.s.g = b.s.g GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n_id ORDER BY shared DESC, m_id) AS rank FROM hit QUALIFY rank <= 5),
rat AS (SELECT t.*, mw.m_start, round(2e0 * list_sum(list_transform(list_distinct(nw.w), lambda x: least(len(list_filter(nw.w, lambda y: y = x)), len(list_filter(mw.w, lambda y: y = x))))) / (len(nw.w) + len(mw.w)), 9) AS r FROM top AS t JOIN nw USING (doc_id, n_id) JOIN mw ON mw.doc_id = t.doc_id AND mw.m_id = t.m_id),
eng AS (SELECT doc_id, n_id, m_start AS english_time, least(1e0, CASE WHEN r >= 0.8 THEN 0.9 + (r - 0.8) * 0.5 WHEN r >= 0.6 THEN 0.6 + (r - 0.6) * 1.5 ELSE 0.3 + (r - 0.4) * 1.5 END) AS english FROM (SELECT * FROM rat QUALIFY row_number() OVER (PARTITION BY doc_id, n_id ORDER BY r DESC, rank) = 1) WHERE r >= 0.4),
tot AS (SELECT doc_id, n_id, sum(weight) AS total FROM said GROUP BY ALL),
sh AS (SELECT a.doc_id, a.n_id, m_id, m_start, least(1e0, sum(a.weight) / greatest(any_value(total), 1)) AS share FROM said AS a JOIN shown AS b ON a.doc_id = b.doc_id AND a.entity = b.entity JOIN tot ON tot.doc_id = a.doc_id AND tot.n_id = a.n_id GROUP BY a.doc_id, a.n_id, m_id, m_start HAVING share >= 0.15),
ent AS (SELECT doc_id, n_id, m_start AS entity_time, share AS entity FROM sh QUALIFY row_number() OVER (PARTITION BY doc_id, n_id ORDER BY share DESC, m_id) = 1),
an0 AS (SELECT n.doc_id, n.n_id, n.n_start, english_time, entity_time, entity, english, CASE WHEN english >= 0.5 THEN english ELSE 0 END AS line FROM n LEFT JOIN eng USING (doc_id, n_id) LEFT JOIN ent USING (doc_id, n_id)),
an AS (SELECT *, CASE WHEN line < 0.7 AND entity >= 0.4 AND entity > line THEN 'entity' WHEN line > 0 THEN 'english' END AS src FROM an0),
o AS (SELECT doc_id, n_id, n_start, CASE WHEN src = 'entity' THEN entity_time ELSE english_time END AS movie, CASE WHEN src = 'entity' THEN entity ELSE english END AS conf, row_number() OVER (PARTITION BY doc_id ORDER BY n_start, n_id) AS rn FROM an WHERE src IS NOT NULL),
f AS (SELECT doc_id, 1::BIGINT AS rn, [1e0] AS best, [movie] AS vals, [0::BIGINT] AS back FROM o WHERE rn = 1
 UNION ALL SELECT f.doc_id, o.rn, list_append(f.best, greatest(1e0, y.reach)), list_append(f.vals, o.movie), list_append(f.back, CASE WHEN y.reach > 1 THEN y.at_ ELSE 0 END)
 FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1, LATERAL (SELECT list_transform(range(1, len(f.best) + 1), lambda i: CASE WHEN f.vals[i] < o.movie THEN f.best[i] + (1 + 0.1e0 * o.conf) ELSE -1e9 END) AS r) AS x, LATERAL (SELECT list_max(x.r) AS reach, list_position(x.r, list_max(x.r))::BIGINT AS at_) AS y),
l AS (SELECT doc_id, arg_max(best, rn) AS best, arg_max(back, rn) AS back FROM f GROUP BY doc_id),
ch AS (SELECT doc_id, list_position(best, list_max(best))::BIGINT AS rn, back FROM l UNION ALL SELECT doc_id, back[rn], back FROM ch WHERE back[rn] > 0),
k AS (SELECT o.doc_id, o.n_id, o.n_start AS a_n, o.movie AS a_m FROM ch JOIN o USING (doc_id, rn)),
en AS (SELECT doc_id, max(n_end) AS n_len FROM n GROUP BY doc_id), em AS (SELECT doc_id, max(m_end) AS m_len FROM m GROUP BY doc_id),
ti AS (SELECT n.doc_id, n.n_id, n.n_start, n_len, m_len, last(CASE WHEN a_n IS NOT NULL THEN {{'n': a_n, 'm': a_m}} END IGNORE NULLS) OVER (PARTITION BY n.doc_id ORDER BY n.n_start, n.n_id ROWS UNBOUNDED PRECEDING) AS b,
 first(CASE WHEN a_n IS NOT NULL THEN {{'n': a_n, 'm': a_m}} END IGNORE NULLS) OVER (PARTITION BY n.doc_id ORDER BY n.n_start, n.n_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM n LEFT JOIN k USING (doc_id, n_id) JOIN en USING (doc_id) JOIN em USING (doc_id)),
tv AS (SELECT *, coalesce(b.n, 0) AS n0, coalesce(b.m, 0) AS m0, coalesce(a.n, n_len) AS n1, coalesce(a.m, m_len) AS m1, a IS NULL AND b IS NULL AS none FROM ti),
tl AS (SELECT doc_id, n_id, greatest(0e0, least(CASE WHEN none THEN n_start * (m_len / greatest(n_len, 0.1)) WHEN abs(n1 - n0) < 0.01 THEN m0 ELSE m0 + (n_start - n0) / (n1 - n0) * (m1 - m0) END, m_len)) AS timeline_time,
 CASE WHEN none THEN 0.3 ELSE greatest(0.2e0, least(0.7e0, 0.7 * exp(-least(abs(n_start - b.n), abs(a.n - n_start)) / 60e0) + 0.2)) END AS timeline FROM tv),
cnt AS (SELECT doc_id, floor(m_start / 30) AS bucket, entity, count(*) AS times FROM shown GROUP BY ALL), nb AS (SELECT doc_id, count(DISTINCT floor(m_start / 30)) AS buckets FROM m GROUP BY doc_id),
rar AS (SELECT doc_id, entity, ln(any_value(buckets) / (1 + count(*))) AS rarity FROM cnt JOIN nb USING (doc_id) GROUP BY ALL),
pl AS (SELECT doc_id, n_id, row_number() OVER (PARTITION BY doc_id ORDER BY n_start, n_id) AS place FROM n),
ar AS (SELECT doc_id, place, entity, sum(weight) AS weight FROM (SELECT doc_id, entity, weight, unnest(range(place - 3, place + 4)) AS place FROM said JOIN pl USING (doc_id, n_id)) GROUP BY ALL), at_ AS (SELECT doc_id, place, sum(weight) AS total FROM ar GROUP BY ALL),
sc AS (SELECT doc_id, place, bucket, round(sum(weight * rarity * times), 9) AS score FROM ar JOIN rar USING (doc_id, entity) JOIN cnt USING (doc_id, entity) GROUP BY ALL),
cx AS (SELECT doc_id, n_id, (bucket + 0.5) * 30 AS context_time, greatest(0.1e0, least(0.7e0, score / greatest(total * 3, 1))) AS context FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id, place ORDER BY score DESC, bucket) = 1) JOIN at_ USING (doc_id, place) JOIN pl USING (doc_id, place) WHERE score >= 0.5),
z AS (SELECT n.doc_id, n.n_id, n_end - n_start AS dur, english_time, english, entity_time, entity, timeline_time, timeline, context_time, context, a_m AS anchor, coalesce(0.45 * english, 0) AS e1, coalesce(0.25 * entity, 0) AS e2, coalesce(0.15 * timeline, 0) AS e3, coalesce(0.15 * context, 0) AS e4
 FROM n LEFT JOIN eng USING (doc_id, n_id) LEFT JOIN ent USING (doc_id, n_id) LEFT JOIN tl USING (doc_id, n_id) LEFT JOIN cx USING (doc_id, n_id) LEFT JOIN k USING (doc_id, n_id)),
y AS (SELECT *, 0e0 + e1 + e2 + e3 + e4 AS total, 0e0 + CASE WHEN english IS NULL THEN 0 ELSE 0.45 END + CASE WHEN entity IS NULL THEN 0 ELSE 0.25 END + CASE WHEN timeline IS NULL THEN 0 ELSE 0.15 END + CASE WHEN context IS NULL THEN 0 ELSE 0.15 END AS weight,
 (0e0 + coalesce(english_time * e1, 0) + coalesce(entity_time * e2, 0) + coalesce(timeline_time * e3, 0) + coalesce(context_time * e4, 0)) AS moved FROM z)
SELECT doc_id, n_id, {", ".join(f"round({x} + 1e-9, 6) AS {x}" for x in ("english", "entity", "timeline", "context", "anchor"))}, round(moved / total + 1e-9, 6) AS movie_start, round(moved / total + greatest(dur, 0.5) + 1e-9, 6) AS movie_end, round(total / weight + 1e-9, 6) AS confidence,
 CASE greatest(e1, e2, e3, e4) WHEN e1 THEN 'english' WHEN e2 THEN 'entity' WHEN e3 THEN 'timeline' ELSE 'context' END AS source FROM y""",
}
