"""Text, time-code and vector functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import text as X
from chronoweave.functions import timecode as T
from chronoweave.functions import vectors as V
from chronoweave.plans.bindings import SEGMENT_SQL, segments
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)


def timecodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    t = F.round(c("start") * 10, 3)
    return s.select("id", T.srt(t).alias("srt"), T.ass(t).alias("ass"), T.clock(t).alias("clock"), T.clock(t, True).alias("clock_ms"))


def frame_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    t = F.round(c("start"), 3)
    return s.select("id", T.frames(t, 25).alias("truncated"), T.frames_rounded(t, 24).alias("rounded"))


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time codes written and read back."""
    s = segments(spark, sf_dir)
    t = F.floor(c("start") * 100).cast("long")
    made = F.when(c("id") % 5 == 0, F.lit("n/a")).when(c("id") % 3 == 0, T.srt(t.cast("double"))).when(c("id") % 3 == 1, F.concat((F.floor(t / 60)).cast("string"), F.lit(":"), F.lpad((t % 60).cast("string"), 2, "0"), F.lit(".5"))).otherwise(t.cast("string"))
    made = F.when((c("id") % 3 == 1) & (c("id") % 5 != 0) & (t >= 6000), F.lit("59:59.25")).otherwise(made)
    return s.select("id", F.round(T.parse_clock(made), 3).alias("seconds"))


def duration_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return d.select("doc_id", X.spoken_units(c("text"), c("lang")).cast("long").alias("n_units"), X.speech_seconds(c("text"), c("lang")).alias("seconds"), X.speech_seconds(c("text"), c("lang"), 1.25).alias("seconds_fast"))


def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    marked = F.concat(F.lit("{\\i1}"), c("text"), F.lit("\\N<b>end</b>...  done!!"))
    return d.select("doc_id", F.md5(X.clean_srt(X.clean_ass(marked))).alias("clean_md5"), F.md5(X.collapsed(marked)).alias("collapsed_md5"))


def english_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", E6(X.ascii_share(c("text"))).alias("share"), (X.ascii_share(c("text")) > 0.5).alias("english"))


def normalized_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent word trigrams of the benchmark items."""
    b = table(spark, sf_dir, "benchmark", "text").select(X.words(X.normalized(c("text"))).alias("t"))
    g = b.select(F.explode(X.ngrams(c("t"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "gram").limit(50)


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return p.select("page_id", X.safe_name(c("url"), 40).alias("name"), X.file_size(F.octet_length("html").cast("long") * (c("page_id") % 5 * 900 + 1)).alias("size"), F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"))


def compressed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("t", F.regexp_replace("text", r"\s+", " "))
    fit = X.fit_words(c("t"), 40)
    return d.select("doc_id", F.size(X.words(fit)).alias("n_words"), F.md5(fit).alias("text_md5"))


def vector_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against its label's first one."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    j = e.join(first, "label")
    mag = lambda x: F.transform(x, lambda v: F.abs(v.cast("double")))
    return j.select("vec_id", F.round(V.cosine(c("embedding"), c("head")) + 1e-9, 5).alias("cosine"), F.round(V.layout_similarity(c("embedding"), c("head")) + 1e-9, 5).alias("layout"), F.round(V.bhattacharyya(mag(c("embedding")), mag(c("head"))) + 1e-9, 4).alias("bhattacharyya"), V.hamming(V.sign_bits(c("embedding")), V.sign_bits(c("head"))).cast("long").alias("hamming"))


def cache_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    return d.select("doc_id", F.sha1(F.concat_ws("|", "source", "lang", c("n_chars").cast("string"))).alias("signature"))


def edit_list_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit list: frames of each row and the running frame it is recorded at."""
    from pyspark.sql import Window

    w = Window.partitionBy("project").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    s = segments(spark, sf_dir).where("kind <> 'non_movie'").withColumn("n", T.frames_rounded(c("dur"), 24))
    return s.select("id", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("record_in"))


QUERIES = {f.__name__: f for f in (timecodes, frame_numbers, parsed_times, duration_estimate, text_cleanup, english_share, normalized_ngrams, safe_names, compressed_text, vector_similarity, cache_signatures, edit_list_frames)}

_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"
_N = f"len(list_filter(string_split({_NORM}, ' '), lambda w: w <> ''))"
_T = lambda unit: f"floor((t - floor(t)) * {unit})::BIGINT"
_H = "floor(floor(t) / 3600)::BIGINT, floor(floor(t) / 60)::BIGINT % 60, floor(t)::BIGINT % 60"

ORACLES = {
    "timecodes": f"""WITH {SEGMENT_SQL}, x AS (SELECT id, round(start * 10, 3) AS t FROM seg)
SELECT id, printf('%02d:%02d:%02d,%03d', {_H}, {_T(1000)}) AS srt, printf('%d:%02d:%02d.%02d', {_H}, {_T(100)}) AS ass, printf('%02d:%02d:%02d', {_H}) AS clock, printf('%02d:%02d:%02d.%03d', {_H}, {_T(1000)}) AS clock_ms FROM x""",
    "frame_numbers": f"WITH {SEGMENT_SQL} SELECT id, trunc(round(start, 3) * 25)::BIGINT AS truncated, greatest(1, round_even(round(start, 3) * 24, 0)::BIGINT) AS rounded FROM seg",
    "parsed_times": f"""WITH {SEGMENT_SQL}, x AS (SELECT id, floor(start * 100)::BIGINT AS t FROM seg)
SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN t::DOUBLE WHEN id % 3 = 1 THEN CASE WHEN t >= 6000 THEN 3599.25e0 ELSE t + 0.5e0 END ELSE t::DOUBLE END AS seconds FROM x""",
    # Rates and pauses as the survey's F09 states them, written out here apart from the query's tables.
    "duration_estimate": r"""WITH u AS (SELECT doc_id, text, CASE WHEN lang = 'en' THEN len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) ELSE length(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) END AS n_units,
 CASE lang WHEN 'en' THEN 2.5e0 WHEN 'ja' THEN 5e0 WHEN 'ko' THEN 4.5e0 ELSE 4e0 END AS rate FROM documents),
m AS (SELECT * FROM (VALUES ('。', 0.4e0), ('！', 0.4e0), ('？', 0.4e0), ('.', 0.4e0), ('!', 0.4e0), ('?', 0.4e0), ('，', 0.2e0), (',', 0.2e0), ('、', 0.15e0), ('；', 0.3e0), (';', 0.3e0), ('：', 0.25e0), (':', 0.25e0), ('……', 0.5e0), ('...', 0.5e0), ('——', 0.3e0), ('--', 0.3e0)) AS v(mark, pause)),
p AS (SELECT doc_id, sum((length(text) - length(replace(text, mark, ''))) / length(mark) * pause) AS pauses FROM u, m GROUP BY doc_id)
SELECT doc_id, n_units, CASE WHEN regexp_matches(text, '\S') THEN round(n_units / rate + pauses + 1e-9, 2) ELSE 0 END AS seconds, CASE WHEN regexp_matches(text, '\S') THEN round((n_units / rate + pauses) / 1.25 + 1e-9, 2) ELSE 0 END AS seconds_fast FROM u JOIN p USING (doc_id)""",
    "text_cleanup": r"""WITH d AS (SELECT doc_id, '{\i1}' || text || '\N<b>end</b>...  done!!' AS m FROM documents)
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(m, '\{[^}]*\}', '', 'g'), '\\[Nn]', ' ', 'g')), '<[^>]*>', '', 'g'), '\{[^}]*\}', '', 'g'))) AS clean_md5,
 md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, ',{2,}', ',', 'g'), '\.{2,}', '.', 'g'), '!{2,}', '!', 'g'), '\?{2,}', '?', 'g'), '\s+', ' ', 'g'))) AS collapsed_md5 FROM d""",
    "english_share": r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS t FROM documents), s AS (SELECT doc_id, CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / length(t) ELSE 0 END AS s FROM d)
SELECT doc_id, round(s + 1e-9, 6) AS share, s > 0.5 AS english FROM s""",
    "normalized_ngrams": f"""WITH b AS (SELECT list_filter(string_split({_NORM}, ' '), lambda w: w <> '') AS t FROM benchmark),
g AS (SELECT unnest(list_transform(range(1, greatest(len(t) - 2, 1) + 1), lambda i: array_to_string(t[i:i + 2], ' '))) AS gram FROM b) SELECT gram, count(*) AS n FROM g GROUP BY gram ORDER BY n DESC, gram LIMIT 50""",
    "safe_names": r"""WITH p AS (SELECT page_id, url, strlen(html) * (page_id % 5 * 900 + 1) AS n FROM pages)
SELECT page_id, substr(regexp_replace(trim(regexp_replace(url, '[^\p{L}\p{N}._ -]', '_', 'g')), '\s+', '_', 'g'), 1, 40) AS name,
 CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024e0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576e0) ELSE printf('%.2f GB', n / 1073741824e0) END AS size,
 lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS extension FROM p""",
    "compressed_text": r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\s+', ' ', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS s FROM d),
k AS (SELECT doc_id, t, s, len(list_filter(range(1, len(s) + 1), lambda i: len(list_filter(string_split(array_to_string(s[:i], ' '), ' '), lambda w: w <> '')) <= 40)) AS k FROM s),
f AS (SELECT doc_id, CASE WHEN k > 0 THEN array_to_string(s[:k], ' ') ELSE array_to_string(list_filter(string_split(t, ' '), lambda w: w <> '')[:40], ' ') END AS f FROM k)
SELECT doc_id, len(list_filter(string_split(f, ' '), lambda w: w <> ''))::INT AS n_words, md5(f) AS text_md5 FROM f""",
    "vector_similarity": """WITH f AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS h FROM embeddings GROUP BY label), j AS (SELECT vec_id, embedding::DOUBLE[] AS e, h FROM embeddings JOIN f USING (label)),
s AS (SELECT vec_id, e, h, list_dot_product(e, h) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(h, h))) AS cs, list_sum(list_transform(range(1, len(e) + 1), lambda i: sqrt(abs(e[i]) * abs(h[i])))) AS bc,
 list_sum(list_transform(e, lambda x: abs(x))) AS se, list_sum(list_transform(h, lambda x: abs(x))) AS sh FROM j)
SELECT vec_id, round(cs + 1e-9, 5) AS cosine, round((cs + 1) / 2 + 1e-9, 5) AS layout, round(sqrt(greatest(0e0, 1 - bc / sqrt(se * sh))) + 1e-9, 4) AS bhattacharyya,
 list_sum(list_transform(range(1, 61), lambda i: CASE WHEN (e[i] > 0) <> (h[i] > 0) THEN 1 ELSE 0 END))::BIGINT AS hamming FROM s""",
    "cache_signatures": "SELECT doc_id, sha1(source || '|' || lang || '|' || n_chars) AS signature FROM documents",
    "edit_list_frames": f"""WITH {SEGMENT_SQL}, x AS (SELECT *, greatest(1, round_even(dur * 24, 0)::BIGINT) AS n FROM seg WHERE kind <> 'non_movie')
SELECT id, n, coalesce(sum(n) OVER (PARTITION BY project ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_in FROM x""",
}
