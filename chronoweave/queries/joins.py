"""Similarity joins, searches and text matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import text as X
from chronoweave.functions import vectors as V
from chronoweave.functions.fuzzy import block_ratio
from chronoweave.functions.scoring import fuzzy_confidence
from chronoweave.operators import similarity as M
from chronoweave.operators.intervals import similar_runs
from chronoweave.tables import table

c = F.col
E6 = lambda x: F.round(x + 1e-9, 6)
MASKS = M.sampled_masks(10, 8)


def _bits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.sign_bits(c("embedding")).alias("h"))


def hamming_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different 60-bit signatures at most three bits apart, among signatures as they are and as seen again with up to three bits changed."""
    b = _bits(spark, sf_dir)
    flip = lambda k: F.expr(f"shiftleft(1L, cast(vec_id * {k} % 60 as int))")
    again = b.select(c("h").bitwiseXOR(flip(1)).bitwiseXOR(flip(7)).bitwiseXOR(flip(11)).alias("h"))
    return M.hamming_pairs(b.select("h").union(again), "h", 3).select("a", "b", c("distance").cast("long").alias("distance"))


def lsh_bucket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a bucket with a query (each id divisible by 50) and within 12 bits of it."""
    b = _bits(spark, sf_dir)
    out = M.bucket_pairs(b.where("vec_id % 50 = 0").select(c("vec_id").alias("query"), "h"), b.select(c("vec_id").alias("row"), "h"), 12, MASKS)
    return out.select("query", "row", c("distance").cast("long").alias("distance"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    out = M.nearest(e.where("vec_id % 50 = 0"), e, 10, "vec_id", "vec_id", missing=True)
    return out.select("query", "row", F.round("similarity", 5).alias("similarity"), c("rank").cast("long").alias("rank"))


def bucket_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a label's queries vote for the start that they imply."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    q = e.where("vec_id % 50 = 0")
    hits = M.nearest(q, e, 8, "vec_id", "vec_id", missing=True).join(q.select(c("vec_id").alias("query"), "label"), "query")
    hits = hits.withColumn("offset", (c("query") % 7).cast("double")).withColumn("t", c("row").cast("double"))
    out = M.bucket_vote(hits, "label", "offset", "t", "similarity", 25.0)
    return out.select("label", E6(c("bucket")).alias("bucket"), "support", F.round("mean_similarity", 5).alias("mean_similarity"))


def roundtrip_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest row of each query, and whether going back finds the query's label."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    forward = M.nearest(e.where("vec_id % 50 = 0"), e, 1, "vec_id", "vec_id", missing=True)
    label = e.select(c("vec_id").alias("row"), c("label").alias("row_label"))
    mine = e.select(c("vec_id").alias("query"), "label")
    return forward.join(label, "row").join(mine, "query").select("query", "row", (c("label") == c("row_label")).alias("consistent"), F.round(F.exp(c("similarity") - 1), 5).alias("confidence"))


def duplicate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive rows (by source and id) whose hashes are within one bit."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text").select("doc_id", "source", F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("h"))
    return similar_runs(d, "source", "doc_id", "h", 1)


#: Periods of a cycle, bits that two equal rows may differ in, and the share of a period that must be equal: fixed values.
PERIODS, CYCLE_BITS, CYCLE_SHARE = range(3, 16), 3, 0.95
#: Rows of a block of windows; each block sees a margin of the next one's rows.
CYCLE_BLOCK = 1_024


def cycle_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a second period that repeats the one before it, with the shortest such period.

    Rows follow each other by id. Each block of ids takes along the rows that its windows look at, so no window spans
    the table.
    """
    scene = F.floor(c("vec_id") / 60)
    # Scenes of 60 rows go round their first rows with a period of their own; a few bits differ, and some rows show themselves.
    shown = F.when(c("vec_id") % 50 == 0, c("vec_id")).otherwise(scene * 60 + c("vec_id") % (3 + scene % 14))
    signed = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(c("vec_id").alias("shown"), V.sign_bits(c("embedding")).alias("s"))
    e = table(spark, sf_dir, "embeddings", "vec_id").withColumn("shown", shown).join(signed, "shown").select("vec_id", c("s").bitwiseXOR(c("vec_id") % 4).alias("h"))
    reach = 2 * max(PERIODS)
    block = F.floor(c("vec_id") / CYCLE_BLOCK)
    earlier = F.floor((c("vec_id") - reach) / CYCLE_BLOCK)
    e = e.withColumn("block", F.explode(F.array_distinct(F.array(block, F.greatest(earlier, F.lit(0).cast("long"))))))
    w = Window.partitionBy("block").orderBy("vec_id")
    found = []
    for p in PERIODS:
        same = F.coalesce(F.bit_count(c("h").bitwiseXOR(F.lead("h", p).over(w))) <= CYCLE_BITS, F.lit(False)).cast("int")
        e = e.withColumn(f"same_{p}", same)
        whole = (F.lead("vec_id", 2 * p).over(w)).isNotNull()
        e = e.withColumn(f"cycle_{p}", whole & (F.sum(f"same_{p}").over(w.rowsBetween(0, p - 1)) >= CYCLE_SHARE * p))
        found.append(F.when(c(f"cycle_{p}"), F.lit(p)))
    starts = e.where(c("block") == F.floor(c("vec_id") / CYCLE_BLOCK)).select("vec_id", F.explode(F.array_compact(F.array(*found))).alias("period"))
    marked = starts.select("period", F.explode(F.sequence(c("vec_id") + c("period"), c("vec_id") + 2 * c("period") - 1)).alias("vec_id"))
    return marked.groupBy("vec_id").agg(F.min("period").cast("long").alias("period"))


def ngram_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against documents by shared word 5-, 4- and 3-grams, weighted 3, 2 and 1; the best five of each item.

    A gram is a 64-bit hash of its words' hashes; a text of fewer words is one gram of each order. Where a longer gram
    is shared, so is the 3-gram that it starts with: documents' places are held against the items' 3-grams first, and
    few go on.
    """

    def places(df: DataFrame, name: str) -> DataFrame:
        hashed = df.select(name, F.transform(X.words(X.normalized(c("text"))), lambda w: F.xxhash64(w)).alias("h")).where(F.size("h") > 0)
        five = lambda i: F.struct(*[F.get("h", i + k).alias(f"h{k}") for k in range(5)], (i == 0).alias("first"))
        at = hashed.select(name, F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - 3, F.lit(0))), five)).alias("p")).select(name, "p.*")
        return at.withColumn("g3", F.xxhash64("h0", "h1", "h2"))

    def grams(at: DataFrame, name: str) -> DataFrame:
        of_order = [F.when(c("first") | c(f"h{n - 1}").isNotNull(), F.struct(F.lit(n).alias("n"), F.xxhash64(*[f"h{k}" for k in range(n)]).alias("g"))) for n in (5, 4, 3)]
        return at.select(name, F.explode(F.array_compact(F.array(*of_order))).alias("s")).select(name, "s.n", "s.g").distinct()

    i, d = places(table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id"), places(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    near = d.join(i.select("g3").distinct(), "g3", "left_semi")
    hits = grams(near, "doc_id").join(grams(i, "item_id"), ["n", "g"]).groupBy("item_id", "doc_id").agg(F.sum(c("n") - 2).cast("long").alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5")


def line_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark lines against document lines: the five with most shared word 4-grams, then similarity and confidence.

    Equal lines are one candidate. Only lines of at most three times the query's words are compared.
    """

    def lines(df: DataFrame, *keys: str) -> DataFrame:
        one = df.select(*keys, F.explode(F.split("text", "\n")).alias("line")).withColumn("t", X.words(X.normalized(c("line"))))
        return one.where(F.size("t") >= 4).withColumn("norm", F.array_join("t", " "))

    q = lines(table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id").select("item_id", c("norm").alias("query"), c("t").alias("qt")).distinct()
    d = lines(table(spark, sf_dir, "documents", "text")).select("norm", "t").distinct()
    grams = lambda df, t, *keep: df.select(*keep, F.explode(F.array_distinct(X.ngrams(c(t), 4))).alias("g"))
    hits = grams(d, "t", "norm").join(grams(q, "qt", "item_id", "query"), "g").groupBy("item_id", "query", "norm").agg(F.count("*").alias("shared"))
    hits = hits.where(F.length("norm") <= 3 * F.length("query"))
    w = Window.partitionBy("item_id", "query").orderBy(F.desc("shared"), "norm")
    top = hits.withColumn("rank", F.row_number().over(w)).where("rank <= 5").withColumn("ratio", F.round(block_ratio("query", "norm"), 9))
    best = top.groupBy("item_id", "query").agg(F.max(F.struct("ratio", "norm")).alias("m"))
    return best.select("item_id", F.md5("query").alias("query_md5"), F.md5("m.norm").alias("line_md5"), F.round("m.ratio", 6).alias("ratio"), F.round(fuzzy_confidence(c("m.ratio")), 6).alias("confidence"))


def entity_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations by turn bucket: frequency times ln(N / (1 + buckets that hold it)); the best bucket of each word."""
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select((c("conv_id") * 10 + F.floor(c("turn") / 3)).alias("bucket"), F.explode(X.words(X.normalized(c("text")))).alias("word"))
    t = t.where(F.length("word").between(4, 50))
    tf = t.groupBy("word", "bucket").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    n = tf.agg(F.countDistinct("bucket").alias("n"))
    s = tf.join(df, "word").join(F.broadcast(n)).withColumn("score", c("tf") * F.log(c("n") / (1 + c("df"))))
    best = s.groupBy("word").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-c("bucket")).alias("b"))).alias("m"))
    return best.select("word", (-c("m.b")).alias("bucket"), F.round("m.score", 6).alias("score"))


def shared_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an item's long words that a document of its kind holds, at least 0.15; the best three of each item."""
    long_words = lambda df, name: df.select(name, F.explode(F.array_distinct(F.filter(X.words(X.normalized(c("text"))), lambda w: F.length(w) >= 9))).alias("w"))
    i, d = long_words(table(spark, sf_dir, "benchmark", "item_id", "text"), "item_id"), long_words(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    total = i.groupBy("item_id").agg(F.count("*").alias("n"))
    s = d.join(i, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("k")).join(total, "item_id").where("k >= 0.15 * n")
    w = Window.partitionBy("item_id").orderBy(F.desc(c("k") / c("n")), "doc_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").select("item_id", "doc_id", F.round(c("k") / c("n"), 6).alias("share"), "rank")


def manifest_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows found by id, else by index."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    m = o.select(F.when(c("o_orderkey") % 2 == 0, c("o_orderkey")).alias("by_id"), (c("o_orderkey") - 1).alias("by_index"))
    a = o.select(c("o_orderkey").alias("by_id"), F.round("o_totalprice", 2).alias("p1"))
    b = o.select(c("o_orderkey").alias("by_index"), F.round("o_totalprice", 2).alias("p2"))
    return m.join(a, "by_id", "left").join(b, "by_index", "left").select("by_index", F.coalesce("p1", "p2").alias("price"), F.when(c("p1").isNotNull(), "id").when(c("p2").isNotNull(), "index").otherwise("none").alias("found_by"))


QUERIES = {f.__name__: f for f in (hamming_radius, lsh_bucket_join, knn_topk, bucket_vote, roundtrip_validate, duplicate_runs, cycle_detect, ngram_match, line_match, entity_tfidf, shared_entities, manifest_resolve)}

_BITS = "b AS (SELECT vec_id, label, list_sum(list_transform(range(0, 60), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i::INT) ELSE 0 END))::BIGINT AS h FROM embeddings)"
_DOT = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_NEAR = f"""n AS (SELECT q.vec_id AS query, e.vec_id AS row, q.label, e.label AS row_label, {_DOT} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DOT}, 9) DESC, e.vec_id) AS rank
 FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)"""
_NORM = lambda t: f"trim(regexp_replace(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = lambda t: f"list_filter(string_split({_NORM(t)}, ' '), lambda w: w <> '')"
_GRAM = lambda n: f"list_transform(list_distinct(list_transform(range(1, greatest(len(t) - {n} + 1, 1) + 1), lambda i: array_to_string(t[i:i + {n} - 1], ' '))), lambda g: {{'n': {n}, 'g': g}})"
_GRAMS = f"list_concat(list_concat({_GRAM(5)}, {_GRAM(4)}), {_GRAM(3)})"

ORACLES = {
    "hamming_radius": f"""WITH {_BITS}, d AS (SELECT h FROM b UNION SELECT xor(xor(xor(h, 1::BIGINT << (vec_id % 60)::INT), 1::BIGINT << (vec_id * 7 % 60)::INT), 1::BIGINT << (vec_id * 11 % 60)::INT) FROM b)
SELECT x.h AS a, y.h AS b, bit_count(xor(x.h, y.h))::BIGINT AS distance FROM d x JOIN d y ON x.h < y.h AND bit_count(xor(x.h, y.h)) <= 3""",
    "lsh_bucket_join": f"WITH {_BITS} SELECT q.vec_id AS query, r.vec_id AS row, bit_count(xor(q.h, r.h))::BIGINT AS distance FROM b q JOIN b r ON q.vec_id % 50 = 0 AND bit_count(xor(q.h, r.h)) <= 12 AND ("
    + " OR ".join(f"(q.h & {sum(1 << b for b in m)}) = (r.h & {sum(1 << b for b in m)})" for m in MASKS) + ")",
    "knn_topk": f"WITH {_NEAR} SELECT query, row, round(round(sim, 9), 5) AS similarity, rank FROM n WHERE rank <= 10",
    "bucket_vote": f"WITH {_NEAR} SELECT label, round(round((row - query % 7) / 25e0) * 25 + 1e-9, 6) AS bucket, count(*) AS support, round(avg(round(sim, 9)), 5) AS mean_similarity FROM n WHERE rank <= 8 GROUP BY ALL",
    "roundtrip_validate": f"WITH {_NEAR} SELECT query, row, label = row_label AS consistent, round(exp(round(sim, 9) - 1), 5) AS confidence FROM n WHERE rank = 1",
    "duplicate_runs": """WITH d AS (SELECT doc_id, source, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h FROM documents),
f AS (SELECT *, CASE WHEN bit_count(xor(h, lag(h) OVER (PARTITION BY source ORDER BY doc_id))) <= 1 THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT source, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM r GROUP BY source, run""",
    "cycle_detect": """WITH sg AS (SELECT vec_id AS shown, list_sum(list_transform(range(0, 60), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::BIGINT << i::INT) ELSE 0 END))::BIGINT AS s FROM embeddings),
e AS (SELECT vec_id, xor(s, vec_id % 4) AS h FROM embeddings JOIN sg ON shown = CASE WHEN vec_id % 50 = 0 THEN vec_id ELSE vec_id // 60 * 60 + vec_id % (3 + vec_id // 60 % 14) END),
p AS (SELECT *, unnest(range(3, 16)) AS period FROM e), s AS (SELECT p.vec_id, period, CASE WHEN bit_count(xor(p.h, e.h)) <= 3 THEN 1 ELSE 0 END AS same FROM p JOIN e ON e.vec_id = p.vec_id + period),
k AS (SELECT vec_id, period, sum(same) OVER (PARTITION BY period ORDER BY vec_id ROWS BETWEEN CURRENT ROW AND period - 1 FOLLOWING) AS n FROM s),
g AS (SELECT k.* FROM k JOIN e ON e.vec_id = k.vec_id + 2 * period WHERE n >= 0.95 * period)
SELECT vec_id, min(period) AS period FROM (SELECT period, unnest(range(vec_id + period, vec_id + 2 * period)) AS vec_id FROM g) GROUP BY vec_id""",
    "ngram_match": f"""WITH it AS (SELECT item_id, {_WORDS('text')} AS t FROM benchmark), dt AS (SELECT doc_id, {_WORDS('text')} AS t FROM documents),
i AS (SELECT item_id, s.n AS n, s.g AS g FROM (SELECT item_id, unnest({_GRAMS}) AS s FROM it WHERE len(t) > 0)), d AS (SELECT doc_id, s.n AS n, s.g AS g FROM (SELECT doc_id, unnest({_GRAMS}) AS s FROM dt WHERE len(t) > 0)),
h AS (SELECT item_id, doc_id, sum(n - 2)::BIGINT AS score FROM d JOIN i USING (n, g) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM h)
SELECT * FROM r WHERE rank <= 5""",
    "entity_tfidf": f"""WITH w AS (SELECT conv_id * 10 + turn // 3 AS bucket, unnest({_WORDS('text')}) AS word FROM conversations), t AS (SELECT word, bucket, count(*) AS tf FROM w WHERE length(word) BETWEEN 4 AND 50 GROUP BY ALL),
d AS (SELECT word, count(*) AS df FROM t GROUP BY word), n AS (SELECT count(DISTINCT bucket) AS n FROM t), s AS (SELECT word, bucket, round(tf * ln(n / (1 + df)), 9) AS score FROM t JOIN d USING (word), n),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, bucket) AS rn FROM s) SELECT word, bucket, round(score, 6) AS score FROM r WHERE rn = 1""",
    "shared_entities": f"""WITH i AS (SELECT item_id, unnest(list_distinct(list_filter({_WORDS('text')}, lambda x: length(x) >= 9))) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(list_filter({_WORDS('text')}, lambda x: length(x) >= 9))) AS w FROM documents),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id), s AS (SELECT item_id, doc_id, count(*) AS k FROM d JOIN i USING (w) GROUP BY ALL), x AS (SELECT * FROM s JOIN n USING (item_id) WHERE k >= 0.15 * n),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k / n DESC, doc_id) AS rank FROM x) SELECT item_id, doc_id, round(k / n, 6) AS share, rank FROM r WHERE rank <= 3""",
    "manifest_resolve": """WITH m AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS by_id, o_orderkey - 1 AS by_index FROM orders)
SELECT m.by_index, coalesce(round(a.o_totalprice, 2), round(b.o_totalprice, 2)) AS price, CASE WHEN a.o_orderkey IS NOT NULL THEN 'id' WHEN b.o_orderkey IS NOT NULL THEN 'index' ELSE 'none' END AS found_by
FROM m LEFT JOIN orders a ON a.o_orderkey = m.by_id LEFT JOIN orders b ON b.o_orderkey = m.by_index""",
}
