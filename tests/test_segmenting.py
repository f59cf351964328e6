from pyspark.sql import functions as F

from chronoweave.operators import segmenting as S

KIND = "k string, n int, start double, `end` double, kind string, text string"


def shown(df, *columns):
    return sorted(tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_sentences_and_even_runs(spark):
    df = spark.createDataFrame([("Hi!! there", 2), ("", 3), (None, 2), ("abcdefg", 3), ("ab", 5)], "t string, n int")
    assert [r[0] for r in df.select(S.sentences(F.col("t"))).collect()] == [["Hi!", "!", " there"], [""], [""], ["abcdefg"], ["ab"]]
    assert [r[0] for r in df.select(S.evenly(F.col("t"), F.col("n"))).collect()] == [["Hi!! ", "there"], ["", "", ""], ["", ""], ["abc", "def", "g"], ["a", "b"]]


def test_sentences_share_the_time(spark):
    rows = spark.createDataFrame([("a", 1, 0.0, 4.0, "x", "one! two!five;"), ("a", 2, 5.0, 5.0, "x", "gone"), ("a", 3, 6.0, 8.0, "x", None), ("a", 4, 10.0, 12.0, "x", " all of it ")], KIND)
    got = shown(S.split_by_text(rows, ["k", "n"]), "n", "piece", "start", "end", "text")
    assert got == [(1, 0, 0.0, round(16 / 13, 3), "one!"), (1, 1, round(16 / 13, 3), round(32 / 13, 3), "two!"), (1, 2, round(32 / 13, 3), 4.0, "five;"), (3, 0, 6.0, 8.0, ""), (4, 0, 10.0, 12.0, "all of it")]


def test_short_rows_merge_in_turn(spark):
    rows = [("a", 1, 0.0, 1.0, "x", "a"), ("a", 2, 1.1, 2.0, "x", "b"), ("a", 3, 2.0, 5.0, "x", "c"), ("a", 4, 5.0, 5.5, "y", "d"), ("a", 5, 6.0, 6.5, "y", "e"), ("b", 1, 0.0, 0.5, "x", "f"), ("b", 2, 0.5, 8.6, "x", "g")]
    got = shown(S.merged_short(spark.createDataFrame(rows, KIND), "k", ["n"]), "k", "place", "start", "end", "text")
    # the merged first row is 2 s long, so the third stays; half a second is too wide a gap; 8.6 s would be too long
    assert got == [("a", 0, 0, 2, "ab"), ("a", 1, 2, 5, "c"), ("a", 2, 5, 5.5, "d"), ("a", 3, 6, 6.5, "e"), ("b", 0, 0, 0.5, "f"), ("b", 1, 0.5, 8.6, "g")]


def test_long_rows_are_capped(spark):
    rows = spark.createDataFrame([("a", 1, 0.0, 8.0, "x", "short!er"), ("a", 2, 0.0, 12.0, "x", "aaa!bbb!cccc"), ("a", 3, 0.0, 20.0, "x", "abcdef"), ("a", 4, 0.0, 20.0, "x", "")], KIND)
    assert shown(S.capped(rows, ["k", "n"]), "n", "part", "start", "end", "text") == [
        (1, 0, 0, 8, "short!er"), (2, 0, 0, 4, "aaa!"), (2, 1, 4, 8, "bbb!"), (2, 2, 8, 12, "cccc"),
        (3, 0, 0, 6.667, "ab"), (3, 1, 6.667, 13.333, "cd"), (3, 2, 13.333, 20, "ef"), (4, 0, 0, 6.667, ""), (4, 1, 6.667, 13.333, ""), (4, 2, 13.333, 20, ""),
    ]


def test_the_whole_pipeline(spark):
    rows = [("a", 1, 0.0, 3.0, "has_narration", "Call me so! Some!"), ("a", 2, 3.2, 4.0, "has_narration", None), ("a", 3, 4.0, 6.0, "no_narration", ""), ("a", 4, 7.0, 24.0, "has_narration", "abcdefghijkl")]
    borders = spark.createDataFrame([("a", 6.2), ("a", 99.0)], "k string, at double")
    df = spark.createDataFrame(rows, KIND)
    got = shown(S.refined(df, borders, "k", ["n"]), "id", "start", "end", "text")
    # the second sentence (1 s) and then the row without text merge into the first; the silent row snaps; the last is cut in three
    assert got == [("seg_0000", 0, 4, "Call me so!Some!"), ("seg_0001", 4, 6.2, ""), ("seg_0002", 7, 12.667, "abcd"), ("seg_0003", 12.667, 18.333, "efgh"), ("seg_0004", 18.333, 24, "ijkl")]
    assert S.refined(df.limit(0), borders, "k", ["n"]).count() == 0
    assert S.refined(df, borders.limit(0), "k", ["n"]).count() == 5


def test_the_fold_of_words_looks_at_the_array_once(spark):
    from pyspark.sql import functions as F

    from chronoweave.operators.refine import split_words

    n = 3_000  # a lookup in a filtered array at every step would take minutes
    word = lambda i: F.struct(F.when(i % 10 == 9, F.lit("end. ")).otherwise(F.lit("word ")).alias("word"), (i * 0.5).alias("start"), (i * 0.5 + 0.4).alias("end"))
    rows = spark.range(1).select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), word).alias("words"))
    got = split_words(rows, ["id"], "words", endings=".")
    assert "filter" in got._jdf.queryExecution().optimizedPlan().toString() and got._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 1
    rows = got.orderBy("piece").collect()
    assert len(rows) == n // 10 and all(r["n"] == 10 and r["text"].endswith("end.") for r in rows)
