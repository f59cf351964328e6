import re

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import discovery as D

LINES = ["call me ishmael some years ago", "having little money in my purse", "i thought i would sail about a little", "whenever ahab grows grim about the mouth", "ahab and queequeg are at sea again", "queequeg sleeps in the harpooneer inn"]


@pytest.fixture(scope="module")
def movie(spark):
    return spark.createDataFrame([("m", i, i * 10.0, i * 10.0 + 4, t) for i, t in enumerate(LINES)], "film string, m_id int, m_start double, m_end double, text string")


def said(spark, *texts):
    return spark.createDataFrame([("m", i, i * 5.0, i * 5.0 + 3, t) for i, t in enumerate(texts)], "film string, n_id int, n_start double, n_end double, text string")


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("Ahab", "captain"), ("captain", "captain")], "alias string, name string")


def rows(df, *columns):
    return {r["n_id"]: tuple(r[c] if not isinstance(r[c], float) else round(r[c], 4) for c in columns) for r in df.collect()}


def test_word_ratio(spark):
    df = spark.createDataFrame([("a b c d", "x y"), ("a b a", "a a c"), ("a a b b", "b b a a")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(D.word_ratio(F.col("a"), F.col("b"))).collect()] == [0, 0.6667, 1]


def test_line_signal(spark, movie):
    lines = said(spark, "Having little money, in my purse!", "i would sail about a little boat of mine", "little", None, "nobody here says this")
    got = rows(D.line_signal(lines, movie, "film", D.word_ratio), "english_time", "english")
    assert got[0] == (10.0, 1.0) and got[1][0] == 20.0 and 0.6 < got[1][1] < 0.9 and set(got) == {0, 1}


def test_entities_and_their_signal(spark, movie, aliases):
    lines = said(spark, "the captain is grim", "queequeg and ahab", "about little", "sleeps")
    e = D.entities(lines, movie, aliases, "film", "n_id")
    assert sorted((r["n_id"], r["entity"], r["weight"]) for r in e.collect()) == [(0, "captain", 3.0), (1, "captain", 3.0), (1, "queequeg", 0.5), (2, "little", 0.5)]
    shown = D.entities(movie, movie, aliases, "film", "m_id", "m_start")
    got = rows(D.entity_signal(e, shown, "film"), "entity_time", "entity")
    # the captain is first in line 3, both names in line 4; a weight below one counts as one
    assert got == {0: (30.0, 1.0), 1: (40.0, 1.0), 2: (10.0, 0.5)}


def test_anchors_prefer_a_sure_line(spark):
    lines = said(spark, *"abcd")
    english = spark.createDataFrame([("m", 0, 10.0, 0.9), ("m", 1, 20.0, 0.55), ("m", 2, 30.0, 0.45)], "film string, n_id int, english_time double, english double")
    entity = spark.createDataFrame([("m", 0, 11.0, 1.0), ("m", 1, 21.0, 0.8), ("m", 2, 31.0, 0.41), ("m", 3, 41.0, 0.3)], "film string, n_id int, entity_time double, entity double")
    assert rows(D.discovered_anchors(lines, english, entity, "film"), "anchor_time", "confidence", "source") == {0: (10.0, 0.9, "english"), 1: (21.0, 0.8, "entity"), 2: (31.0, 0.41, "entity")}


def test_timeline(spark, movie):
    lines = said(spark, *"abcde")
    none = spark.createDataFrame([], "film string, n_id int, n_start double, anchor_time double")
    assert rows(D.timeline_signal(lines, movie, none, "film"), "timeline_time", "timeline")[2] == (round(10 * 54 / 23, 4), 0.3)
    two = spark.createDataFrame([("m", 1, 5.0, 10.0), ("m", 3, 15.0, 30.0)], none.schema)
    got = rows(D.timeline_signal(lines, movie, two, "film"), "timeline_time", "timeline")
    assert [got[i][0] for i in range(5)] == [0, 10, 20, 30, round(30 + 5 / 8 * 24, 4)] and got[1][1] == 0.7 and got[2][1] == 0.7  # 0.7 caps what is near


def test_fusion_takes_all_signals(spark, movie, aliases):
    lines = said(spark, LINES[0], "the captain and queequeg at sea", "nothing of it", None)
    got = {r["n_id"]: r for r in D.matched_lines(lines, movie, aliases, "film", D.word_ratio).collect()}
    assert len(got) == 4 and got[0]["source"] == "english" and got[1]["source"] == "entity" and got[3]["source"] in ("timeline", "context")
    assert got[0]["anchor"] == 0.0 and got[1]["anchor"] == 40.0 and got[2]["english"] is None and got[2]["timeline"] is not None
    r = got[1]
    assert r["movie_end"] - r["movie_start"] == pytest.approx(3) and 0 < r["confidence"] <= 1
    assert D.matched_lines(lines.limit(0), movie, aliases, "film", D.word_ratio).count() == 0
    assert D.matched_lines(lines, movie.limit(0), aliases, "film", D.word_ratio).where("source = 'timeline' and movie_start = 0").count() == 4


def test_lines_are_dealt_out_by_project_alone(spark, movie, aliases):
    # Runs of words and pairs of lines are many times the text: none of them may be dealt out anew.
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = D.matched_lines(said(spark, *LINES), movie, aliases, "film", D.word_ratio)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert dealt and all(re.fullmatch(r"film#\d+(, n_id#\d+)?", d) for d in dealt if "film" in d)


def test_entities_of_both_sides_at_once(spark, movie, aliases):
    lines = said(spark, "the captain is grim", "queequeg and ahab ahab", "about little", "sleeps", None)
    e, shown = D.entities(lines, movie, aliases, "film", "n_id"), D.entities(movie, movie, aliases, "film", "m_id", "m_start")
    found = D.shared_entities(D.gathered(lines, movie, "film"), aliases, "film")
    assert rows(found.where("entity is not null"), "entity_time", "entity") == rows(D.entity_signal(e, shown, "film"), "entity_time", "entity")
    assert rows(found, "total") == {0: (3.0,), 1: (3.5,), 2: (0.5,)}


def test_lines_without_a_project_stay(spark, movie, aliases):
    lines = said(spark, LINES[0]).union(spark.createDataFrame([(None, 7, 0.0, 1.0, LINES[0])], "film string, n_id int, n_start double, n_end double, text string"))
    got = {r["n_id"]: r for r in D.matched_lines(lines, movie, aliases, "film", D.word_ratio).collect()}
    assert got[0]["source"] == "english" and got[7]["film"] is None and got[7]["movie_start"] is None
