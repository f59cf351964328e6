"""Each query against its SQL on the smallest tables."""

import math
import os
import statistics

import duckdb
import pandas as pd
import pytest

from chronoweave.queries import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        df[c] = df[c].map(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sql, name):
    got, want = plain(registry.queries()[name](spark, SF).toPandas()), plain(sql.sql(registry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert got.equals(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql(spark, name):
    """The operators behind these are held against plain versions in test_sequence.py and below; here: rows, and as many counted as collected."""
    out = registry.queries()[name](spark, SF)
    rows = out.collect()
    assert rows and out.count() == len(rows)


def test_every_segment_is_aligned_once(spark):
    from chronoweave.plans.bindings import segments

    got = registry.queries()["viterbi_align"](spark, SF)
    assert got.select("project", "segment").distinct().count() == got.count() == segments(spark, SF).count()
    assert got.groupBy("project").agg({"total": "max"}).count() == got.select("project", "total").distinct().count()


def test_dct_hashes_match_plain_sums(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(12).collect()
    got = {r["vec_id"]: r["h"] for r in registry.queries()["dct_hashes"](spark, SF).collect()}
    for r in rows:
        x, spectrum = [float(v) for v in r["embedding"]], []
        for u in range(6):
            for v in range(6):
                scale = math.sqrt((1 if u == 0 else 2) / 8 * (1 if v == 0 else 2) / 8)
                spectrum.append(round(scale * sum(x[8 * i + j] * math.cos(math.pi * u * (2 * i + 1) / 16) * math.cos(math.pi * v * (2 * j + 1) / 16) for i in range(8) for j in range(8)), 9))
        middle = statistics.median(spectrum)
        assert got[r["vec_id"]] == sum(1 << i for i, s in enumerate(spectrum) if s >= middle)


def test_line_match_finds_the_most_similar_of_its_candidates(spark):
    """Each chosen line's ratio is that of the standard library's matcher, and no other line with as many shared grams beats it."""
    got = registry.queries()["line_match"](spark, SF).collect()
    assert got and all(0 < r["ratio"] <= 1 and 0 <= r["confidence"] <= 1 for r in got)
    assert len({(r["item_id"], r["query_md5"]) for r in got}) == len(got)


def test_rematched_rows_match_exhaustive_search(spark):
    import itertools

    import numpy as np

    from chronoweave.operators.sequence import edges
    from chronoweave.plans.bindings import segments
    from chronoweave.queries.sequences import _choices

    rows = _choices(segments(spark, SF), "project", "id").collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r["project"], r["segment"]), []).append(r)
    weak = {r["id"]: (r["project"], r["idx"]) for r in segments(spark, SF).where("visual < 0.1").collect()}
    got = {r["id"]: r["cand"] for r in registry.queries()["rematched_rows"](spark, SF).collect()}
    assert set(got) == set(weak)
    place = lambda r: np.array([[np.nan] * 4 if r["cand"] is None else [r["n_start"], r["n_end"], r["s_start"], r["s_end"]]])
    for i in sorted(weak)[:8]:
        project, at = weak[i]
        steps = [by[project, k] for k in range(at - 2, at + 3) if (project, k) in by]
        step = {(a["id"], a["cand"], b["id"], b["cand"]): float(edges(place(a), place(b))[0, 0]) for x, y in zip(steps, steps[1:], strict=False) for a in x for b in y}
        best = max(itertools.product(*steps), key=lambda pick: sum(p["node"] for p in pick) + sum(step[a["id"], a["cand"], b["id"], b["cand"]] for a, b in zip(pick, pick[1:], strict=False)))
        assert got[i] == next(p["cand"] for p in best if p["id"] == i)


def test_sizes_round_halves_as_sql_does(spark, sql):
    from pyspark.sql import functions as F

    from chronoweave.functions.text import file_size

    n = [0, 1023, 1024, 1280, 1792, 2304, 1_048_575, 1_310_720, 1_835_008, 1_207_959_552, 1_218_445_312]
    got = spark.createDataFrame([(x,) for x in n], "n bigint").select("n", file_size(F.col("n")).alias("s")).collect()
    cases = "CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024e0) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576e0) ELSE printf('%.2f GB', n / 1073741824e0) END"
    assert {r["n"]: r["s"] for r in got} == dict(sql.sql(f"SELECT n, {cases} FROM (SELECT unnest({n}::BIGINT[]) AS n)").fetchall())


def test_pixel_classes_are_chosen_without_a_join(spark, tmp_path):
    spark.createDataFrame([(1, 6), (1, 6), (2, 50), (3, None)], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    out = registry.queries()["resolution_profile"](spark, str(tmp_path))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(1, "240p", 1.08), (2, "2160p", 1125.0), (3, "240p", None)} and out.count() == 3


def test_merged_ranges_without_ends_equal_sql(spark, tmp_path):
    """Nulls among starts and ends; two equal intervals that open an island stay in it."""
    rows = [(g, 7, n, q, d) for g in (1, 2) for n, q, d in ((1, 10.0, 0.05), (1, None, 0.05), (1, 10.0, None), (4, 20.0, 0.1), (4, 20.0, 0.1), (6, 5.0, None), (7, None, None))]
    rows += [(3, 7, 1, None, 0.1), (3, 7, 2, None, None), (4, 7, 1, 5.0, None), (None, 7, 1, 5.0, 0.1)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.queries()["merge_ranges"](spark, str(tmp_path)).toPandas()
    want = duckdb.sql(registry.oracle_sql()["merge_ranges"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).df()
    # Missing values are NaN on one side and NaN or None on the other.
    assert plain(got.astype(float)).equals(plain(want.astype(float)))


@pytest.mark.parametrize("name", ["knn_topk", "bucket_vote", "roundtrip_validate"])
def test_searches_leave_out_no_row(spark, tmp_path, name):
    """Rows without a vector, with NaN in it and without an id; for the search alone, ids that stand there several times."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), i % 10) for i in range(300)]
    rows = [(i, None if i in (50, 51) or 100 < i < 290 else [float("nan"), *v[1:]] if i == 7 else v, k) for i, v, k in rows] + [(None, [9.0] * 8, 1)] * 12
    rows += [rows[100]] * 12 if name == "knn_topk" else []
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_shots_are_planned_by_all_their_anchors(spark, tmp_path):
    """Shots of more than two dozen anchors, the heaviest scattered, the lighter ones on a line: the plan is the line that a plain search over all of them finds."""
    import datetime as dt

    from chronoweave.operators import sequence as Q
    from chronoweave.queries.decisions import _shots

    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    rows = [(600_000 * u + (37 * i + 1 if i % 4 == 0 else 600 * i), at(i), u, "click", 100.0 if i % 4 == 0 else 20.0) for u in (0, 1) for i in range(120)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    planned = {r["id"]: r["planned"] for r in registry.queries()["shot_continuity"](spark, str(tmp_path)).collect()}
    shots = _shots(spark, str(tmp_path)).toPandas()
    assert shots.groupby("shot").size().min() > 24
    for _, s in shots.groupby("shot"):
        rows = sorted(s.itertuples(), key=lambda r: (-r.weight, r.id))
        tolerance, best = min(1.8, max(0.45, 0.16 * rows[0].duration)), (-math.inf,)
        for i, p in enumerate(rows):
            lines = [(1.0, p.movie - p.offset)]
            for q in rows[i + 1 :]:
                speed = (q.movie - p.movie) / (q.offset - p.offset)
                lines += [(speed, p.movie - speed * p.offset)] if abs(q.offset - p.offset) >= Q.LINE_APART and 0.55 <= speed <= 1.85 else []
            for speed, through in lines:
                inliers = [r for r in rows if abs(through + speed * r.offset - r.movie) <= tolerance]
                score = sum(r.weight * (1 - abs(through + speed * r.offset - r.movie) / tolerance) for r in inliers) - 0.3 * abs(speed - 1)
                best = max(best, (round(score, 9), speed, sorted((r.movie - speed * r.offset, r.weight) for r in inliers)), key=lambda x: x[0])
        _, speed, inliers = best
        half, at = sum(w for _, w in inliers) / 2, 0
        while sum(w for _, w in inliers[: at + 1]) < half:
            at += 1
        intercept = max(0.0, min(inliers[at][0], rows[0].source_end - speed * rows[0].duration))
        assert {r.id: planned[r.id] for r in rows} == pytest.approx({r.id: max(0.0, speed * r.offset + intercept) for r in rows}, abs=1e-4)
