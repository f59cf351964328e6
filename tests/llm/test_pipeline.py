"""The pipeline against its stages done by hand, and the queries against their SQL."""

import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from .brute import near_components, shingle_set
from .conftest import passage
from .test_near_and_lines import brute_lines

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    rng, out, docs = random.Random(6), tmp_path_factory.mktemp("sf"), []
    shared = [passage(k, 12) for k in range(12)]
    items = [(i, passage(70 + i, 30)) for i in range(3)]
    for d in range(90):
        lines = [passage(300 + d * 4 + k, 20) for k in range(4)]
        if d % 5 == 1:
            lines[2:2] = shared
        if d % 9 == 2:
            lines.append(items[d % 3][1])
        text = "\n".join(lines)
        if d % 10 == 7:
            words = docs[-1][1].split(" ")
            words[rng.randrange(len(words))] = "other"
            text = " ".join(words)
        docs.append((d, text, "en" if d % 2 else "xx", "s", len(text)))
    docs += [(200, None, "en", "s", 0), (201, "123 456", "en", "s", 7), (202, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), docs, items


def test_stages_match_brute_force(spark, tiny):
    import corpus_pipeline as p

    sf, docs, items = tiny
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(p.STAGES)
    after = stages["language_id"](spark, frame, sf)
    assert after.columns == frame.columns
    assert {r["doc_id"] for r in after.collect()} == {d for d, t, *_ in docs if t and any(c.isalpha() for c in t)}

    rows = [(d, t) for d, t, *_ in docs if t is not None]
    lines = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, frame.where("text is not null"), sf).collect()}
    assert lines == {d: t for d, (t, n) in brute_lines(rows).items() if t or not n}

    parts = near_components(rows)
    assert {r["doc_id"] for r in stages["near_dedup"](spark, frame.where("text is not null"), sf).collect()} == {d for d, c in parts.items() if d == c}
    again = spark.createDataFrame([(1, rows[0][1]), (2, rows[0][1]), (2, rows[1][1]), (None, rows[0][1])], "doc_id bigint, text string")
    assert {(r["doc_id"], r["text"]) for r in stages["near_dedup"](spark, again, sf).collect()} == {(1, rows[0][1]), (2, rows[1][1])}

    tests = [shingle_set(t) for _, t in items]
    clean = {d for d, t in rows if not any(100 * len(x & shingle_set(t)) >= 80 * len(x) for x in tests)}
    assert {r["doc_id"] for r in stages["decontamination"](spark, frame.where("text is not null"), sf).collect()} == clean
    assert len(clean) < len(rows)


def test_run_packs_what_the_stages_keep(spark, tiny):
    import corpus_pipeline as p

    sf, *_ = tiny
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in docs.collect()}
    out = p.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == kept
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e")).where("n <> e or n > 1024").count() == 0


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op4_near_dedup", "op5_decontaminate", "op6_line_dedup", "op8_secret_scan"])
def test_query_equals_sql(spark, name):
    from chronoweave.llm import queries

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = plain(queries.queries()[name](spark, SF).toPandas()), plain(con.sql(queries.oracle_sql()[name]).df())
    assert got.equals(want)
