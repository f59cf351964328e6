import random

import pytest

from .test_near_and_lines import brute_lines

from chronoweave.llm.line_dedup import line_dedup


def unique(rng: random.Random, n: int) -> str:
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def planted() -> list[tuple[int, str, str]]:
    """(id, text, passage): for 1 to 8 lines, eight passages of 50 words, each in two texts with different surroundings."""
    rng, rows = random.Random(8), []
    for n_lines in range(1, 9):
        for _ in range(8):
            cuts = [0, *sorted(rng.sample(range(1, 50), n_lines - 1)), 50]
            words = unique(rng, 50).split()
            passage = "\n".join(" ".join(words[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            for _ in range(2):
                before, after = ([unique(rng, rng.randrange(1, 20)) for _ in range(rng.randrange(0, 5))] for _ in range(2))
                rows.append((len(rows), "\n".join([*before, passage, *after]), passage))
    return rows


def cleaned(df) -> dict:
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in df.collect()}


def test_planted_passages_of_1_to_8_lines_go(spark):
    rows = planted()
    docs = [(i, t) for i, t, _ in rows]
    got = cleaned(line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")))
    assert got == brute_lines(docs)
    for i, text, passage in rows:
        assert got[i][1] == (passage.count("\n") + 1 if i % 2 else 0)
        assert not (set(passage.split("\n")) & set(got[i][0].split("\n"))) if i % 2 else got[i][0] == text


@pytest.mark.parametrize("run_words", [1, 5, 50])
def test_passages_match_brute_force(spark, run_words):
    """Texts from a small stock of lines, blank and repeated ones among them, so that passages overlap and repeat within a text."""
    rng = random.Random(run_words)
    stock = [unique(rng, n) for n in (1, 1, 2, 3, 5, 8, 13, 21, 40, 55)] + ["", "", " \t"]
    docs = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randrange(1, 25)))) for i in range(40)] + [(40, ""), (41, "\n\n")]
    got = cleaned(line_dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), run_words=run_words))
    assert got == brute_lines(docs, run_words)
    assert sum(n for _, n in got.values()) > 50


def test_passages_on_nasty_rows(nasty, empty):
    got = line_dedup(nasty)
    by = {(r["doc_id"], r["n_lines"]): r for r in got.collect()}
    assert by[4, 0]["text"] is None and by[1, 1]["n_removed"] == 0
    assert by[2, 1]["text"] == "" and by[2, 1]["n_removed"] == 1 and by[None, 1]["n_removed"] == 1


def test_pipeline_stage_leaves_no_repeated_passage(spark):
    import corpus_pipeline as p

    docs = [(i, t, len(t)) for i, t, _ in planted()]
    docs += [(1000, docs[0][1], len(docs[0][1])), (1001, "", 0)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint")
    out = {r["doc_id"]: r for r in dict(p.STAGES)["line_dedup"](spark, frame, "").collect()}
    assert 1000 not in out and 1001 in out  # a copy of which nothing is left goes; a text that was empty stays
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert sum(n for _, n in brute_lines([(i, r["text"]) for i, r in out.items()]).values()) == 0
    assert all(out[i]["text"] == text for i, text, _ in planted() if i % 2 == 0)
