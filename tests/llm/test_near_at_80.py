"""The pipeline's near-duplicate stage at a similarity of 0.8."""

import random

from .brute import near_components
from .test_near_and_lines import corpus

from chronoweave.llm.near_dedup import maybe, near_duplicates


def between() -> list[tuple[int, str]]:
    """Pairs of texts whose similarity of shingles goes from 0.77 to 0.91 in even steps, none in a pair with another."""
    rng, rows = random.Random(80), []
    for i in range(60):
        words = [f"w{rng.randrange(10**9)}" for _ in range(204)]
        rows.append((2 * i, " ".join(words)))
        n = 18 + i % 30  # new words at the end take as many shingles: (200 - n) of (200 + n) are shared
        rows.append((2 * i + 1, " ".join(words[: 204 - n] + [f"x{rng.randrange(10**9)}" for _ in range(n)])))
    return rows


def test_stage_matches_brute_force_at_80(spark):
    import corpus_pipeline as p

    rows = between() + [(1000 + i, t) for i, t in corpus(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, at_85 = near_components(rows, 80), near_components(rows, 85)
    kept = {r["doc_id"] for r in dict(p.STAGES)["near_dedup"](spark, frame, "").collect()}
    assert kept == {i for i, c in want.items() if i == c}
    assert len({i for i, c in at_85.items() if i == c} - kept) >= 10
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame, 80).collect()} == want


def test_sketches_ask_below_the_threshold():
    assert 0.59 < maybe(85) < 0.609 and 0.515 < maybe(80) < 0.525
