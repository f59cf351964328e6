import random

import numpy as np
import pytest

from .brute import near_components, shingle_set
from .conftest import passage

from chronoweave.llm import near_dedup
from chronoweave.llm.decontaminate import contamination, decontaminate
from chronoweave.llm.line_dedup import chunk_bounds, line_dedup
from chronoweave.llm.near_dedup import near_duplicates


def corpus(n: int = 120) -> list[tuple[int, str]]:
    """Texts in families of near copies of all degrees, with a line that most of them share."""
    rng, rows = random.Random(11), []
    for i in range(n):
        words = passage(i % 9, 60).split()
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words) + (" this very common line ends most of the texts here" if i % 4 else "")))
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = near_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingle_set(t)) for i, t in rows}


@pytest.mark.parametrize("levels", [1, 3])
def test_large_leaves_lose_no_link(spark, monkeypatch, levels):
    """Leaves cut into blocks, and nodes that branch several times."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "LEVELS", levels)
    rows = corpus(90)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == near_components(rows)


def test_a_family_writes_fewer_links_than_it_has_members(spark, monkeypatch):
    """400 copies of one text, most pairs between 0.5 and 0.9: links and contested rows stay linear."""
    rng, rows = random.Random(3), []
    base = [f"w{rng.randrange(10**9)}" for _ in range(150)]
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    written = {}
    plain = near_dedup.materialize

    def counted(df, name):
        out = plain(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    def linked(edges):
        written["links"] = max(written.get("links", 0), edges.count())
        return components(edges)

    components = near_dedup.connected_components
    monkeypatch.setattr(near_dedup, "materialize", counted)
    monkeypatch.setattr(near_dedup, "connected_components", linked)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == near_components(rows)
    leaves = written["members"]
    assert leaves < 400 * 2 * near_dedup.TREES
    assert written["contested"] <= leaves and written["links"] <= leaves


def test_shared_elements_match_set_intersections(monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 70)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(2**55 + 1)) for _ in range(23)]
    want = [[len(np.intersect1d(x, y)) if i != j else None for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    got = near_dedup._shared(sets)
    assert all(want[i][j] == got[i, j] for i in range(23) for j in range(23) if i != j)


def test_near_duplicates_on_nasty_rows(nasty, empty):
    got = near_duplicates(nasty).collect()
    assert len(got) == nasty.count()
    by = {(r["doc_id"], r["n_shingles"]): r for r in got}
    assert by[2, 76]["component_id"] == 1 and by[None, 76]["component_id"] == 1 and by[3, 77]["component_id"] == 1
    assert by[8, 1]["component_id"] == 7
    assert by[5, 0]["component_id"] == 5 and by[5, 0]["kept"] and by[None, 0]["kept"]
    assert near_duplicates(empty).count() == 0


def test_contamination_matches_brute_force(spark, nasty, empty):
    items = [(i, passage(40 + i, 12 + 5 * i)) for i in range(8)] + [(90, "tiny item"), (91, None), (None, "no id for this item here"), (0, passage(40, 12))]
    rng, docs = random.Random(2), []
    for d in range(40):
        item = items[d % 8][1].split()
        for _ in range(d % 4):
            item[rng.randrange(len(item))] = "changed"
        docs.append((d, passage(60 + d, 30 + 40 * (d % 5)) + " " + " ".join(item).upper() + " " + passage(200 + d, 50)))
    docs += [(100, "Tiny ITEM"), (101, "a tiny item here"), (102, None), (103, ""), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    sets = {i: (shingle_set(t), len((t or "").split())) for i, t in items if i is not None and t}
    want = set()
    for d, t in docs:
        s = shingle_set(t)
        for i, (x, n) in sets.items():
            if x and 100 * len(x & s) >= 80 * len(x) and (n >= 5 or len((t or "").split()) < 5):
                want.add((d, i, len(x), len(x & s)))
    for block in (1_000, 3):
        assert {tuple(r) for r in contamination(table, bench, block=block).collect()} == want
    bad = {w[0] for w in want}
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in decontaminate(table, bench).collect()) == sorted(d if d is not None else -1 for d, _ in docs if d not in bad)
    assert decontaminate(nasty, bench).columns == nasty.columns
    assert contamination(empty, bench).count() == 0 and contamination(nasty, bench.limit(0)).count() == 0


def test_short_items_with_ids_of_text(spark):
    """Items of five to twelve words, a few shingles each, in long documents; their ids are strings."""
    items = [(f"i{k}", passage(40 + k, 5 + k)) for k in range(8)]
    docs = [(d, passage(300 + d, 400) + " " + items[d % 8][1] + " " + passage(500 + d, 300 + d)) for d in range(64)]
    got = contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(d, f"i{d % 8}") for d in range(64)}


def brute_lines(rows: list[tuple[int, str]], run_words: int = 50) -> dict[int, tuple[str, int]]:
    """Each repeated chunk goes, and each line of each run of lines of so many words that some earlier place has; all runs are tried."""
    chunks, runs, out = set(), set(), {}
    for i, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for a, b in chunk_bounds([line.encode() for line in lines]):
            chunk = "\n".join(lines[a:b])
            if b - a >= 2 and len(chunk.encode().split()) >= 10:
                if chunk in chunks:
                    gone |= set(range(a, b))
                chunks.add(chunk)
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(line.encode().split()) for line in run) >= run_words:
                    if run in runs:
                        gone |= set(range(a, b))
                    runs.add(run)
        out[i] = ("\n".join(line for j, line in enumerate(lines) if j not in gone), len(gone))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng, shared, rows = random.Random(4), [passage(k, 12) for k in range(30)], []
    for d in range(80):
        own = [passage(1000 + d * 10 + k, rng.randrange(3, 15)) for k in range(6)]
        at = rng.randrange(20)
        rows.append((d, "\n".join(own[:3] + (shared[at : at + 9] if d % 2 else []) + own[3:])))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_lines(rows)
    assert got == want
    assert sum(n for _, n in want.values()) > 50


def test_line_dedup_on_nasty_rows(nasty, empty):
    got = line_dedup(nasty)
    assert got.count() == nasty.count()
    assert got.columns == [c for c in nasty.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert got.where("doc_id = 4").first()["text"] is None
    assert line_dedup(empty).count() == 0


def test_rows_that_share_a_joined_string_lose_their_own_lines(spark):
    from chronoweave.llm.line_dedup import line_dedup

    shared = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(3))
    df = spark.createDataFrame([("0", shared), ("a\nb", f"c\n{shared}"), ("a", f"b\nc\n{shared}"), ("z", "own")], "doc_id string, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup(df).collect()}
    # The line "c" and what follows it stand in "a" before they stand in "a\nb".
    assert got == {"0": (3, 0, shared), "a\nb": (4, 4, ""), "a": (5, 3, "b\nc"), "z": (1, 0, "own")}
