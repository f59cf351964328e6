import random

import pytest

from chronoweave.llm.common import connected_components


@pytest.mark.parametrize("local_edges", [1_000, 7])
def test_components_match_union_find(spark, local_edges):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), local_edges=local_edges).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
