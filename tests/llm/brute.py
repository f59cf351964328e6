"""Plain versions of the operators, for small inputs."""

from __future__ import annotations


def shingle_set(text: str | None, size: int = 5) -> set:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def near_components(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, int]:
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(i), find(j)
                    parent[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}
