from __future__ import annotations

import numpy as np
import pytest

from wayfind.llm.multi_index import Grid, link_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, n int, rep long"


def brute(rows) -> dict:
    parent = {r[0]: r[0] for r in rows}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [(i, np.array(v, np.float32).astype(np.float64), k) for i, v, k, *_ in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for a, (i, x, k) in enumerate(good):
        for j, y, m in good[:a]:
            if k == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i in parent}


def planted(n: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=64)
        if rows and i % 2:
            source = rows[int(rng.integers(len(rows)))]
            v = np.array(source[1]) * rng.uniform(0.5, 2) + rng.normal(size=64) * np.linalg.norm(source[1]) * rng.choice([0, 0.01, 0.02])
        rows.append((i, [float(np.float32(x)) for x in v], i % 3, "d", 1, 5))
    return rows


@pytest.mark.parametrize("chunk", [1024, 7])
def test_recall_against_brute_force(spark, chunk):
    rows = planted(600, 3)
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4), centroids=16, chunk=chunk).collect()}
    found, real = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert real > 500 and 0.98 * real <= found <= real
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_a_crowded_cell_gives_exact_counts(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=64) * 0.09 * (i % 5)], 1, "d", 1, 5) for i in range(300)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, SCHEMA), centroids=1, chunk=40).collect()}
    assert got == brute(rows)


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(2)
    grid = Grid(rng.normal(size=(500, 16)), centroids=8)
    _, lows = grid.bounds(np.eye(16)[:4])
    for i in range(4):
        cells = grid.visits(lows[0][i], lows[1][i])
        sums = [lows[0][i][c // len(grid.books[1])] + lows[1][i][c % len(grid.books[1])] for c in cells]
        assert sums == sorted(sums) and sums[0] == 0
        every = lows[0][i][:, None] + lows[1][i][None, :]
        assert len(cells) == (every <= grid.reach).sum()


def test_odd_rows(spark):
    one = [0.5] * 64
    rows = [
        (1, one, 1), (2, one, 1), (3, one, 2), (4, None, 1), (5, [], 1), (6, [0.0] * 64, 1), (7, [None] + one[1:], 1), (8, [float("nan")] + one[1:], 1),
        (9, [float("inf")] + one[1:], 1), (10, one, None), (11, [1.0, 2.0], 1), (12, [2.0, 4.0], 1), (13, [x * 3 for x in one], 1), (14, one[:-1] + [0.4999], 1), (15, [-0.5] * 64, 1),
    ]
    rows = [(*r, "d", 1, 5) for r in rows]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    repeated = spark.createDataFrame([*rows[:2], rows[0], (None, one, 1, "d", 1, 5)], SCHEMA)
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in link_vectors(repeated).collect()) == [("1", 2, 1), ("1", 2, 1), ("2", 2, 1), ("None", 0, None)]
    assert link_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert link_vectors(spark.createDataFrame(rows[3:6], SCHEMA)).count() == 3
