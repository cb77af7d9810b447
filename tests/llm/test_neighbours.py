from __future__ import annotations

import math

import numpy as np
import pytest

from clftally.llm import neighbours, registry

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, queries, k=5):
    """Ranked neighbours by brute force over whole vectors in double precision."""
    usable = [
        (i, np.array(v, float))
        for i, v in rows
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)
    ]
    usable = list({(i, tuple(v)): (i, v) for i, v in usable}.values())
    found = {}
    for query_id, query in usable:
        if query_id in queries:
            others = [(i, v) for i, v in usable if i != query_id and len(v) == len(query)]
            scored = [(-float(v @ query / (np.linalg.norm(v) * np.linalg.norm(query))), i) for i, v in others]
            found[query_id] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return found


def got(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def recall(found, wanted):
    hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in best}) for q, best in wanted.items())
    return hits / sum(map(len, wanted.values()))


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_recall(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 400)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 30)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 32)) * spread
    rows = [(i, (centres[i % 20] + rng.normal(size=32)).tolist()) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    stored = [(r.vec_id, r.embedding) for r in frame.collect()]
    found = got(neighbours.nearest(frame, frame.filter("vec_id % 50 = 0")))
    wanted = exact(stored, set(range(0, 4000, 50)))
    assert found.keys() == wanted.keys() and recall(found, wanted) >= 0.95
    for query, best in found.items():
        every = dict(exact(stored, {query}, 4000)[query])
        assert all(score == pytest.approx(every[i], abs=1e-10) for i, score in best)


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(i, [0.1, 0.7, -0.3] if i % 3 else rng.normal(size=3).tolist()) for i in range(900)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = got(neighbours.nearest(frame, frame.filter("vec_id % 50 = 0")))
    for query in (q for q in found if q % 3):
        assert [i for i, _ in found[query]] == [i for i in (1, 2, 4, 5, 7, 8) if i != query][:5]


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, []),
        (5, [0.0, 0.0]), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [math.inf, 1.0]), (None, [1.0, 0.0]),
        (100, [1.0, 2.0, 3.0]), (150, [1e-30, 1e-30]), (9, [1e30, 1e30]),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", id string, v int")
    found = got(neighbours.nearest(frame, frame.filter("vec_id % 50 = 0")))
    assert [i for i, _ in found[0]] == [1, 9, 150, 50, 2] and 100 not in found
    assert found[150][0][1] == pytest.approx(1) and [i for i, _ in found[150]][:2] == [1, 9]
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).collect() == []


def test_chi_square():
    assert neighbours.chi_square(18.307, 10) == pytest.approx(0.95, abs=1e-4)
    assert neighbours.chi_square_limit(0.95, 10) == pytest.approx(18.307, abs=1e-3)


def test_cells_hold_their_points():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(500, neighbours.PROJECTED))
    tree = neighbours.fit_tree(points, 4)
    cells, away = tree.cell_of(points), tree.squared_distances(points)
    assert len(set(cells)) == 16 and (away[np.arange(500), cells] == 0).all()
    for i in range(20):
        for cell in range(16):
            real = ((points[cells == cell] - points[i]) ** 2).sum(axis=1).min()
            assert away[i, cell] <= real + 1e-9


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    wanted = exact(rows, {i for i, _ in rows if i % 50 == 0})
    found = got(registry.op4_neighbours(spark, sf))
    assert found.keys() == wanted.keys() and recall(found, wanted) >= 0.95
