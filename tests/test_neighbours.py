"""Exact neighbours and rank correlation of clouds of any size, against plain versions."""

import random

import numpy as np
import pytest

from lodestone.operators import metrics, neighbours

CLOUD = "raw_index long, x double, y double, z double"


def by_hand(points, k):
    out = {}
    for i, p in enumerate(points):
        d2 = [((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 + (q[2] - p[2]) ** 2, j) for j, q in enumerate(points) if j != i]
        out[i] = [j for _, j in sorted(d2)[:k]]
    return out


def found(spark, points, k, leaf):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], CLOUD)
    out = {i: [] for i in range(len(points))}
    for r in sorted(neighbours.nearest(df, k, leaf).collect(), key=lambda r: (r["raw_index"], r["nth"])):
        out[r["raw_index"]].append(r["neighbour"])
        assert r["nth"] == len(out[r["raw_index"]])
    return out


@pytest.mark.parametrize("leaf", [7, 2_000])
def test_nearest(spark, leaf):
    rng = np.random.default_rng(4)
    lattice = [(x, y, z) for x in range(4) for y in range(4) for z in range(3)]  # many ties, and splits on points
    points = [*rng.normal(size=(60, 3)).tolist(), *lattice, *[(0.5, 0.5, 0.5)] * 40, *lattice[:9], (1e9, 0, 0)]
    for k in (1, 5):
        assert found(spark, points, k, leaf) == by_hand(points, k)


def test_nearest_of_few(spark):
    assert found(spark, [], 3, 10) == {}
    assert found(spark, [(1, 2, 3)], 3, 10) == {0: []}
    assert found(spark, [(0, 0, 0)] * 3, 8, 1) == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert found(spark, [(0, 0, 0), (1, 0, 0), (5, 0, 0)], 2, 1) == {0: [1, 2], 1: [0, 2], 2: [1, 0]}


def test_the_plan_has_no_nested_loop(spark):
    df = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(50)], CLOUD)
    plan = neighbours.nearest(df, 3, 5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_balls_reach_every_leaf_with_a_point_in_them():
    rng = np.random.default_rng(7)
    points = rng.integers(0, 6, (300, 3)).astype(float)
    tree = neighbours.Tree(points, 40)
    leaves, radius = tree.leaves(points), rng.integers(0, 4, 300).astype(float)
    who, reached = tree.reached(points, radius)
    got = set(zip(who.tolist(), reached.tolist()))
    d2 = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    assert {(i, int(leaves[j])) for i, j in zip(*np.nonzero(d2 <= radius[:, None] ** 2))} <= got


def plain_inversions(q):
    return sum(a > b for i, a in enumerate(q) for b in q[i + 1 :])


def test_inversions():
    draw = random.Random(1)
    for n in (0, 1, 2, 3, 7, 64, 129, 200):
        q = [draw.randint(0, n // 2) for _ in range(n)]
        assert metrics.inversions(np.array(q, np.int64)) == plain_inversions(q)


@pytest.mark.parametrize("digit", [1, 6])
def test_kendall_by_merging(spark, monkeypatch, digit):
    monkeypatch.setattr(metrics, "DIGIT", digit)
    draw = random.Random(digit)
    for n, clean in ((0, 5), (1, 1), (150, 150), (150, 90)):
        p, q = (draw.sample(range(3 * n + 1), n) for _ in range(2))
        frames = [spark.createDataFrame([(i, r) for i, r in enumerate(x)], "raw_index long, rank long").repartition(3) for x in (p, q)]
        by_p = [q[i] for i in sorted(range(n), key=p.__getitem__) if i < clean]
        down, m = plain_inversions(by_p), len(by_p)
        for parts in (None, 9):
            assert metrics.kendall_tau_big(*frames, clean, parts) == (m * (m - 1) // 2 - down, down)
