"""Estimators, medians and ranks over clouds of any size: fixed values, and the batch forms on the same points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import ranking
from lodestone.operators import ordering, robust
from lodestone.operators.ordering import OrderingConfig, order_points

CLOUD = "raw_index long, x double, y double, z double"


def frame_of(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], CLOUD)


def grid_with_outliers(n):
    """h points of a skewed lattice, then far ones on a line."""
    h = robust.h_size(n, 0.5)
    inner = []
    for i in range(h):
        u, v, w = (i % 9 - 4) * 0.08, ((i // 3) % 7 - 3) * 0.05, ((5 * i) % 11 - 5) * 0.04
        inner.append((u, v + 0.125 * u, w - 0.4 * v))
    return np.array(inner + [(21.0 + k, -17.0 - 2 * k, 13.0 + 3 * k) for k in range(n - h)])


# fixed values: center and scatter of the published implementations on these points, and the scale of their agreement
DET_MCD = {
    50: ([0, -0.027777777777777762, 0.015555555555555545], [0.12003299710838702, 0.030807079987019457, 0.053792565370795666]),
    100: ([-0.010769230769230809, -0.01865384615384616, 0.007692307692307693], [0.1090865350922311, 0.026654937057757653, 0.04633555921812379]),
    200: ([-0.007058823529411784, -0.00529411764705881, 0.001764705882352946], [0.11090759523775237, 0.02617608130369629, 0.043876433924149395]),
}
MRCD = {
    50: ([0.019199999999999995, -0.039599999999999996, 0.032800000000000024], [0.10390530277669904, 0.025423418464929137, 0.04250314600791485]),
    100: ([-0.011199999999999988, -0.0194, 0.014399999999999996], [0.0969383854139941, 0.024949238350482666, 0.0425698539954401]),
    200: ([-0.007199999999999984, -0.0024000000000000132, 0.004599999999999993], [0.1042442813130724, 0.02466406538294216, 0.042234780060188395]),
}
OGK = {
    50: ([0.29180859647333457, -0.21967186730066524, 0.14787764070408868], [0.9189094555790893, 0.22959792228536957, 0.37881150831403193]),
    100: ([0.20748054180805156, -0.286873345733947, 0.1557521535031809], [1.0733524452646666, 0.2821391988045112, 0.5202624360652509]),
    200: ([0.3138885271024165, -0.2911264711986624, 0.208739465588074], [1.2422438285319573, 0.37487543774593335, 0.6238319531624369]),
}


@pytest.mark.parametrize("n", [50, 100, 200])
def test_batch_fits_have_the_published_values(n):
    points = grid_with_outliers(n)
    for fit, values, place, spread in (
        (lambda p: robust.det_mcd(p, 0.5), DET_MCD, 1e-6, 0.01), (robust.mrcd, MRCD, 0.05, 0.2), (robust.ogk, OGK, 1e-12, 1e-5),
    ):
        found = fit(points)
        assert np.abs(found["center"] - values[n][0]).max() <= place
        assert np.abs(np.diag(found["scatter"]) / values[n][1] - 1).max() <= spread


@pytest.mark.parametrize("n", [50])
def test_fits_of_a_table_are_those_of_the_batch(spark, n):
    points = grid_with_outliers(n)
    df = frame_of(spark, points)
    cov = np.cov(points.T)
    big, batch = robust.det_mcd_big(df, n, cov, 0.5), robust.det_mcd(points, 0.5)
    assert big["h"] == batch["h"] and big["policy"] == batch["policy"]
    assert np.allclose(big["center"], batch["center"], rtol=0, atol=1e-12)
    assert np.allclose(big["scatter"], batch["scatter"], rtol=1e-10) and big["det"] == pytest.approx(batch["det"], rel=1e-9)
    big, batch = robust.mrcd_big(df, n), robust.mrcd(points)
    assert big["rho"] == pytest.approx(batch["rho"]) and np.allclose(big["center"], batch["center"], atol=1e-10)
    assert np.allclose(big["scatter"], batch["scatter"], rtol=1e-8)
    big, batch = ordering.ogk_big(df, n), robust.ogk(points)
    assert np.allclose(big["center"], batch["center"], atol=1e-12) and np.allclose(big["scatter"], batch["scatter"], rtol=1e-9)


def test_starts_of_a_table_are_those_of_the_batch(spark):
    rng = np.random.default_rng(8)
    points = np.vstack([rng.normal(size=(150, 3)) * [4, 2, 1], rng.integers(0, 3, (60, 3))])
    h = robust.h_size(len(points), 0.6)
    for a, b in zip(robust.starts_big(frame_of(spark, points), len(points), h), robust.starts(points, h)):
        assert a[0] == b[0] and a[3] == b[3]
        assert np.allclose(a[1], b[1], atol=1e-10) and np.allclose(a[2], b[2], rtol=1e-8, atol=1e-10), a[0]


@pytest.mark.parametrize("few", [20_000, 2])
def test_innermost_points_with_ties(spark, monkeypatch, few):
    """Many points at the same distance, many of them equal: the first by coordinates are taken."""
    monkeypatch.setattr(robust, "FEW", few)
    draw = random.Random(2)
    points = [p for p in [(1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1)] for _ in range(draw.randint(3, 9))]
    points += [(0, 0, 0), (0.1, 0, 0)] + [(2, 2, 2)] * 5
    points = np.array(points, float)
    df = frame_of(spark, points)
    v = [F.col(a) for a in robust.AXES]
    for h in (1, 2, 17, len(points) - 2):
        got = robust.innermost(df, v, [(np.zeros(3), np.eye(3))], h)[0]
        inner = points[robust._closest((points**2).sum(axis=1), points)[:h]]
        assert np.allclose(got["center"], inner.mean(axis=0), atol=1e-12)
        assert np.allclose(got["scatter"], np.cov(inner.T) if h > 1 else 0, atol=1e-12)


@pytest.mark.parametrize("few", [20_000, 3, 0])
def test_order_statistics(spark, monkeypatch, few):
    monkeypatch.setattr(ranking, "FEW", few)
    draw = random.Random(6)
    columns = [
        [draw.gauss(0, 1) for _ in range(300)], [draw.randint(0, 4) * 1.0 for _ in range(300)], [7.0] * 300,
        [draw.choice((-1, 1)) * 10.0 ** draw.uniform(-300, 308) for _ in range(300)], [abs(draw.gauss(0, 1)) for _ in range(300)],
        [-1.7e308] * 100 + [1.7e308] * 200,
    ]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"c{k} double" for k in range(len(columns))))
    wanted = [(k, r) for k in range(len(columns)) for r in (0, 1, 149, 150, 298, 299)]
    got = ranking.order_statistics(df, [(F.col(f"c{k}"), r) for k, r in wanted])
    assert got == [sorted(columns[k])[r] for k, r in wanted]
    assert ranking.medians(df, [F.col("c0"), F.col("c1")], 300) == [np.median(columns[0]), np.median(columns[1])]
    with pytest.raises(ValueError, match="rank 300"):
        ranking.order_statistics(df, [(F.col("c0"), 300)])
    assert ranking.order_statistics(df, []) == [] and math.isnan(ranking.medians(df.limit(0), [F.col("c0")], 0)[0])


def test_running_counts(spark):
    draw = random.Random(4)
    values = [draw.randint(0, 60) / 4 for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").count()
    got = {r["v"]: r["below"] for r in ranking.running_counts(df, "v").collect()}
    assert got == {v: sum(x < v for x in values) for v in set(values)}
    assert ranking.running_counts(df.limit(0), "v").isEmpty()


@pytest.mark.parametrize("estimator,gathered", [("det_mcd", 0), ("ogk", 0), ("mrcd", 50_000), ("det_mcd", 50_000)])
def test_order_of_a_table_is_that_of_the_batch(spark, monkeypatch, estimator, gathered):
    monkeypatch.setattr(ordering, "GATHERED", gathered)
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(160, 3)) * [5, 2, 1], rng.normal(size=(30, 3)) + 40])
    config = OrderingConfig(estimator=estimator)
    big = [r["raw_index"] for r in ordering.order_cloud(frame_of(spark, points), config).ordered.orderBy("rank").collect()]
    batch = order_points(points, config)["permutation"].tolist()
    assert sum(a != b for a, b in zip(big, batch)) <= 4  # a cell at a boundary may differ by rounding


def test_fits_that_are_disabled(spark):
    flat = [(float(k % 7), float(k % 5), 0.0) for k in range(40)]
    for points, policy in ((flat, "disabled_rank_deficient"), (flat[:6], "disabled_small_n")):
        found, about = ordering.keyed(frame_of(spark, points), OrderingConfig())
        assert about["fallback"] and about["policy"] == policy and found.count() == len(points)
    assert ordering.order_cloud(frame_of(spark, [])).ordered.isEmpty()
