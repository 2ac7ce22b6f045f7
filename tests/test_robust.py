"""Robust fits: known scatter, breakdown, guards, and the distributions behind them."""

import numpy as np
import pytest

from lodestone.operators import linalg, ordering, refine, robust
from lodestone.operators.ordering import OrderingConfig, order_points
from lodestone.schema import OrderingError


def cloud(n=400, outliers=0.2, seed=3):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 3)) * [5, 2, 1]
    points[: int(n * outliers)] = rng.normal(size=(int(n * outliers), 3)) * 0.1 + [60, 60, 60]
    return points


@pytest.mark.parametrize("fit", [robust.det_mcd, robust.ogk, robust.mrcd])
def test_outliers_do_not_move_the_fit(fit):
    found = fit(cloud())
    assert np.abs(found["center"]).max() < 3
    axes = linalg.principal_frame(found["scatter"])[0]
    assert abs(axes[0, 0]) > 0.9


def test_guards():
    assert robust.det_mcd(np.zeros((5, 3)))["policy"] == "disabled_small_n"
    flat = cloud() * [1, 1, 0]
    assert robust.det_mcd(flat)["policy"] == "disabled_rank_deficient"
    assert robust.ogk(flat)["policy"] == "disabled_rank_deficient"
    assert robust.fit_frame(flat)["fallback"]


def test_hardin_rocke_cutoffs():
    for n, h, cutoff in ((50, 27, 57.8218), (100, 52, 37.0447), (200, 102, 29.4503)):
        assert linalg.hardin_rocke(n, 3, h) == pytest.approx(cutoff, abs=1e-4)


def test_jacobi_against_numpy():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = rng.normal(size=(3, 3))
        values, vectors, done = linalg.jacobi_eigen(a @ a.T)
        assert done and np.allclose(values, np.linalg.eigvalsh(a @ a.T))
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, a @ a.T)


@pytest.mark.parametrize("method", ordering.RAW + ordering.FRAMED)
def test_every_method_orders_small_clouds(method):
    for n in (0, 1, 2, 60):
        found = order_points(cloud(max(n, 10))[:n], OrderingConfig(method=method))
        assert sorted(found["permutation"]) == list(range(n))


def test_errors():
    with pytest.raises(OrderingError) as e:
        order_points(np.array([[0, np.nan, 1]]), OrderingConfig())
    assert e.value.code == "invalid_input"
    with pytest.raises(OrderingError) as e:
        OrderingConfig(method="nothing")
    assert e.value.code == "unsupported_method"


def test_refinement_never_lengthens_a_path():
    for seed in range(5):
        points = cloud(120, 0, seed)
        order = order_points(points, OrderingConfig(method="morton"))["permutation"]
        better = refine.refine(points, order)
        assert sorted(better) == list(range(120))
        assert refine.length(points, better) <= refine.length(points, order)


@pytest.mark.parametrize("block", [16, 50, 4096])
def test_refinement_in_blocks(spark, block):
    points = cloud(130, 0, 9)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "raw_index long, x double, y double, z double")
    config = OrderingConfig(method="morton", bits="uniform")
    plain = ordering.order_cloud(df, config).ordered
    before = [r["raw_index"] for r in plain.orderBy("rank").collect()]
    got = refine.refine_big(plain, 130, block).orderBy("rank").collect()
    after = [r["raw_index"] for r in got]
    assert [r["rank"] for r in got] == list(range(130)) == sorted(after)
    assert all((r["x"], r["y"], r["z"]) == tuple(points[r["raw_index"]]) for r in got)
    assert refine.length(points, after) < refine.length(points, before)
    if block > 130:
        assert after == refine.refine(points, before).tolist()
    held = refine.refine(points, before, True)
    assert (held[0], held[-1]) == (before[0], before[-1]) and refine.length(points, held) <= refine.length(points, before)


def test_big_mode_agrees_with_batch_mode(spark):
    points = cloud(300, 0.1)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "raw_index long, x double, y double, z double")
    for config in (OrderingConfig(method="hilbert", bits="uniform"), OrderingConfig(method="robust_hilbert", estimator="ogk")):
        big = [r["raw_index"] for r in ordering.order_cloud(df, config).ordered.orderBy("rank").collect()]
        batch = order_points(points, config)["permutation"].tolist()
        assert sum(a != b for a, b in zip(big, batch)) <= 4  # a cell at a boundary may differ by rounding
