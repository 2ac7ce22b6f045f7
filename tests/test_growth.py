"""Steps whose cost must not outgrow the table: results held to plain forms, and what they take counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import robust


@pytest.mark.parametrize("band", [50_000, 90])
def test_concentration_by_bands(spark, monkeypatch, band):
    """Every start ends where the batch form ends, and few of its steps pass over the points."""
    monkeypatch.setattr(robust, "BAND", band, raising=False)
    rng = np.random.default_rng(5)
    points = np.vstack([rng.uniform(-1, 1, (400, 3)) * [5, 2, 1], rng.integers(0, 3, (40, 3))])
    h = robust.h_size(len(points), 0.5)
    begun = robust.starts(points, h)
    passes = []
    plain = robust._by_bits
    monkeypatch.setattr(robust, "_by_bits", lambda *a: passes.append(1) or plain(*a))
    df = spark.createDataFrame(points.tolist(), "x double, y double, z double").coalesce(1)
    v = [F.col(a) for a in robust.AXES]
    ended = robust.concentrate_big(df, v, [{"center": c, "scatter": s} for _, c, s, _ in begun], lambda s: s, h)
    batch = [robust.concentrate(points, c, s, h) for _, c, s, _ in begun]
    for a, b in zip(ended, batch):
        assert np.allclose(a["center"], b["center"], atol=1e-10) and np.allclose(a["scatter"], b["scatter"], rtol=1e-8, atol=1e-10)
    if band == 50_000:
        assert max(b["steps"] for b in batch) > 3 * len(passes)


def test_equal_cases_have_equal_means(spark, tmp_path):
    """Suppliers with the same lines in another order: their means and differences are the same to the last bit."""
    from lodestone.plans import analysis

    rng = np.random.default_rng(9)
    lines = [(int(s), "RN"[k % 2], "F", float(rng.integers(10_000, 9_000_000) / 100), float(rng.integers(1, 50))) for s in range(12) for k in range(80)]
    rows = []
    for copy in range(5):
        rows += [(12 * copy + s, *rest) for s, *rest in (lines[i] for i in rng.permutation(len(lines)))]
    schema = "l_suppkey long, l_returnflag string, l_linestatus string, l_extendedprice double, l_quantity double"
    spark.createDataFrame(rows, schema).repartition(6).write.parquet(str(tmp_path / "lineitem.parquet"))
    deltas = analysis._deltas(spark, str(tmp_path))
    assert deltas.count() == 60 and deltas.select("delta").distinct().count() == 12
    assert analysis.sign_flip_test(spark, str(tmp_path)).first()["blocks"] == 11


def test_tau_forms_no_pairs(spark):
    from lodestone.operators import metrics

    a = spark.createDataFrame([(i, i) for i in range(50)], "raw_index long, rank long")
    b = spark.createDataFrame([(i, (7 * i) % 50) for i in range(50)], "raw_index long, rank long")
    got = metrics.kendall_tau(a, b, 50)
    down = sum((7 * i) % 50 > (7 * j) % 50 for i in range(50) for j in range(i + 1, 50))
    assert tuple(got.first()) == (1225 - down, down, pytest.approx((1225 - 2 * down) / 1225))
    assert "Join" not in got._jdf.queryExecution().toString()
    assert tuple(metrics.kendall_tau(a, b, 1).first()) == (0, 0, None)


def test_resamples_in_parts(spark, monkeypatch):
    """Resamples drawn a few at a time are those drawn together, and none of them is held whole."""
    from lodestone.operators import stats

    values = np.random.default_rng(1).normal(size=301)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0)], "g string, v double")
    draws = np.sort(np.median(np.random.default_rng(1).choice(np.sort(values), size=(200, 301)), axis=1))
    for most in (4_000_000, 301 * 7, 1):
        monkeypatch.setattr(stats, "AT_ONCE", most)
        got = {r["g"]: r for r in stats.bootstrap_by_group(df, "g", "v", 200, 1).collect()}
        assert (got["a"]["low"], got["a"]["high"]) == (draws[5], draws[195]) and got["b"]["low"] == 1.0


def test_percentiles_by_selection(spark, monkeypatch):
    """Few huge groups: no values are gathered, and results are those of the aggregate; a null group and nulls too."""
    from lodestone.operators import stats

    rng = np.random.default_rng(2)
    rows = [("ab"[k % 2], float(v)) for k, v in enumerate(rng.normal(size=400))] + [(None, 3.0), (None, None), ("c", None), ("d", -0.5), ("d", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    monkeypatch.setattr(stats, "SELECTED", 0)
    gathered = {r["g"]: r for r in stats.percentiles(df, ["g"], "v").collect()}
    monkeypatch.setattr(stats, "SELECTED", 64)
    selected = stats.percentiles(df, ["g"], "v")
    assert "percentile" not in selected._jdf.queryExecution().toString()
    for r in selected.collect():
        assert r.asDict() == pytest.approx(gathered[r["g"]].asDict())
    assert selected.count() == len(gathered) == 5 and selected.columns == ["g", "p50", "p95", "p99"]


@pytest.mark.parametrize("bits", [(10, 10, 10), (10, 4, 1), (21, 21, 21), (32, 0, 3), (1, 2, 2), (0, 0, 0)])
def test_hilbert_keys_by_strides(spark, bits):
    """Keys are those of the level-by-level form, and come from generated code: no fold is run for each row."""
    from lodestone.functions import curves

    rng = np.random.default_rng(4)
    cells = np.column_stack([rng.integers(0, 1 << b, 300) for b in bits])
    df = spark.createDataFrame(cells.tolist(), "x long, y long, z long")
    keys = df.select("*", curves.hilbert([F.col(c) for c in "xyz"], bits).alias("key"))
    got = np.array([tuple(r) for r in keys.collect()])
    assert (got[:, 3] == curves.hilbert_array(got[:, :3], bits)).all()
    assert "lambda" not in keys._jdf.queryExecution().toString()


def test_locality_without_all_pairs(spark):
    """Both ends of the ratio are those of all pairs, and no plan joins the points by the order of their ranks alone."""
    from lodestone.operators import metrics

    rng = np.random.default_rng(6)
    line = np.column_stack([np.arange(300.0), np.zeros(300), np.zeros(300)])
    lattice = np.array([(x, y, z) for x in range(7) for y in range(7) for z in range(7)], float)
    clumps = np.vstack([rng.normal(size=(200, 3)), rng.normal(size=(150, 3)) * 1e-3 + 50])
    for points in (line, lattice, clumps, rng.permutation(clumps), np.vstack([clumps[:60], clumps[:1]]), clumps[:2]):
        df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "rank long, x double, y double, z double").coalesce(1)
        a, b = np.triu_indices(len(points), 1)
        ratios = np.sqrt(((points[a] - points[b]) ** 2).sum(axis=1)) ** 3 / (b - a)
        got = metrics.l1_l2_locality(df)
        assert tuple(got.first()) == (pytest.approx(ratios.max()), pytest.approx(ratios.min()))
        assert "Join" not in got._jdf.queryExecution().toString()
    assert tuple(metrics.l1_l2_locality(df.limit(1)).first()) == (None, None)


def test_starts_that_meet_go_on_once(monkeypatch):
    """Starts that reach a subset of an earlier one are not followed to the same end again, and the frame is the same."""
    rng = np.random.default_rng(11)
    points = np.vstack([rng.normal(size=(150, 3)) * [4, 2, 1], rng.normal(size=(20, 3)) + 30])
    h = robust.h_size(len(points), 0.5)
    ends = [robust.concentrate(points, c, s, h) for _, c, s, _ in robust.starts(points, h)]
    steps, plain = [], robust._covariance
    monkeypatch.setattr(robust, "_covariance", lambda p: steps.append(len(p)) or plain(p))
    found = robust.det_mcd(points, 0.5)
    assert found["det"] == min(e["det"] for e in ends)
    assert sum(n == h for n in steps) < sum(e["steps"] for e in ends)
    ties = np.repeat([1.0, 2.0, 3.0, 4.0], 5)
    for k in (1, 5, 7, 20):
        assert (robust._inner(ties, points[:20], k) == np.sort(robust._closest(ties, points[:20])[:k])).all()
