"""Steps that several queries share: what they must not do twice, shuffle or number, and the results that they keep."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import layout, metrics
from lodestone.operators.ordering import OrderingConfig, order_cloud
from lodestone.plans import clouds, queries, workload

HILBERT = OrderingConfig(method="hilbert", bits="uniform")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cloud(spark):
    points = np.random.default_rng(3).random((3_000, 3)).tolist()
    return spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "raw_index long, x double, y double, z double")


@pytest.fixture(scope="module")
def windows(spark):
    rows = [("all", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("part", 0.2, 0.2, 0.2, 0.6, 0.5, 0.7), ("none", 2.0, 2.0, 2.0, 3.0, 3.0, 3.0)]
    return spark.createDataFrame(rows, workload.WINDOWS)


@pytest.fixture(scope="module")
def stored(spark, cloud, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "a")
    layout.write_layout(order_cloud(cloud, HILBERT).ordered, path, pages_per_file=2)
    return layout.read_layout(spark, path)


def _sorted(df):
    return sorted(map(tuple, df.collect()))


def test_stored_points_are_not_shuffled(spark, cloud, windows, stored, monkeypatch):
    """windows go to the files, whatever the size of the directory; beyond ``PAIRS`` pages deal the points."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = _sorted(layout.full_scan(cloud, windows))
        found = layout.pruned_query(*stored, windows)
        assert _sorted(found) == want and len(want) > 3_000
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(layout, "PAIRS", 1)
        assert _sorted(layout.pruned_query(*stored, windows)) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_directory_is_made_once(spark, cloud, tmp_path):
    """every record is hashed once for the directory, and its checksum is the sum of the records' hashes."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def spy(x):
        seen.add(1)
        return x

    ordered = order_cloud(cloud, HILBERT).ordered
    layout.write_layout(ordered.withColumn("x", spy.asNondeterministic()("x")), str(tmp_path / "a"), 2)
    assert seen.value <= 2 * 3_000  # once for the points, once for the directory
    plain = F.sum(F.xxhash64("rank", "raw_index", "key", "x", "y", "z").cast("decimal(38,0)")).alias("checksum")
    pages = layout.with_pages(ordered)
    assert _sorted(pages.groupBy("page_id").agg(layout.page_checksum())) == _sorted(pages.groupBy("page_id").agg(plain))


def test_points_alone_are_not_numbered(spark, monkeypatch):
    """what does not read the index does not number the table."""

    def never(*_):
        raise AssertionError("the cloud was numbered")

    want = [_sorted(queries._named(metrics.miad(order_cloud(clouds.lineitem_cloud(spark, SF), HILBERT).ordered)))]
    monkeypatch.setattr(queries, "lineitem_cloud", never)
    assert [_sorted(queries._named(metrics.miad(queries._ordered(spark, SF))))] == want
    for name in ("dup_key_mass", "shared_key_split", "quant_diagnostics", "block_diameter", "block_checksum", "same_key_split"):
        assert queries.QUERIES[name](spark, SF).count() == 1


@pytest.mark.parametrize("n, block", [(3_000, 32), (33, 32), (70_001, 2), (1, 32), (0, 32)])
def test_diameters_form_no_rows_for_pairs(spark, n, block):
    """the widths are those of all pairs of a block, over runs that end within batches; single points are skipped."""
    points = np.random.default_rng(8).normal(size=(n, 3))
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points.tolist())], "rank long, x double, y double, z double")
    widths = metrics.block_widths(df, block)
    assert "Join" not in widths._jdf.queryExecution().toString()
    want = []
    for k in range(0, n, block):
        p = points[k : k + block]
        if len(p) > 1:
            want.append((k // block, float(np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)).max())))
    got = _sorted(widths)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    row = metrics.block_diameter(df, block).first()
    if want:
        d = sorted(w[1] for w in want)
        assert tuple(row) == (pytest.approx(np.mean(d)), pytest.approx(d[int(np.ceil(0.95 * len(d))) - 1]), len(d))
    else:
        assert tuple(row) == (None, None, 0)


def test_digests_hold_a_run_at_a_time(spark, monkeypatch):
    """no window's ids are gathered; counts and digests are those of all its ids, of runs and rows that are cut anywhere."""
    rng = np.random.default_rng(12)
    ids = {"a": rng.choice(5_000_000, 20_000, replace=False), "b": np.arange(9), "big": np.array([5, 1 << 41, 3, (1 << 41) + 7]), "none": np.array([], int)}
    pairs = [(q, int(k)) for q, ks in ids.items() for k in ks]
    rng.shuffle(pairs)
    matches = spark.createDataFrame([(str(q), int(k)) for q, k in pairs], "query_id string, raw_index long").repartition(3)
    windows = spark.createDataFrame([(q,) for q in ids], "query_id string")
    want = sorted((q, len(ks), hashlib.sha256(np.sort(ks).astype("<u8").tobytes()).hexdigest()) for q, ks in ids.items())
    got = workload.result_digests(matches, windows)
    assert _sorted(got) == want
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert _sorted(workload.result_digests(matches.filter("false"), windows)) == sorted((q, 0, hashlib.sha256().hexdigest()) for q in ids)
