"""Stored pages: whole pages in files, files left unopened, damage found; and a workload run from them."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import layout
from lodestone.operators.ordering import OrderingConfig, order_cloud
from lodestone.plans import workload

CLOUD = "raw_index long, x double, y double, z double"
N = 2_000


@pytest.fixture(scope="module")
def cloud(spark):
    draw = random.Random(5)
    return spark.createDataFrame([(i, draw.random(), draw.random(), draw.random()) for i in range(N)], CLOUD)


@pytest.fixture(scope="module")
def path(cloud, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layout") / "a")
    layout.write_layout(order_cloud(cloud, OrderingConfig(method="hilbert", bits="uniform")).ordered, path, pages_per_file=3)
    return path


@pytest.fixture(scope="module")
def windows(spark):
    rows = [("all", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("corner", 0.0, 0.0, 0.0, 0.05, 0.05, 0.05), ("none", 2.0, 2.0, 2.0, 3.0, 3.0, 3.0)]
    return spark.createDataFrame(rows, workload.WINDOWS)


def ids(found):
    out = {}
    for r in found.collect():
        out.setdefault(r["query_id"], set()).add(r["raw_index"])
    return out


def test_pages_stay_whole(spark, path):
    points, directory = layout.read_layout(spark, path)
    pages = -(-N // layout.PAGE)
    assert directory.count() == pages and points.count() == N
    by_file = points.groupBy("file_id").agg(F.min("page_id"), F.max("page_id"), F.count("*")).collect()
    assert sorted(r[0] for r in by_file) == list(range(-(-pages // 3)))
    assert all(r[1] == 3 * r[0] and r[2] == min(3 * r[0] + 2, pages - 1) for r in by_file)
    assert all(len(glob.glob(f"{path}/points/file_id={r[0]}/*.parquet")) == 1 for r in by_file)
    with pytest.raises(ValueError, match="a page at least"):
        layout.write_layout(points, path + "-none", 0)


def test_windows_open_only_the_files_they_need(spark, cloud, path, windows):
    points, directory = layout.read_layout(spark, path)
    assert ids(layout.pruned_query(points, directory, windows)) == ids(layout.full_scan(cloud, windows))
    corner = windows.filter("query_id = 'corner'")
    needed = {r[0] // 3 for r in layout.candidates(directory, corner).select("page_id").collect()}
    found = layout.pruned_query(points, directory, corner)
    assert ids(found) == ids(layout.full_scan(cloud, corner))
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [file_id" in plan or "file_id IN" in plan or "PartitionFilters: [isnotnull(file_id" in plan
    assert 0 < len(needed) < points.select("file_id").distinct().count()
    assert layout.pruned_query(points, directory, windows.filter("query_id = 'none'")).isEmpty()


def test_damage_is_found(spark, path, tmp_path):
    points, directory = layout.read_layout(spark, path)
    assert layout.damaged_pages(points, directory).isEmpty()
    changed = points.withColumn("x", F.when(F.col("rank") == 700, F.col("x") + 1e-9).otherwise(F.col("x")))
    assert [r["page_id"] for r in layout.damaged_pages(changed, directory).collect()] == [700 // layout.PAGE]
    lost = layout.damaged_pages(points.filter("file_id <> 1"), directory).collect()
    assert sorted(r["page_id"] for r in lost) == [3, 4, 5] and all(r["found"] is None for r in lost)
    twice = points.union(points.filter("rank = 5"))
    assert [r["page_id"] for r in layout.damaged_pages(twice, directory).collect()] == [0]


def test_a_frozen_workload(spark, cloud, windows, tmp_path):
    frozen = str(tmp_path / "frozen")
    workload.write_frozen(windows, workload.result_digests(layout.full_scan(cloud, windows), windows), frozen)
    read = workload.read_frozen(spark, frozen)
    ordered = order_cloud(cloud, OrderingConfig(method="morton", bits="uniform")).ordered
    done = {r["query_id"]: r for r in workload.run_workflow(ordered, read, str(tmp_path / "stored"), 4).collect()}
    assert all(r["oracle_match"] for r in done.values()) and done["all"]["result_count"] == N and done["none"]["result_count"] == 0
    other = read.withColumn("ids_sha256", F.when(F.col("query_id") == "corner", F.lit("0" * 64)).otherwise(F.col("ids_sha256")))
    done = workload.answered(layout.read_layout(spark, str(tmp_path / "stored")), other).collect()
    assert {r["query_id"]: r["oracle_match"] for r in done} == {"all": True, "corner": False, "none": True}
    read.withColumn("query_id", F.lit("a b")).write.csv(str(tmp_path / "bad"), sep="\t", header=True)
    with pytest.raises(ValueError, match="unsound rows"):
        workload.read_frozen(spark, str(tmp_path / "bad"))
