"""Readers, generators, layouts, streaming and SQL functions."""

import gzip
import io
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import curves, sql
from lodestone.operators import layout, metrics
from lodestone.operators.ordering import OrderingConfig, order_cloud
from lodestone.schema import OrderingError
from lodestone.sources import generators, readers
from lodestone.streaming.append import FrozenQuantizer, start_append

POINTS = np.array([[0.5, -1.25, 3.0], [1e-300, 2.0, -0.0], [7.0, 8.5, 9.75]])


def rows(df):
    return [(r["x"], r["y"], r["z"]) for r in df.orderBy("raw_index").collect()]


def test_xyz_round_trip(spark, tmp_path):
    cloud = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(POINTS)], "raw_index long, x double, y double, z double")
    readers.write_xyz(cloud.coalesce(1), str(tmp_path / "a.csv"))
    assert rows(readers.read_cloud(spark, str(tmp_path / "a.csv"))) == [tuple(p) for p in POINTS.tolist()]


def test_xyz_lines(spark, tmp_path):
    (tmp_path / "b.xyz").write_text("1,2;3 rest\n\n  4 5 6\n")
    assert rows(readers.read_cloud(spark, str(tmp_path / "b.xyz"))) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    with pytest.raises(OrderingError):
        readers.read_xyz(spark, str(tmp_path / "b.xyz"), strict=True)
    (tmp_path / "c.xyz").write_text("1 2\n")
    with pytest.raises(OrderingError):
        readers.read_cloud(spark, str(tmp_path / "c.xyz"))


def test_ply_forms(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 3\nproperty float w\nproperty double z\nproperty double y\nproperty double x\nend_header\n"
    for kind, order in (("binary_little_endian", "<"), ("binary_big_endian", ">")):
        body = b"".join(struct.pack(order + "fddd", 1, z, y, x) for x, y, z in POINTS)
        (tmp_path / f"{kind}.ply").write_bytes(head.format(kind).encode() + body)
        assert rows(readers.read_cloud(spark, str(tmp_path / f"{kind}.ply"))) == [tuple(p) for p in POINTS.tolist()]
    text = readers.ply_text(POINTS).encode()
    (tmp_path / "a.ply.gz").write_bytes(gzip.compress(text))
    assert len(rows(readers.read_cloud(spark, str(tmp_path / "a.ply.gz")))) == 3
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("d/a.ply")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text))
    assert len(rows(readers.read_ply(spark, str(tmp_path / "a.tar.gz"), "d/a.ply"))) == 3
    with pytest.raises(ValueError):
        readers.ply_points(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nend_header\n1\n2\n")


def test_order_file(spark, tmp_path):
    cloud = generators.cloud(spark, "torus", 50, 1)
    ordered = order_cloud(cloud, OrderingConfig(method="hilbert", bits="uniform")).ordered
    readers.write_order(ordered, str(tmp_path / "o"))
    assert readers.read_order(spark, str(tmp_path / "o"), 50).count() == 50
    with pytest.raises(ValueError):
        readers.read_order(spark, str(tmp_path / "o"), 51)


def test_generators_do_not_depend_on_the_split(spark):
    for family in generators.FAMILIES:
        a = generators.cloud(spark, family, 97, 11).repartition(1).orderBy("raw_index").toPandas()
        b = generators.cloud(spark, family, 97, 11).repartition(5).orderBy("raw_index").toPandas()
        assert a.equals(b) and np.isfinite(a.to_numpy()).all()


def test_contamination_keeps_inliers_and_places_outliers_outside(spark):
    clean = generators.cloud(spark, "ellipsoid", 200, 2)
    for mode in ("uniform_bbox", "clustered"):
        dirty = generators.contaminate(clean, mode, 0.25, 4).orderBy("raw_index").toPandas()
        assert len(dirty) == 250
        p = clean.orderBy("raw_index").toPandas()
        assert dirty[:200].equals(p)
        lo, hi = p[["x", "y", "z"]].min().to_numpy(), p[["x", "y", "z"]].max().to_numpy()
        o = dirty[200:][["x", "y", "z"]].to_numpy()
        assert ((o < lo) | (o > hi)).any(axis=1).all()


def test_layout_answers_every_window_like_a_full_scan(spark, tmp_path):
    cloud = generators.cloud(spark, "mixture", 2000, 9)
    ordered = order_cloud(cloud, OrderingConfig(method="hilbert", bits="uniform")).ordered
    layout.write_layout(ordered, str(tmp_path / "l"))
    points, directory = layout.read_layout(spark, str(tmp_path / "l"))
    b = points.agg(*(F.min(c) for c in "xyz"), *(F.max(c) for c in "xyz")).first()
    from lodestone.schema import WINDOWS

    windows = spark.createDataFrame(layout.workload(list(b[:3]), list(b[3:]), 5, 30), WINDOWS)
    a = {tuple(r) for r in layout.pruned_query(points, directory, windows).collect()}
    assert a == {tuple(r) for r in layout.full_scan(points, windows).collect()}
    assert layout.directory_violations(points, directory).isEmpty()
    with pytest.raises(ValueError):
        layout.checked_windows(windows.union(windows))


def test_large_forms_of_metrics(spark):
    cloud = generators.cloud(spark, "ellipsoid", 150, 6)
    a = order_cloud(cloud, OrderingConfig(method="hilbert", bits="uniform")).ordered
    b = order_cloud(cloud, OrderingConfig(method="lexicographic")).ordered
    small = metrics.kendall_tau(a, b, 140).first()
    assert metrics.kendall_tau_big(a, b, 140, 8) == (small["concordant"], small["discordant"])
    assert metrics.l1_by_bands(a, 16) == pytest.approx(metrics.l1_l2_locality(a).first()["l1"])


def test_stream_gives_the_keys_of_a_batch(spark, tmp_path):
    cloud = generators.cloud(spark, "patch", 300, 8)
    cloud.write.parquet(str(tmp_path / "in"))
    quantizer = FrozenQuantizer((0.0, 0.0, 0.0), ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), (1.0, 1.0, 2.0), (8, 8, 6))
    stream = spark.readStream.schema("raw_index long, x double, y double, z double").parquet(str(tmp_path / "in"))
    start_append(stream, quantizer, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["raw_index"]: r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["raw_index"]: r["key"] for r in quantizer.keyed(cloud).collect()}


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select quantize_axis(0.5, 0, 1, 3) a, morton3(5L, 3L, 6L) b, hilbert3(5L, 3L, 6L, 3) c").first()
    q = np.array([[5, 3, 6]])
    assert tuple(row) == (4, curves.morton_array(q, (3, 3, 3))[0], curves.hilbert_array(q, (3, 3, 3))[0])
