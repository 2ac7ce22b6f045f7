"""PLY files read by ranges: the rows of a whole read, whatever the ranges."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.schema import OrderingError
from lodestone.sources import ply, readers

HEAD = "ply\nformat {} 1.0\ncomment end\nelement vertex {}\nproperty uchar c\nproperty double z\nproperty float w\nproperty double y\nproperty double x\n"
FACES = "element face 2\nproperty list uchar int vertex_indices\n"


def points(n):
    return np.random.default_rng(n).normal(size=(n, 3))


def binary(kind, p, faces=False):
    order = "<" if "little" in kind else ">"
    body = b"".join(struct.pack(order + "Bdfdd", 1, z, 0.5, y, x) for x, y, z in p)
    head = HEAD.format(kind, len(p)) + (FACES if faces else "") + "end_header\n"
    return head.encode() + body + (b"\x03" * 26 if faces else b"")


def text(p, faces=False, end="\n"):
    head = HEAD.format("ascii", len(p)) + (FACES if faces else "") + "end_header\n"
    lines = ["1 %.17g 0.5 %.17g %.17g" % (z, y, x) for x, y, z in p] + (["3 0 1 2", "3 1 2 0"] if faces else [])
    return (head + "".join(line + end for line in lines)).encode()


def rows(df):
    return [tuple(r) for r in df.select("raw_index", "x", "y", "z").orderBy("raw_index").collect()]


def numbered(p):
    return [(i, *map(float, q)) for i, q in enumerate(p)]


@pytest.mark.parametrize("size", [1, 100, 1000, 1 << 20])
def test_any_range_gives_the_same_rows(spark, tmp_path, size):
    p = points(40 if size == 1 else 300)
    contents = {
        "little": binary("binary_little_endian", p), "big": binary("binary_big_endian", p, faces=True),
        "text": text(p), "faces": text(p, faces=True), "blank": text(p, end="\n\n"), "crlf": text(p, end="\r\n"),
    }
    for name, content in contents.items():
        if size == 1 and name not in ("little",):
            continue  # a task for each byte of a text
        (tmp_path / f"{name}.ply").write_bytes(content)
        assert rows(ply.read_ply_ranges(spark, str(tmp_path / f"{name}.ply"), size)) == numbered(p), name


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    p = points(1000)
    (tmp_path / "a.ply").write_bytes(binary("binary_little_endian", p))
    read = ply.read_ply_ranges(spark, str(tmp_path / "a.ply"), 2900)  # 29 bytes a vertex
    sizes = [r["count"] for r in read.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sizes == [100] * 10
    assert "Exchange" not in read._jdf.queryExecution().executedPlan().toString()


def test_files_of_a_folder_follow_each_other(spark, tmp_path):
    a, b, c = points(50), points(70), points(30)
    (tmp_path / "a.ply").write_bytes(text(a, faces=True))
    (tmp_path / "b.PLY").write_bytes(binary("binary_big_endian", b))
    (tmp_path / "c.ply").write_bytes(text(c))
    (tmp_path / "empty.ply").write_bytes(text(points(0)))
    (tmp_path / "notes.txt").write_text("no cloud")
    assert rows(ply.read_ply_ranges(spark, str(tmp_path), 500)) == numbered(np.concatenate([a, b, c]))


def test_empty_and_damaged_files(spark, tmp_path):
    at = tmp_path / "a.ply"
    for content in (text(points(0)), binary("binary_little_endian", points(0))):
        at.write_bytes(content)
        assert rows(ply.read_ply_ranges(spark, str(at))) == []
    at.write_bytes(b"".join(text(points(5)).splitlines(keepends=True)[:-1]))
    with pytest.raises(OrderingError):
        ply.read_ply_ranges(spark, str(at))
    at.write_bytes(binary("binary_little_endian", points(5))[:-1])
    with pytest.raises(Exception, match="cut off"):
        ply.read_ply_ranges(spark, str(at)).collect()
    for bad in (np.inf, np.nan):
        p = points(5)
        p[3, 1] = bad
        for content in (text(p), binary("binary_big_endian", p)):
            at.write_bytes(content)
            with pytest.raises(Exception, match="not finite"):
                ply.read_ply_ranges(spark, str(at)).collect()
    at.write_bytes(b"solid\n")
    with pytest.raises(ValueError, match="no PLY header"):
        ply.read_ply_ranges(spark, str(at))


def test_read_cloud_reads_by_ranges(spark, tmp_path):
    p = points(20)
    (tmp_path / "a.ply").write_bytes(text(p))
    assert rows(readers.read_cloud(spark, str(tmp_path / "a.ply"))) == numbered(p)
    assert rows(readers.read_ply(spark, str(tmp_path / "a.ply"))) == numbered(p)
