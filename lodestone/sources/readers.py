"""Point-cloud readers and writers: XYZ and CSV text, PLY (ASCII and binary), archives, order files, windows."""

from __future__ import annotations

import gzip
import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ranking import with_row_number
from lodestone.schema import WINDOWS, OrderingError
from lodestone.sources.ply import ply_header, ranged, read_ply_ranges

def parsed_fields(line: Column) -> Column:
    """Fields of a text line: commas and semicolons count as blanks."""
    return F.split(F.trim(F.regexp_replace(line, r"[,;\s]+", " ")), " ")


def parse_line(line: Column) -> list[Column]:
    """x, y, z of a line's first three fields; null where one is no number. inf and nan are numbers here."""
    fields = parsed_fields(line)
    return [F.get(fields, k).try_cast("double") for k in range(3)]


def parse_lines(lines: DataFrame, order: str, strict: bool = False) -> DataFrame:
    """A cloud from lines (value, ``order``): blank lines are skipped, any other bad line is an error."""
    x, y, z = parse_line(F.col("value"))
    rows = lines.filter(F.trim("value") != "").select(
        order, x.alias("x"), y.alias("y"), z.alias("z"), F.size(parsed_fields(F.col("value"))).alias("_n")
    )
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    if strict:
        infinite = [F.isnan(c) | (F.abs(c) == float("inf")) for c in ("x", "y", "z")]
        bad = bad | (F.col("_n") != 3) | infinite[0] | infinite[1] | infinite[2]
    n = rows.filter(bad).count()
    if n:
        raise OrderingError("invalid_input", f"{n} lines are no points")
    return with_row_number(rows, [order], "raw_index").select("raw_index", "x", "y", "z")


def read_xyz(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Lines are numbered by file and place, so the index follows the files."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    return parse_lines(lines, "line", strict)


def ply_points(content: bytes) -> np.ndarray:
    """x, y, z of a PLY file's vertices, ASCII or binary, by property name."""
    h = ply_header(content)
    n, end = h.n, h.end
    if h.ascii:
        lines = content[end:].decode("ascii").split("\n")[:n]
        rows = [line.split() for line in lines if line.strip()]
        if len(rows) != n:
            raise ValueError(f"{len(rows)} of {n} vertices")
        out = np.array([[float(r[k]) for k in h.places] for r in rows]).reshape(-1, 3)
    else:
        if len(content) - end < n * h.record.itemsize:
            raise ValueError("the vertices are cut off")
        v = np.frombuffer(content, h.record, n, end)
        out = np.column_stack([v[c].astype(float) for c in "xyz"])
    if not np.isfinite(out).all():
        raise ValueError("points are not finite")
    return out


def _member(content: bytes, path: str, member: str | None) -> bytes:
    if path.endswith((".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
            if member is None:  # the only PLY file of the archive
                names = [m.name for m in t.getmembers() if m.isfile() and m.name.lower().endswith(".ply")]
                if len(names) != 1:
                    raise ValueError(f"{len(names)} PLY members; name one")
                member = names[0]
            found = t.extractfile(member)
            if found is None:
                raise ValueError(f"no member {member}")
            return found.read()
    return gzip.decompress(content) if path.endswith(".gz") else content


def read_ply(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """PLY files, plain, gzipped or as a member of a tar archive; each file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                points = ply_points(_member(bytes(content), name, member))
                frame = pd.DataFrame(points, columns=["x", "y", "z"])
                frame.insert(0, "at", np.arange(len(frame)))
                frame.insert(0, "path", name)
                yield frame

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(run, "path string, at long, x double, y double, z double")
    return with_row_number(rows, ["path", "at"], "raw_index").select("raw_index", "x", "y", "z")


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """By extension, whatever its case: .xyz, .csv, .ply (by ranges where Arrow knows the address), and archives of PLY."""
    name = path.lower()
    if name.endswith((".xyz", ".csv")):
        return read_xyz(spark, path)
    if name.endswith(".ply") and ranged(path):
        return read_ply_ranges(spark, path)
    if name.endswith((".ply", ".ply.gz", ".tar.gz", ".tgz")):
        return read_ply(spark, path)
    raise OrderingError("invalid_input", f"unknown extension of {path}")


def read_order(spark: SparkSession, path: str, n: int) -> DataFrame:
    """An order file (rank, raw_index, key): complete, each point once."""
    rows = spark.read.csv(path, schema="rank long, raw_index long, key long", header=True, enforceSchema=False, mode="FAILFAST")
    r = rows.agg(F.count("*"), F.countDistinct("rank"), F.countDistinct("raw_index"), F.min("rank"), F.max("rank"),
                 F.min("raw_index"), F.max("raw_index")).first()
    if tuple(r) != (n, n, n, *((0, n - 1, 0, n - 1) if n else (None,) * 4)):
        raise ValueError("the file is no permutation in order")
    return rows


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    from lodestone.operators.layout import checked_windows

    return checked_windows(spark.read.csv(path, schema=WINDOWS, header=True, enforceSchema=False, mode="FAILFAST"))


def write_order(ordered: DataFrame, path: str) -> None:
    """rank, raw_index and key as sorted CSV files; one file is a choice of the caller's coalesce."""
    ordered.select("rank", "raw_index", "key").orderBy("rank").write.csv(path, header=True)


def write_xyz(cloud: DataFrame, path: str) -> None:
    """Lines of x, y, z with 17 significant digits."""
    line = F.format_string("%.17g,%.17g,%.17g", "x", "y", "z")
    cloud.orderBy("raw_index").select(line.alias("value")).write.text(path)


def ply_text(points: np.ndarray) -> str:
    head = f"ply\nformat ascii 1.0\nelement vertex {len(points)}\n" + "".join(f"property double {c}\n" for c in "xyz")
    return head + "end_header\n" + "".join("%.17g %.17g %.17g\n" % tuple(p) for p in points)


def numeric_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Text cells as numbers: blank is missing, anything else must be a finite number."""
    bad = F.lit(False)
    for c in columns:
        v = F.col(c).try_cast("double")
        bad = bad | ((F.trim(c) != "") & (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    if not rows.filter(bad).isEmpty():
        raise ValueError("a cell is no finite number")
    return rows.withColumns({c: F.when(F.trim(c) != "", F.col(c).try_cast("double")) for c in columns})


def compression_ratio(payload: bytes, level: int = 6) -> float:
    import zlib

    return len(zlib.compress(payload, level)) / len(payload) if payload else 1.0
