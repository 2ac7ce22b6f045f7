"""PLY files as a source read by ranges: vertices of one file are dealt over tasks, binary ones without a shuffle.

A range is a run of whole binary vertices, or the text lines that begin in a run of bytes.  The place of a binary
vertex follows from where its range begins; text lines are counted range by range first, which gives as many rows as
there are ranges.  Files are opened through ``pyarrow.fs``, so an address is a local path or one that Arrow knows.
"""

from __future__ import annotations

import io
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.schema import OrderingError

#: Scalar types of PLY headers.  Fixed values.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2",
    "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4",
    "double": "f8", "float64": "f8",
}

#: Bytes of a range, and vertices of a batch.
RANGE, BATCH = 32 << 20, 1 << 16
#: A header is longer than this only by mistake.
LONGEST_HEADER = 1 << 20

MARK = b"end_header"


@dataclass(frozen=True)
class Header:
    """What a PLY header says of the vertices, and where they begin."""

    kind: str
    names: tuple[tuple[str, str], ...]
    n: int
    end: int

    @property
    def ascii(self) -> bool:
        return self.kind == "ascii"

    @property
    def record(self) -> np.dtype:
        order = {"binary_little_endian": "<", "binary_big_endian": ">"}[self.kind]
        return np.dtype([(k, order + t) for k, t in self.names])

    @property
    def places(self) -> list[int]:
        """Where x, y and z stand among a vertex's properties."""
        at = [k for k, _ in self.names]
        return [at.index(c) for c in "xyz"]


def ply_header(content: bytes) -> Header:
    """The header at the beginning of a file's content."""
    end = content.index(MARK) + len(MARK)
    end = content.index(b"\n", end) + 1
    header = content[:end].decode("ascii").split("\n")
    if header[0].strip() != "ply":
        raise ValueError("not a PLY file")
    kind, element, names, n = None, None, [], None
    for line in header[1:]:
        part = line.split()
        if not part or part[0] in ("comment", "obj_info", "end_header"):
            continue
        if part[0] == "format":
            kind = part[1]
        elif part[0] == "element":
            if n is None and part[1] != "vertex":
                raise ValueError("elements before the vertices are not supported")
            if part[1] == "vertex" and n is not None:
                raise ValueError("two vertex elements")
            element = part[1]
            n = int(part[2]) if element == "vertex" else n
        elif part[0] == "property" and element == "vertex":
            if part[1] == "list":
                raise ValueError("list properties of vertices are not supported")
            names.append((part[2], PLY_TYPES[part[1]]))
    if n is None or not {"x", "y", "z"} <= {k for k, _ in names}:
        raise ValueError("no vertices with x, y and z")
    if kind not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown format {kind}")
    return Header(kind, tuple(names), n, end)


def ranged(path: str) -> bool:
    """Whether Arrow's file systems know the address, and it names one file or folder."""
    scheme = path.split("://")[0] if "://" in path else path.split(":")[0] if path.startswith("file:") else ""
    return scheme in ("", "file", "hdfs", "s3", "gs", "abfs", "abfss") and not set("*?[{,") & set(path)


def _address(path: str) -> str:
    """Local paths whole, as Arrow asks for."""
    return os.path.abspath(path) if ":" not in path else path


def _opened(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(_address(path))
    return system.open_input_file(name)


def _files(path: str) -> list[tuple[str, int]]:
    """(address, size) of a file, or of the PLY files of a folder by name."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(_address(path))
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no file {path}")
    if info.is_file:
        return [(path, info.size)]
    inside = [f for f in system.get_file_info(fs.FileSelector(name)) if f.is_file and f.base_name.lower().endswith(".ply")]
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(inside, key=lambda f: f.base_name)]


def _header_of(path: str) -> Header:
    with _opened(path) as f:
        read, size = b"", 4096
        while (at := read.find(MARK)) < 0 or b"\n" not in read[at:]:
            more = f.read(size)
            if not more or len(read) > LONGEST_HEADER:
                raise ValueError(f"no PLY header in {path}")
            read += more
    return ply_header(read)


@dataclass
class Range(InputPartition):
    """Bytes ``begin`` to ``end`` of a file that ``base`` vertices of other files come before."""

    file: int
    path: str
    base: int
    header: Header
    begin: int
    end: int


class PlyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options["kind"]
        self.range = int(options.get("rangebytes", RANGE))

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for k, (path, size) in enumerate(_files(self.path)):
            header = _header_of(path)
            if header.ascii:
                end, step = size, self.range
            else:
                width = header.record.itemsize
                end, step = header.end + header.n * width, max(self.range // width, 1) * width
                if end > size:
                    raise ValueError(f"the vertices of {path} are cut off")
            if header.ascii == (self.kind == "ascii"):
                out += [Range(k, path, base, header, b, min(b + step, end)) for b in range(header.end, max(end, header.end + 1), step)]
            base += header.n
        return out or [None]

    def read(self, partition: Range | None) -> Iterator:
        import pyarrow as pa

        if partition is None:
            return
        p, first = partition, 0
        for points in _lines(p) if p.header.ascii else _vertices(p):
            m = len(points)
            if m:
                before = first if p.header.ascii else first + (p.begin - p.header.end) // p.header.record.itemsize
                whole = (p.file, p.base, p.header.n, p.begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, v)) for v in whole]
                    + [pa.array(np.arange(before, before + m))]
                    + [pa.array(np.ascontiguousarray(points[:, a])) for a in range(3)],
                    names=["file", "base", "n", "begin", "place", "x", "y", "z"],
                )
            first += m


def _vertices(p: Range) -> Iterator[np.ndarray]:
    record, left = p.header.record, p.end - p.begin
    with _opened(p.path) as f:
        f.seek(p.begin)
        while left > 0:
            content = f.read(min(left, BATCH * record.itemsize))
            if not content or len(content) % record.itemsize:
                raise ValueError(f"the vertices of {p.path} are cut off")
            left -= len(content)
            v = np.frombuffer(content, record)
            yield np.column_stack([v[c].astype(float) for c in "xyz"])


def _number(text: bytes) -> float:
    """nan for what is no number: the rows of later elements are told apart only once lines are counted."""
    try:
        return float(text)
    except ValueError:
        return float("nan")


def _lines(p: Range) -> Iterator[np.ndarray]:
    """x, y and z of each line with a character that begins in the range."""
    at, rows = p.header.places, []
    with _opened(p.path) as raw:
        f, here = io.BufferedReader(raw, 1 << 20), p.begin
        if here > p.header.end:  # the line that the byte before belongs to begins in an earlier range
            f.seek(here - 1)
            here += len(f.readline()) - 1
        else:
            f.seek(here)
        while here < p.end and (line := f.readline()):
            here += len(line)
            if part := line.split():
                rows.append([_number(part[k]) if k < len(part) else float("nan") for k in at])
            if len(rows) == BATCH:
                yield np.array(rows)
                rows = []
    yield np.array(rows).reshape(-1, 3)


class PlySource(DataSource):
    """Options: ``path``, ``kind`` (ascii or binary: files of the other kind are only counted), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_ply"

    def schema(self) -> str:
        return "file long, base long, n long, begin long, place long, x double, y double, z double"

    def reader(self, schema) -> DataSourceReader:
        return PlyReader(self.options)


def _checked(rows: DataFrame, place) -> DataFrame:
    """A task that meets a vertex that is not finite fails."""
    finite = ~(F.isnan("x") | F.isnan("y") | F.isnan("z")) & (F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) < float("inf"))
    index = F.when(finite, F.col("base") + place).otherwise(F.raise_error(F.lit("points are not finite")).cast("long"))
    return rows.select(index.alias("raw_index"), "x", "y", "z")


def read_ply_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The cloud of a PLY file, or of a folder of them by name, read by ranges.

    Blank lines among text vertices are skipped; what follows the vertices is not looked at.  An empty file's cloud
    is empty; fewer vertices than the header says, or ones that are not finite, are an error.
    """
    headers = [_header_of(name) for name, _ in _files(path)]
    spark.dataSource.register(PlySource)
    scan = lambda kind: spark.read.format("lodestone_ply").options(path=path, kind=kind, rangeBytes=range_bytes).load()
    binary = _checked(scan("binary"), F.col("place"))
    if not any(h.ascii for h in headers):
        return binary
    lines = scan("ascii")
    # a row for each range
    counts = lines.groupBy("file", "n", "begin").agg(F.count("*").alias("lines"))
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "begin", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    found = counts.groupBy("file", "n").agg(F.sum("lines").alias("lines"))
    whole = found.filter(F.col("lines") >= F.col("n")).count() + sum(h.ascii and h.n == 0 for h in headers)
    if whole < sum(h.ascii for h in headers):
        raise OrderingError("invalid_input", "a file has fewer vertices than its header says")
    place = F.col("start") + F.col("place")
    text = _checked(lines.join(starts, ["file", "begin"]).filter(place < F.col("n")), place)
    return text if all(h.ascii for h in headers) else binary.unionByName(text)
