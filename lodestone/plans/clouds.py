"""Clouds over the driver's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.ranking import with_row_number
from lodestone.functions.store import kept, stored

LINEITEM = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What a point of the line-item cloud has, and the column that it comes from.
POINT = {"x": "l_quantity", "y": "l_extendedprice", "z": "l_discount", "cloud_id": "l_suppkey", "flag": "l_returnflag"}


def _point() -> list[Column]:
    return [F.col(c).alias(name) for name, c in POINT.items()]


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quantity, price and discount of every line, unnumbered: for what does not read the index."""
    return table(spark, sf_dir, "lineitem").select(*_point())


def lineitem_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`lineitem_points` with an index that follows all columns, which make rows distinct.

    Rows are numbered once in a session and kept in the shared folder, for as long as the table's files stay as they are.
    """
    lines = table(spark, sf_dir, "lineitem")
    # numbering writes the rows, so they are kept as it wrote them
    number = lambda: with_row_number(lines.select(*LINEITEM), list(LINEITEM), "raw_index", _point())
    return kept(("lineitem_cloud", sf_dir), lines, number).select("raw_index", *POINT)


def embed_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), F.col("label").alias("cloud_id")
    )
    return stored(("embed_cloud", sf_dir), table(spark, sf_dir, "embeddings"), lambda: with_row_number(rows, ["vec_id"], "raw_index").drop("vec_id"), "embed-cloud")


def events_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    rows = table(spark, sf_dir, "events").select(
        "event_id", at.alias("x"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("z"),
        F.col("event_type").alias("cloud_id"),
    )
    return stored(("events_cloud", sf_dir), table(spark, sf_dir, "events"), lambda: with_row_number(rows, ["event_id"], "raw_index").drop("event_id"), "events-cloud")


CLOUD_SQL = f"""
cloud AS (SELECT row_number() OVER (ORDER BY {", ".join(LINEITEM)}) - 1 AS raw_index, l_quantity AS x,
  l_extendedprice AS y, l_discount AS z, l_suppkey AS cloud_id, l_returnflag AS flag FROM lineitem)"""
EMBED_SQL = """
cloud AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS raw_index, embedding[1]::DOUBLE AS x,
  embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label AS cloud_id FROM embeddings)"""
EVENTS_SQL = """
cloud AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS raw_index, epoch_us(ts) / 3.6e9 AS x,
  user_id::DOUBLE AS y, value AS z, event_type AS cloud_id FROM events)"""
BOX_SQL = """
box AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz, count(*) AS n
  FROM cloud)"""


def cells_sql(bits: tuple[int, int, int]) -> str:
    """Cells of the raw box, as ``cells`` after ``cloud`` and ``box``."""

    def one(c: str, b: int) -> str:
        top = (1 << b) - 1
        if not b:
            return f"0::BIGINT AS q{c}"
        return (
            f"CASE WHEN l{c} >= h{c} OR {c} <= l{c} THEN 0 WHEN {c} >= h{c} THEN {top} "
            f"ELSE least(floor(({c} - l{c}) / (h{c} - l{c}) * {float(2**b)})::BIGINT, {top}) END::BIGINT AS q{c}"
        )

    parts = ", ".join(one(c, b) for c, b in zip("xyz", bits))
    return f"cells AS (SELECT raw_index, x, y, z, cloud_id, {parts} FROM cloud, box)"


def morton_sql(bits: tuple[int, int, int]) -> str:
    from lodestone.functions.curves import key_layout

    terms = (f"(((q{'xyz'[a]} >> {level}) & 1) << {place})" for a, level, place in key_layout(bits))
    return f"keyed AS (SELECT *, ({' | '.join(terms)})::BIGINT AS key FROM cells)"


def hilbert_sql(bits: tuple[int, int, int]) -> str:
    """The fold written out level by level, with its tables as lists."""
    from lodestone.functions.curves import masks, steps

    out, last = [], "cells"
    fields = "raw_index, x, y, z, cloud_id, qx, qy, qz"
    for k, mask in enumerate(masks(bits)):
        level = max(bits) - 1 - k
        append, follow, _ = steps(mask)
        state, key = ("s", "key") if k else ("0", "0::BIGINT")
        place = f"({state}) * 8 + ((qx >> {level}) & 1) + ((qy >> {level}) & 1) * 2 + ((qz >> {level}) & 1) * 4"
        out.append(f"p{k} AS (SELECT {fields}, {key} AS key, ({place})::INT AS p FROM {last})")
        n = bin(mask).count("1")
        out.append(
            f"h{k} AS (SELECT {fields}, ((key << {n}) + {list(append)}[p + 1])::BIGINT AS key, "
            f"{list(follow)}[p + 1] AS s FROM p{k})"
        )
        last = f"h{k}"
    return ", ".join(out) + f", keyed AS (SELECT * FROM {last})"


ORDER_SQL = "ordered AS (SELECT *, row_number() OVER (ORDER BY key, x, y, z, raw_index) - 1 AS rank FROM keyed)"
