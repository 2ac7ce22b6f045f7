"""Tables written on the way, in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset a folder under /tmp, for a local master only."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_lodestone_folder", None)
    if made is None:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        made = spark._lodestone_folder = "file://" + tempfile.mkdtemp(prefix="lodestone-", dir="/tmp/checkpoints")
    return made


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once and read back: lineage ends there, and a lost executor costs a reread."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(df: DataFrame) -> tuple:
    """The files behind a table with their sizes and times: whoever rewrites the table changes it."""
    about = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return tuple(sorted(tuple(map(str, r)) for r in about.toLocalIterator()))


def kept(key: tuple, source: DataFrame, make):
    """What ``make()`` gives, made once in a session for each state of ``source``'s files."""
    spark = source.sparkSession
    at = (*key, shared_folder(spark), fingerprint(source))
    made = spark.__dict__.setdefault("_lodestone_kept", {})
    if at not in made:
        made[at] = make()
    return made[at]


def stored(key: tuple, source: DataFrame, make, what: str) -> DataFrame:
    """The table that ``make()`` gives, written once in a session for each state of ``source``'s files."""
    return kept(key, source, lambda: cut(make(), what))
