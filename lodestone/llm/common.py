"""Helpers shared by the corpus operators."""

from __future__ import annotations

import inspect
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Code points of white space but for space and line feed.  Fixed values.
_ODD = (9, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ODD_SPACE = re.compile("[" + "".join(map(chr, _ODD)) + "]")
#: A run of white space and what follows it; Python's white space also has the four separators 1C to 1F.
CHUNK = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset a folder under /tmp is made, and only for a local master: executors on other
    machines would not see it.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_lodestone_shared", None)
    if made is None:
        import os

        os.makedirs("/tmp/checkpoints", exist_ok=True)
        made = "file://" + tempfile.mkdtemp(prefix="lodestone-", dir="/tmp/checkpoints")
        spark._lodestone_shared = made
    return made


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/lodestone/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    The lineage ends there, so a lost executor costs a reread and no recomputation, and whatever
    uses the rows twice computes them once.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_in(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unique(what: str) -> str:
    """A column name that no caller's column has."""
    return f"_{what}_{uuid.uuid4().hex}"


def columns_of(docs: DataFrame) -> list[Column]:
    """The caller's columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def over_arrays(run, schema: str, *columns: Column) -> Column:
    """What ``run`` makes of the columns: a generator over Arrow arrays, or tuples of them for several columns.

    Only these columns go to Python; the rest of the row waits in the JVM.
    """
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    given = pa.Array if len(columns) == 1 else tuple[pa.Array, ...]
    run.__annotations__ = {next(iter(inspect.signature(run).parameters)): Iterator[given], "return": Iterator[pa.Array]}
    return arrow_udf(run, schema)(*columns)


def slices(batches: Iterator, rows: int = 1024) -> Iterator:
    """Batches of so many rows at most: what a worker makes of a batch at once is bounded with it."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.slice(k, rows)


def give_back() -> None:
    """Return to the system what a worker has freed: Arrow's pool and the C library keep it otherwise, and workers live on."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; an expression within a lambda is not shared otherwise."""
    return F.element_at(F.transform(F.array(value), body), 1)
