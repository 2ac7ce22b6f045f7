"""Frozen window workloads: nested sizes, their file form, and a run that stores and queries in one go."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import layout
from lodestone.schema import WINDOWS

#: Windows of a block; larger workloads are more blocks, so a smaller one is their start.
BLOCK = 256


def nested_workload(lo: list[float], hi: list[float], seed: int, n: int = BLOCK) -> list[tuple]:
    if n % BLOCK:
        raise ValueError(f"a workload has whole blocks of {BLOCK} windows")
    return [w for k in range(n // BLOCK) for w in layout.workload(lo, hi, seed + k, BLOCK)]


#: Bits of an id within its run; pairs that are packed at once; ids of a packed row, which bounds a batch of rows.
RUN_BITS, AT_ONCE, IDS = 20, 1 << 21, 1 << 12


def result_digests(matches: DataFrame, windows: DataFrame) -> DataFrame:
    """Count and SHA-256 of each window's ids, ascending, as little-endian 64-bit numbers.

    Ids travel packed by runs of ``2 ** RUN_BITS``.  A window's runs pass through one task in order, as its digest is a running
    one, which holds a run at a time.
    """
    runs = matches.filter("raw_index is not null").select("query_id", "raw_index").mapInArrow(_pack, "query_id string, run long, ids binary")
    dealt = runs.repartition("query_id").sortWithinPartitions("query_id", "run")
    found = dealt.mapInArrow(_hash, "query_id string, n long, digest string")
    rows = windows.select("query_id").join(found, "query_id", "left")
    return rows.select(
        "query_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("result_count"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ids_sha256"),
    )


def _pack(batches):
    """(query_id, raw_index) to (query_id, run, the ids' places in the run as 32-bit numbers)."""
    import numpy as np
    import pyarrow as pa

    def packed(held: list) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        names = table["query_id"].combine_chunks().dictionary_encode()
        of, ids = names.indices.to_numpy(), table["raw_index"].to_numpy()
        order = np.lexsort((ids, of)) if len(ids) and ids.max() >> 40 else np.argsort(of.astype(np.int64) << 40 | ids)
        of, run, place = of[order], ids[order] >> RUN_BITS, (ids[order] & ((1 << RUN_BITS) - 1)).astype("<u4")
        new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(run, prepend=-1) != 0))
        ends = np.append(new[1:], len(ids))
        spans = [(a, min(a + IDS, b)) for begin, b in zip(new.tolist(), ends.tolist()) for a in range(begin, b, IDS)]
        starts = np.array([a for a, _ in spans], np.int64)
        return pa.RecordBatch.from_arrays(
            [
                names.dictionary.take(pa.array(of[starts])).cast(pa.string()),
                pa.array(run[starts], pa.int64()),
                pa.array([place[a:b].tobytes() for a, b in spans], pa.binary()),
            ],
            names=["query_id", "run", "ids"],
        )

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= AT_ONCE:
            yield packed(held)
            held, size = [], 0
    if size:
        yield packed(held)


def _hash(batches):
    """Packed rows in the order of windows and runs to each window's count and digest."""
    import numpy as np
    import pyarrow as pa

    at, held, n, digest, done = (None, None), [], 0, None, []

    def close_run() -> int:
        places = np.sort(np.frombuffer(b"".join(held), "<u4")).astype("<u8")
        digest.update((places + np.uint64(at[1] << RUN_BITS)).tobytes())
        return len(places)

    for batch in batches:
        for query, run, ids in zip(*(batch.column(c).to_pylist() for c in ("query_id", "run", "ids"))):
            if (query, run) != at:
                if held:
                    n += close_run()
                if query != at[0]:
                    if digest:
                        done.append((at[0], n, digest.hexdigest()))
                    n, digest = 0, hashlib.sha256()
                at, held = (query, run), []
            held.append(ids)
    if held:
        n += close_run()
        done.append((at[0], n, digest.hexdigest()))
    columns = zip(*done) if done else ([], [], [])
    kinds = (pa.string(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["query_id", "n", "digest"])


def write_frozen(windows: DataFrame, digests: DataFrame, path: str) -> None:
    """query_id, six bounds, expected count and digest, tab-separated."""
    columns = [c.split()[0] for c in WINDOWS.split(", ")]
    rows = windows.select(*columns).join(digests, "query_id").select(*columns, "result_count", "ids_sha256")
    # into one file without the sample of a global order, which would answer the windows again
    rows.repartition(1).sortWithinPartitions("query_id").write.csv(path, sep="\t", header=True)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    schema = f"{WINDOWS}, result_count long, ids_sha256 string"
    rows = spark.read.csv(path, schema=schema, sep="\t", header=True, enforceSchema=False, mode="FAILFAST")
    if not rows.filter("query_id is null or not query_id rlike '^[A-Za-z0-9_.-]+$' or result_count < 0").isEmpty():
        raise ValueError("the workload has unsound rows")
    return layout.checked_windows(rows)


def answered(stored: tuple[DataFrame, DataFrame], frozen: DataFrame) -> DataFrame:
    """A frozen workload answered from stored pages and compared with what it expects."""
    points, directory = stored
    windows = frozen.drop("result_count", "ids_sha256")
    got = result_digests(layout.pruned_query(points, directory, windows), windows)
    want = frozen.select("query_id", F.col("result_count").alias("n"), F.col("ids_sha256").alias("digest"))
    return got.join(want, "query_id").withColumn("oracle_match", F.expr("result_count = n and ids_sha256 = digest"))


def run_workflow(ordered: DataFrame, frozen: DataFrame, path: str, pages_per_file: int = 8192) -> DataFrame:
    """Store an order and answer a frozen workload from it."""
    layout.write_layout(ordered, path, pages_per_file)
    return answered(layout.read_layout(ordered.sparkSession, path), frozen)
