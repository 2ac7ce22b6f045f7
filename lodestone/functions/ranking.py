"""Dense row numbers, running sums and exact order statistics at scale, without a single-partition step.

Row numbers: rows are range-partitioned and sorted; ``monotonically_increasing_id`` then holds the partition and the
row's place in it, and the driver adds the counts of the partitions before: one shuffle, and no task sees more than its
range.  The placed rows are written once, since another run of the same plan may sample other bounds.

Order statistics: radix selection on the values' bits, put in the order of the values.  A round counts by leading bits,
the bits that hold the wanted rank lead the next round, until few values share them.  A round is one pass that sends
a bounded number of counts, whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.store import cut

_PLACE_BITS = 33
#: Bits that the rounds of a selection leave off; values that are looked at one by one.
SHIFTS, FEW = (46, 34, 22, 10, 0), 20_000


def with_row_number(df: DataFrame, order: list[str | Column], name: str, kept: list[str | Column] | None = None) -> DataFrame:
    """``df`` with the 0-based place ``name`` of each row in ``order``, which must be total up to equal rows.

    With ``kept`` only those columns are written and returned beside the place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(sorted_rows.select(*(["*"] if kept is None else kept), F.monotonically_increasing_id().alias("_at")), "placed")
    part = F.shiftright("_at", _PLACE_BITS)
    starts = _starts(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    before = F.get(starts, part.cast("int")) if starts is not None else F.lit(0)
    return placed.withColumn(name, (before + place).cast("long")).drop("_at")


def _starts(counts: DataFrame) -> Column | None:
    """Rows before each partition, as an array by its number; a row for each partition comes to the driver."""
    sizes = {r["part"]: r["n"] for r in counts.toLocalIterator()}
    if not sizes:
        return None
    out, total = [], 0
    for k in range(max(sizes) + 1):
        out.append(total)
        total += sizes.get(k, 0)
    return F.array(*(F.lit(x).cast("long") for x in out))


def running_counts(values: DataFrame, by: str, count: str = "count") -> DataFrame:
    """``values`` (distinct ``by`` with their ``count``) with ``below``: the counts of all lesser ones.

    Sorted ranges add up on their own; what the ranges before hold is added afterwards.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = values.repartitionByRange(parts, by).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    starts = _starts(ranged.groupBy(F.col("_part").alias("part")).agg(F.sum(count).alias("n")))
    earlier = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(count).over(earlier), F.lit(0))
    before = F.get(starts, F.col("_part")) if starts is not None else F.lit(0)
    return ranged.withColumn("below", (before + within).cast("long")).drop("_part")


def order_statistics(rows: DataFrame, wanted: list[tuple[Column, int]]) -> list[float]:
    """The value of 0-based rank k of each (column, k) among the rows' doubles, which must be finite."""
    return [got[0] for got in rank_runs(rows, [(c, k, k) for c, k in wanted])]


def rank_runs(rows: DataFrame, wanted: list[tuple]) -> list[tuple]:
    """The values of ranks a, b, ... of each (column, a, b, ...); nulls stand after all values."""
    if not wanted:
        return []
    values = rows.select(*(c.cast("double").alias(f"v{t}") for t, (c, *_) in enumerate(wanted)))
    state = {(t, k): {"left": k, "prefix": None, "n": math.inf} for t, (_, *ranks) in enumerate(wanted) for k in ranks}
    for shift, last in zip(SHIFTS, (None, *SHIFTS)):
        asked = [(t, x) for t, x in sorted({(t, s["prefix"]) for (t, _), s in state.items()}, key=str)]
        counts = _counted(values, asked, shift, last)
        for (t, k), s in state.items():
            for bits, n in counts[t, s["prefix"]]:
                if n > s["left"]:
                    break
                s["left"] -= n
            else:
                raise ValueError(f"rank {k} of fewer values")
            s |= {"next": bits, "n": n}
        for s in state.values():
            s["prefix"] = s["next"]
        if all(s["n"] <= FEW for s in state.values()):
            break
    if shift:  # few values share the bits found: they are counted one by one
        asked = sorted({(t, s["prefix"]) for (t, _), s in state.items()})
        counts = _counted(values, asked, 0, shift)
        for (t, _), s in state.items():
            for s["next"], n in counts[t, s["prefix"]]:
                if n > s["left"]:
                    break
                s["left"] -= n
    return [tuple(_value(state[t, k]["next"]) for k in ranks) for t, (_, *ranks) in enumerate(wanted)]


def _value(bits: int) -> float:
    import struct

    return struct.unpack("<d", struct.pack("<q", bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)))[0]


def _counted(values: DataFrame, asked: list[tuple], shift: int, last: int | None) -> dict[tuple, list]:
    """For each (column, leading bits found so far) the longer leading bits in order, each with its count."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        for batch in batches:
            out: list = [[], [], []]
            for i, (t, prefix) in enumerate(asked):
                bits = batch.column(t).to_numpy(zero_copy_only=False).view(np.int64)
                bits = bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)  # in the order of the values
                if prefix is not None:
                    bits = bits[bits >> last == prefix]
                kinds, n = np.unique(bits >> shift, return_counts=True)
                for c, x in zip(out, (np.full(len(kinds), i), kinds, n)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["i", "bits", "n"])

    summed = values.mapInArrow(run, "i long, bits long, n long").groupBy("i", "bits").agg(F.sum("n").alias("n"))
    found: dict[tuple, list] = {a: [] for a in asked}
    for r in summed.collect():  # leading bits in use, 4,096 longer ones, or FEW values for each that was asked
        found[asked[r["i"]]].append((r["bits"], r["n"]))
    return {a: sorted(x) for a, x in found.items()}


def medians(rows: DataFrame, columns: list[Column], n: int, low: bool = False) -> list[float]:
    """Exact medians of columns over ``n`` rows; with ``low`` the lower of the two middle values."""
    if not n:
        return [math.nan] * len(columns)
    a, b = (n - 1) // 2, (n - 1) // 2 if low else n // 2
    return [lo if lo == hi else lo / 2 + hi / 2 if math.isinf(lo + hi) else (lo + hi) / 2 for lo, hi in rank_runs(rows, [(c, a, b) for c in columns])]
