"""Appending points as a stream: keys by a frozen quantizer, so a point's key does not depend on later points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import curves
from lodestone.operators.ordering import projected


@dataclass(frozen=True)
class FrozenQuantizer:
    """Centre, axes (columns), half extents and depths taken from an earlier order."""

    center: tuple
    axes: tuple
    half: tuple
    bits: tuple

    def __post_init__(self) -> None:
        if min(self.half) <= 0 or not all(1 <= b <= 32 for b in self.bits) or sum(self.bits) > 63:
            raise ValueError("a frozen quantizer has positive extents and 1 to 32 bits an axis, 63 in all")

    def keyed(self, points: DataFrame) -> DataFrame:
        """The points with their key, in batch or in a stream alike."""
        import numpy as np

        values = projected(self.center, np.array(self.axes), [F.col(a) for a in ("x", "y", "z")])
        cells = [curves.quantize(v, -h, h, b) for v, h, b in zip(values, self.half, self.bits)]
        return points.withColumn("key", curves.hilbert(cells, tuple(self.bits)))


def start_append(points: DataFrame, quantizer: FrozenQuantizer, path: str, checkpoint: str, key_bits: int = 12):
    """Write a stream of points to ``path``, partitioned by the leading bits of the key; returns the query."""
    shift = max(sum(quantizer.bits) - key_bits, 0)
    rows = quantizer.keyed(points).withColumn("key_range", F.shiftright("key", shift))
    return (
        rows.writeStream.format("parquet")
        .partitionBy("key_range")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
