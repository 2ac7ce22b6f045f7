"""SQL functions: quantize_axis(v, lo, hi, bits), morton3 and hilbert3(qx, qy, qz, bits)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """Temporary SQL functions; the Hilbert one is an Arrow UDF over the table-driven encoder."""
    from lodestone.functions import curves

    spark.sql(
        "create or replace temporary function quantize_axis(v double, lo double, hi double, bits int) returns bigint "
        "return case when v is null or isnan(v) or lo >= hi or v <= lo or bits = 0 then 0L "
        "when v >= hi then cast(power(2, bits) as bigint) - 1 "
        "else least(floor((v - lo) / (hi - lo) * power(2, bits)), cast(power(2, bits) as bigint) - 1) end"
    )
    spread = " | ".join(
        f"shiftleft(shiftright(q{a}, {k}) & 1L, {3 * k + i})" for k in range(21) for i, a in enumerate("xyz")
    )
    spark.sql(
        "create or replace temporary function morton3(qx bigint, qy bigint, qz bigint) returns bigint "
        f"return {spread}"
    )

    @F.pandas_udf("long")
    def hilbert3(x: pd.Series, y: pd.Series, z: pd.Series, bits: pd.Series) -> pd.Series:
        q = np.column_stack([x, y, z]).astype(np.int64)
        out = np.zeros(len(q), np.int64)
        for b in bits.unique():
            at = (bits == b).to_numpy()
            out[at] = curves.hilbert_array(q[at], (int(b),) * 3)
        return pd.Series(out)

    spark.udf.register("hilbert3", hilbert3)
