"""Experiment matrices: the product of methods, bit rules, contaminations, geometries, sizes and seeds."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("hilbert", "morton", "pca_hilbert", "robust_hilbert")
BIT_RULES = ("uniform", "monotone_half", "frame_core")
CONTAMINATION = {"D0": ("none", 0.0), "D1": ("uniform_bbox", 0.05), "D2": ("uniform_bbox", 0.15),
                 "D3": ("uniform_bbox", 0.25), "D4": ("clustered", 0.25)}
GEOMETRY = {"E0": ("ellipsoid", {"axes": (1, 1, 1)}), "E1": ("ellipsoid", {"axes": (5, 1, 1)}),
            "E2": ("ellipsoid", {"axes": (10, 1, 1)}), "E5": ("patch", {}), "E6": ("torus", {}), "E7": ("cylinder", {}),
            "E8": ("mixture", {})}
SIZES = (256, 384)


def independent_seed(geometry: str, seed: int, salt: str = "lodestone-independent-v1") -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{geometry}:{seed}".encode()).digest()[:8], "little")


def expand(spark: SparkSession, seeds: DataFrame) -> DataFrame:
    """All cases of the given seeds; the isotropic method has one bit rule only. Each other side is a list of settings."""
    side = lambda name, values, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    cases = seeds.select("seed").join(F.broadcast(side("method", METHODS, "string")))
    for name, values, kind in (
        ("rule", BIT_RULES, "string"), ("cond", CONTAMINATION, "string"), ("geometry", GEOMETRY, "string"),
        ("points", SIZES, "int"),
    ):
        cases = cases.join(F.broadcast(side(name, values, kind)))
    cases = cases.filter("not (method = 'hilbert' and rule <> 'uniform')")
    return cases.select("method", "rule", "cond", "geometry", "points", "seed")


def measure(cases: DataFrame) -> DataFrame:
    """Order each case's cloud and measure the path; cases are independent and run in parallel."""
    from lodestone.operators import ordering, refine
    from lodestone.sources import generators as g

    def contaminated(points: np.ndarray, mode: str, share: float, seed: int) -> np.ndarray:
        extra = round(len(points) * share)
        if not extra:
            return points
        lo, hi = points.min(axis=0), points.max(axis=0)
        wide = np.where(hi > lo, hi - lo, max((hi - lo).max(), 1.0))
        i = np.arange(extra)
        if mode == "clustered":
            u = np.column_stack([g.unit(seed ^ g.CLUSTERED, 3 * i + k) for k in range(3)])
            return np.vstack([points, hi + 3 * wide + (2 * u - 1) * 0.05 * wide])
        u = np.column_stack([g.unit(seed ^ g.UNIFORM, 6 * i + k) for k in range(6)])
        out = lo - 2 * wide + u[:, :3] * (hi - lo + 4 * wide)
        axis = np.minimum((3 * u[:, 3]).astype(int), 2)
        far = (1 + u[:, 4]) * wide[axis]
        out[i, axis] = np.where(u[:, 5] < 0.5, lo[axis] - far, hi[axis] + far)
        return np.vstack([points, out])

    def run(batches):
        for pdf in batches:
            rows = []
            for c in pdf.itertuples(index=False):
                seed = independent_seed(c.geometry, c.seed)
                family, shape = GEOMETRY[c.geometry]
                points = g.FAMILIES[family](np.arange(c.points), seed, **shape)
                points = contaminated(points, *CONTAMINATION[c.cond], seed)
                found = ordering.order_points(points, ordering.OrderingConfig(method=c.method, bits=c.rule))
                path = refine.length(points, found["permutation"])
                rows.append((*c, len(points), path / max(len(points) - 1, 1), found["fallback"], found["digest"]))
            names = [*pdf.columns, "n", "miad", "fallback", "digest"]
            yield pd.DataFrame(rows, columns=names)

    schema = (
        "method string, rule string, cond string, geometry string, points int, seed int, n long, miad double, "
        "fallback boolean, digest string"
    )
    return cases.repartition(16, "geometry", "cond", "method").mapInPandas(run, schema)
