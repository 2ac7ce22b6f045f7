"""Deterministic synthetic clouds.

The random stream is counter-based: draw i of a seed depends on seed + (i + 1) * step only, so points are made
in parallel from ``range`` and any split gives the same cloud.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 0x9E3779B97F4A7C15
#: Seeds of the rotation and of the two kinds of contamination differ from the cloud's by these.  Fixed values.
ROTATION, UNIFORM, CLUSTERED = 0x6A09E667F3BCC909, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03


def draws(seed: int, index: np.ndarray) -> np.ndarray:
    """Draws ``index`` (from 0) of a seed as unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        s = np.uint64(seed & 0xFFFFFFFFFFFFFFFF) + (index.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP)
        s = (s ^ (s >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        s = (s ^ (s >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return s ^ (s >> np.uint64(31))


def unit(seed: int, index: np.ndarray) -> np.ndarray:
    return (draws(seed, index) >> np.uint64(11)).astype(float) * 2.0**-53


def normals(seed: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two normal numbers from the draws ``first`` and ``first`` + 1."""
    radius = np.sqrt(-2 * np.log(np.maximum(unit(seed, first), 2.0**-53)))
    angle = 2 * math.pi * unit(seed, first + 1)
    return radius * np.cos(angle), radius * np.sin(angle)


def radical_inverse(index: np.ndarray, base: int) -> np.ndarray:
    out, share, left = np.zeros(len(index)), 1.0 / base, index.astype(np.int64).copy()
    while left.any():
        out += share * (left % base)
        left //= base
        share /= base
    return out


def rotation(seed: int) -> np.ndarray:
    a, b, c = 2 * math.pi * unit(seed ^ ROTATION, np.arange(3))
    z = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    y = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    x = np.array([[1, 0, 0], [0, math.cos(c), -math.sin(c)], [0, math.sin(c), math.cos(c)]])
    return z @ y @ x


def ellipsoid(i: np.ndarray, seed: int, axes=(1.0, 1.0, 1.0)) -> np.ndarray:
    p, q = normals(seed, 4 * i), normals(seed, 4 * i + 2)
    return (np.column_stack([*p, q[0]]) * np.array(axes)) @ rotation(seed).T


def cylinder(i: np.ndarray, seed: int, radius: float = 1.0, height: float = 2.0) -> np.ndarray:
    angle = 2 * math.pi * radical_inverse(i + 1, 2)
    z = height * (radical_inverse(i + 1, 3) - 0.5)
    return np.column_stack([radius * np.cos(angle), radius * np.sin(angle), z])


def torus(i: np.ndarray, seed: int, big: float = 2.0, small: float = 0.5) -> np.ndarray:
    if not 0 < small < big:
        raise ValueError("a torus needs 0 < small < big")
    u, v = 2 * math.pi * radical_inverse(i + 1, 2), 2 * math.pi * radical_inverse(i + 1, 3)
    ring = big + small * np.cos(v)
    return np.column_stack([ring * np.cos(u), ring * np.sin(u), small * np.sin(v)])


def patch(i: np.ndarray, seed: int, a: float = 0.5, b: float = -0.3, noise: float = 0.01) -> np.ndarray:
    x, y = 2 * unit(seed, 4 * i) - 1, 2 * unit(seed, 4 * i + 1) - 1
    return np.column_stack([x, y, a * x * x + b * y * y + noise * normals(seed, 4 * i + 2)[0]])


def mixture(i: np.ndarray, seed: int) -> np.ndarray:
    """Three normal clusters of shares 0.6, 0.3 and 0.1."""
    kind = np.searchsorted([0.6, 0.9], unit(seed, 5 * i), side="right")
    center = np.array([[0, 0, 0], [4, 0, 0], [0, 4, 1]], float)[kind]
    spread = np.array([1.0, 0.3, 0.1])[kind]
    p, q = normals(seed, 5 * i + 1), normals(seed, 5 * i + 3)
    return center + spread[:, None] * np.column_stack([*p, q[0]])


def stress(i: np.ndarray, seed: int, kind: str = "extreme_aspect") -> np.ndarray:
    u = np.column_stack([unit(seed, 3 * i + k) for k in range(3)])
    if kind == "extreme_aspect":
        return (2 * u - 1) * np.array([1e6, 1.0, 1e-6])
    if kind == "near_integer_boundary":
        return np.floor(16 * u) + (2 * unit(seed ^ 1, i) - 1)[:, None] * 2.0**-50
    return np.where(u < 1 / 3, -0.0, np.where(u < 2 / 3, 0.0, 2 * u - 1))


def degenerate(i: np.ndarray, seed: int, kind: str = "coplanar") -> np.ndarray:
    if kind == "collinear":
        return np.column_stack([i, 2.0 * i, -1.0 * i])
    r, angle = np.sqrt(i + 0.5), i * math.pi * (3 - math.sqrt(5))
    return np.column_stack([r * np.cos(angle), r * np.sin(angle), np.zeros(len(i))])


FAMILIES = {
    "ellipsoid": ellipsoid, "cylinder": cylinder, "torus": torus, "patch": patch, "mixture": mixture,
    "stress": stress, "degenerate": degenerate,
}


def cloud(spark: SparkSession, family: str, n: int, seed: int, **shape) -> DataFrame:
    """(raw_index, x, y, z) of a family, made in parallel."""
    make = FAMILIES[family]

    def run(batches):
        for pdf in batches:
            i = pdf["id"].to_numpy()
            xyz = np.asarray(make(i, seed, **shape), float).reshape(-1, 3)
            yield pd.DataFrame({"raw_index": i, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return spark.range(n).mapInPandas(run, "raw_index long, x double, y double, z double")


def spans(clean: DataFrame) -> tuple[list, list, list, int]:
    """Bounds and spans for placing outliers: a flat axis borrows the widest, and a single point has 1."""
    axes = ("x", "y", "z")
    r = clean.agg(F.count("*").alias("n"), *(F.min(a).alias(f"lo{a}") for a in axes), *(F.max(a).alias(f"hi{a}") for a in axes)).first()
    lo, hi = [r[f"lo{a}"] or 0.0 for a in axes], [r[f"hi{a}"] or 0.0 for a in axes]
    wide = [h - x for x, h in zip(lo, hi)]
    most = max(wide)
    return lo, hi, [w if w > 0 else (most if most > 0 else 1.0) for w in wide], r["n"]


def contaminate(clean: DataFrame, mode: str, share: float, seed: int) -> DataFrame:
    """The clean points, with their indices, and round(n * share) outliers after them."""
    lo, hi, wide, n = spans(clean)
    extra = round(n * share)

    def run(batches):
        for pdf in batches:
            i = pdf["id"].to_numpy()
            if mode == "clustered":
                u = np.column_stack([unit(seed ^ CLUSTERED, 3 * i + k) for k in range(3)])
                xyz = np.array(hi) + 3 * np.array(wide) + (2 * u - 1) * 0.05 * np.array(wide)
            else:
                u = np.column_stack([unit(seed ^ UNIFORM, 6 * i + k) for k in range(6)])
                xyz = np.array(lo) - 2 * np.array(wide) + u[:, :3] * (np.array(hi) - np.array(lo) + 4 * np.array(wide))
                axis = np.minimum((3 * u[:, 3]).astype(int), 2)
                far = (1 + u[:, 4]) * np.array(wide)[axis]
                out = np.where(u[:, 5] < 0.5, np.array(lo)[axis] - far, np.array(hi)[axis] + far)
                xyz[np.arange(len(i)), axis] = out
            yield pd.DataFrame({"raw_index": n + i, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    outliers = clean.sparkSession.range(extra).mapInPandas(run, "raw_index long, x double, y double, z double")
    return clean.select("raw_index", "x", "y", "z").unionByName(outliers)
