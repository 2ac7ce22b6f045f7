"""Ordering a cloud: frame, domain, depths, cells, keys and the total-order sort.

Big mode works on one cloud of any size: each scalar comes from one aggregate, keys are column
expressions, and ranks follow a range-partitioned sort.  Batch mode orders many small clouds, one task each.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import curves
from lodestone.functions.ranking import with_row_number
from lodestone.functions.store import cut
from lodestone.operators import allocation, linalg, refine, robust
from lodestone.schema import OrderingError

RAW = ("input", "lexicographic", "morton", "hilbert", "compact_hilbert")
FRAMED = ("pca_hilbert", "robust_morton", "robust_hilbert")
ESTIMATORS = ("det_mcd", "ogk", "mrcd")
RULES = ("uniform", "sample_count", "monotone_half", "occupancy", "occupancy_floor10", "frame_core", "hybrid")
#: Other names of methods.
ALIASES = {"z_order": "morton", "isotropic_hilbert": "hilbert", "pca": "pca_hilbert", "robust": "robust_hilbert"}
#: Points that are gathered to fit a frame: a bound on what the driver holds.
GATHERED = 50_000


@dataclass(frozen=True)
class OrderingConfig:
    method: str = "robust_hilbert"
    estimator: str = "det_mcd"
    bits: str = "frame_core"
    uniform_bits: int = 10
    least_bits: int = 1
    most_bits: int = 63
    tau2: float = 4.0
    refinement: str = "off"
    half_extent: float = 0.0
    grid_shift: tuple = (0.0, 0.0, 0.0)
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if ALIASES.get(self.method, self.method) not in RAW + FRAMED:
            raise OrderingError("unsupported_method", self.method)
        if self.estimator not in ESTIMATORS or self.bits not in RULES:
            raise OrderingError("invalid_input", f"{self.estimator}, {self.bits}")
        if not (math.isfinite(self.half_extent) and self.half_extent >= 0):
            raise OrderingError("invalid_input", "half extent")
        if self.half_extent and self.method not in FRAMED:
            raise OrderingError("invalid_input", "a fixed domain needs a frame")
        if any(not abs(s) <= 1 for s in self.grid_shift):
            raise OrderingError("invalid_input", "grid shift")

    @property
    def name(self) -> str:
        return ALIASES.get(self.method, self.method)


@dataclass
class OrderedCloud:
    """``ordered`` has (rank, raw_index, key, x, y, z); ``manifest`` the effective settings and geometry."""

    ordered: DataFrame
    manifest: dict

    def manifest_json(self) -> str:
        return json.dumps(self.manifest, default=lambda x: np.asarray(x).tolist())


def without_signed_zero(v: Column) -> Column:
    return F.when(v == 0, F.lit(0.0)).otherwise(v)


def _index(cloud: DataFrame) -> list[str]:
    """The index, where the cloud has one: what follows points alone does without."""
    return [c for c in cloud.columns if c == "raw_index"]


def checked(cloud: DataFrame) -> tuple[DataFrame, dict]:
    """The cloud with plain zeros, and its count, bounds and moments; a point that is not finite is an error."""
    axes = ("x", "y", "z")
    cloud = cloud.select(*_index(cloud), *(without_signed_zero(F.col(a)).alias(a) for a in axes))
    bad = lambda a: F.col(a).isNull() | F.isnan(a) | (F.abs(a) == float("inf"))
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    row = cloud.agg(
        F.count("*").alias("n"),
        F.count_if(bad("x") | bad("y") | bad("z")).alias("bad"),
        *(F.min(a).alias(f"lo_{a}") for a in axes),
        *(F.max(a).alias(f"hi_{a}") for a in axes),
        *(F.avg(a).alias(f"mean_{a}") for a in axes),
        *(F.covar_samp(a, b).alias(f"cov_{a}{b}") for a, b in pairs),
    ).first()
    if row["bad"]:
        raise OrderingError("invalid_input", f"{row['bad']} points are not finite")
    some = row["n"] > 0
    cov = np.zeros((3, 3))
    for a, b in pairs:
        i, j = axes.index(a), axes.index(b)
        cov[i, j] = cov[j, i] = row[f"cov_{a}{b}"] if row["n"] > 1 else 0.0
    get = lambda k: np.array([row[f"{k}_{a}"] if some else 0.0 for a in axes])
    return cloud, {"n": row["n"], "lo": get("lo"), "hi": get("hi"), "mean": get("mean"), "cov": cov}


def fit(cloud: DataFrame, facts: dict, config: OrderingConfig) -> dict:
    """Centre and frame of the framed methods.

    A cloud of at most ``GATHERED`` points is fitted in one place; a larger one by aggregates, whatever its size, of which
    only moments and counts come to the driver.  Both give the same frame.
    """
    if config.name == "pca_hilbert":
        found = {"center": facts["mean"], "scatter": facts["cov"], "policy": "none"}
    else:
        points = cloud.select("x", "y", "z") if facts["n"] <= GATHERED else stored_points(cloud)
        if facts["n"] <= GATHERED:
            fits = {"det_mcd": robust.det_mcd, "mrcd": robust.mrcd, "ogk": robust.ogk}
            found = fits[config.estimator](np.array([list(r) for r in points.collect()], float).reshape(-1, 3))
        elif config.estimator == "ogk":
            found = ogk_big(points, facts["n"])
        elif config.estimator == "mrcd":
            found = robust.mrcd_big(points, facts["n"])
        else:
            found = robust.det_mcd_big(points, facts["n"], facts["cov"])
    found["fallback"] = found["policy"].startswith("disabled")
    if found["fallback"]:
        found |= {"center": facts["mean"], "scatter": facts["cov"]}
    axes, spread, half, canonical = linalg.principal_frame(found["scatter"], config.tau2)
    return found | {"axes": axes, "spread": spread, "half": half, "canonical": canonical}


def stored_points(cloud: DataFrame) -> DataFrame:
    """The coordinates alone, written once: the rounds of an estimator read them again and again."""
    return cut(cloud.select("x", "y", "z"), "points")


def ogk_big(cloud: DataFrame, n: int) -> dict:
    """The orthogonalized estimator over a whole cloud: exact medians by counting rounds, a few numbers to the driver."""
    if n < 2:
        return {"policy": "disabled_small_n"}
    axes = ("x", "y", "z")
    got = robust.axis_medians(cloud, *axes, n=n)
    scales = [got[f"sv{k}"] for k in range(3)]
    if any(not s > robust.SCALE_FLOOR for s in scales):
        return {"policy": "disabled_rank_deficient"}
    z = [F.col(a) / s for a, s in zip(axes, scales)]
    pairs = [(0, 1), (0, 2), (1, 2)]
    got = robust.axis_medians(cloud, *(z[a] + z[b] for a, b in pairs), *(z[a] - z[b] for a, b in pairs), n=n)
    pairwise = np.eye(3)
    for k, (a, b) in enumerate(pairs):
        up, down = (s if s > robust.SCALE_FLOOR else 0.0 for s in (got[f"sv{k}"], got[f"sv{k + 3}"]))
        pairwise[a, b] = pairwise[b, a] = min(max((up * up - down * down) / 4, -0.999), 0.999)
    _, turn, done = linalg.jacobi_eigen(pairwise)
    if not done:
        return {"policy": "disabled_rank_deficient"}
    got = robust.axis_medians(cloud, *(sum(z[a] * float(turn[a, k]) for a in range(3)) for k in range(3)), n=n)
    center = np.array(scales) * (turn @ np.array([got[f"mv{k}"] for k in range(3)]))
    spread = [got[f"sv{k}"] if got[f"sv{k}"] > robust.SCALE_FLOOR else 0.0 for k in range(3)]
    scatter = np.outer(scales, scales) * (turn @ np.diag(np.square(spread)) @ turn.T)
    scatter, ridge = linalg.regularized(scatter, 1e-12)
    return {"center": center, "scatter": scatter, "policy": "chi2_regularized" if ridge else "none"}


def projected(center, axes, point: list[Column]) -> list[Column]:
    """Coordinates in a frame."""
    d = [p - F.lit(float(c)) for p, c in zip(point, center)]
    return [sum((d[a] * float(axes[a, k]) for a in range(1, 3)), d[0] * float(axes[0, k])) for k in range(3)]


def frame_depths(rule: str, config: OrderingConfig, core, cover, n: int, inside: int) -> tuple:
    """Depths of a framed method by rule."""
    if rule == "uniform":
        return (allocation.equal_depth(config.uniform_bits, config.most_bits),) * 3
    if rule == "sample_count":
        return (allocation.sample_count_depth(n, config.uniform_bits, config.most_bits),) * 3
    if rule == "monotone_half":
        return allocation.monotone_half(list(2 * cover), config.uniform_bits, config.most_bits)
    least = config.least_bits
    if rule == "occupancy_floor10":
        least = max(least, allocation.equal_depth(config.uniform_bits, config.most_bits))
    if rule == "frame_core":
        return allocation.occupancy(list(core), inside or n, least, config.most_bits)
    if rule == "hybrid":
        volume = 8.0 * core[0] * core[1] * core[2]
        if not volume > 0:
            return (least,) * 3
        side = (volume / (inside or n)) ** (1 / 3)
        request = [min(max(least, math.ceil(math.log2(2 * a / side))), 32) for a in cover]
        if sum(request) <= min(63, config.most_bits):
            return tuple(request)
        return allocation.minimax_projection(tuple(request), list(cover), config.most_bits)
    return allocation.occupancy(list(cover), n, least, config.most_bits)


def keyed(cloud: DataFrame, config: OrderingConfig) -> tuple[DataFrame, dict]:
    """The cloud with its cells (qx, qy, qz) and key, and the manifest."""
    cloud, facts = checked(cloud)
    about = {"config": asdict(config) | {"method": config.name}, "n": facts["n"], "fallback": False, "canonical": False}
    name, point = config.name, [F.col(a) for a in ("x", "y", "z")]
    if name in ("input", "lexicographic"):
        zero = F.lit(0).cast("long")
        key = F.col("raw_index") if name == "input" else zero
        cells = cloud.select("*", *(zero.alias(q) for q in ("qx", "qy", "qz")), key.alias("key"))
        return cells, about | {"bits": (0, 0, 0)}
    if name in RAW:
        half = list((facts["hi"] - facts["lo"]) / 2)
        rule = config.bits
        if name == "hilbert" and rule != "sample_count":
            rule = "uniform"
        bits = allocation.raw_depths(rule, half, facts["n"], config.uniform_bits, config.least_bits)
        bounds = list(zip(facts["lo"], facts["hi"]))
        values = point
        about |= {"bits": bits, "lo": facts["lo"], "hi": facts["hi"]}
    else:
        frame = fit(cloud, facts, config)
        values = projected(frame["center"], frame["axes"], point)
        core = np.where(np.isfinite(frame["half"]) & (frame["half"] > 0), frame["half"], 0.0)
        if config.half_extent:
            core = np.full(3, config.half_extent)
        inside = F.lit(True)
        for v, a in zip(values, core):
            inside = inside & (F.abs(v) <= float(a))
        row = cloud.agg(*(F.max(F.abs(v)).alias(f"m{k}") for k, v in enumerate(values)), F.count_if(inside).alias("in"))
        row = row.first()
        cover = np.maximum(core, [row[f"m{k}"] or 0.0 for k in range(3)])
        bits = frame_depths(config.bits, config, core, cover, facts["n"], row["in"])
        domain = core if config.bits == "frame_core" else cover
        shift = [s * a * 2.0 ** (1 - b) for s, a, b in zip(config.grid_shift, domain, bits)]
        bounds = [(-a + s, a + s) for a, s in zip(domain.tolist(), shift)]
        about |= {k: frame[k] for k in ("center", "axes", "half", "fallback", "canonical", "policy")}
        about |= {"bits": bits, "cover": cover, "inside": row["in"]}
    cells = [curves.quantize(v, float(lo), float(hi), b) for v, (lo, hi), b in zip(values, bounds, bits)]
    cloud = cloud.select("*", *(c.alias(q) for c, q in zip(cells, ("qx", "qy", "qz"))))
    if sum(bits) > 63 or max(bits) > 32:
        raise OrderingError("key_encoding_failed", str(bits))
    encode = curves.morton if name in ("morton", "robust_morton") else curves.hilbert
    return cloud.withColumn("key", encode([F.col(q) for q in ("qx", "qy", "qz")], tuple(bits))), about


def order_cloud(cloud: DataFrame, config: OrderingConfig | None = None) -> OrderedCloud:
    """Order one cloud (raw_index, x, y, z) of any size; without an index, equal points are not told apart."""
    config = config or OrderingConfig()
    cells, about = keyed(cloud, config)
    if config.name == "input":
        return OrderedCloud(cells.select(F.col("raw_index").alias("rank"), "raw_index", "key", "x", "y", "z"), about)
    index, point = _index(cells), ["x", "y", "z"]
    ranked = with_row_number(cells, ["key", *point, *index], "rank", [*index, "key", *point])
    ordered = ranked.select("rank", *index, "key", *point)
    if config.refinement != "off":
        ordered = refine.refine_big(ordered, about["n"])
    return OrderedCloud(ordered, about)


def order_points(points: np.ndarray, config: OrderingConfig) -> dict:
    """Batch mode: permutation, keys by raw index, depths, flags and digest of one cloud in memory."""
    points = np.asarray(points, float)
    if points.ndim != 2 or points.shape[1:] != (3,):
        raise OrderingError("invalid_shape", str(points.shape))
    if not np.isfinite(points).all():
        raise OrderingError("invalid_input", "points are not finite")
    points = np.where(points == 0, 0.0, points)
    n, name = len(points), config.name
    key, bits, fallback = np.zeros(n, np.int64), (0, 0, 0), False
    out: dict = {}
    if name == "input":
        key = np.arange(n)
    elif name != "lexicographic":
        lo, hi = (points.min(axis=0), points.max(axis=0)) if n else (np.zeros(3), np.zeros(3))
        values, bounds = points, list(zip(lo, hi))
        if name in RAW:
            rule = "uniform" if name == "hilbert" and config.bits != "sample_count" else config.bits
            bits = allocation.raw_depths(rule, list((hi - lo) / 2), n, config.uniform_bits, config.least_bits)
        else:
            estimator = "sample" if name == "pca_hilbert" else config.estimator
            frame = robust.fit_frame(points, estimator)
            fallback = frame["fallback"]
            out |= {k: frame[k] for k in ("center", "axes", "half", "canonical", "policy")}
            values = (points - frame["center"]) @ frame["axes"]
            half = math.sqrt(config.tau2) * np.sqrt(np.maximum(frame["spread"], 0))
            core = np.where(np.isfinite(half) & (half > 0), half, 0.0)
            if config.half_extent:
                core = np.full(3, config.half_extent)
            cover = np.maximum(core, np.abs(values).max(axis=0)) if n else core
            inside = int((np.abs(values) <= core).all(axis=1).sum())
            bits = frame_depths(config.bits, config, core, cover, n, inside)
            domain = core if config.bits == "frame_core" else cover
            bounds = [(-a, a) for a in domain]
        cells = np.column_stack([curves.quantize_array(values[:, a], *bounds[a], bits[a]) for a in range(3)])
        encode = curves.morton_array if name in ("morton", "robust_morton") else curves.hilbert_array
        key = encode(cells, tuple(bits))
    rank = np.arange(n) if name == "input" else np.lexsort((np.arange(n), *points.T[::-1], key))
    if config.refinement != "off" and name != "input":
        rank = refine.refine(points, rank)
    digest = hashlib.sha256()
    digest.update(name.encode())
    for part in ([*bits, int(fallback), n], rank, [n], key):
        digest.update(np.asarray(part, "<u8").tobytes())
    return out | {"permutation": rank, "keys": key, "bits": bits, "fallback": fallback, "digest": digest.hexdigest()}


def order_clouds(clouds: DataFrame, config: OrderingConfig) -> DataFrame:
    """Batch mode over many clouds (cloud_id, raw_index, x, y, z): each is ordered by one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("raw_index", kind="stable").reset_index(drop=True)
        found = order_points(pdf[["x", "y", "z"]].to_numpy(), config)
        at = found["permutation"]
        return pd.DataFrame(
            {
                "cloud_id": pdf["cloud_id"].to_numpy()[at],
                "rank": np.arange(len(at)),
                "raw_index": pdf["raw_index"].to_numpy()[at],
                "key": found["keys"][at],
                "x": pdf["x"].to_numpy()[at],
                "y": pdf["y"].to_numpy()[at],
                "z": pdf["z"].to_numpy()[at],
                "fallback": found["fallback"],
                "digest": found["digest"],
            }
        )

    kind = dict(clouds.dtypes)["cloud_id"]
    schema = (
        f"cloud_id {kind}, rank long, raw_index long, key long, x double, y double, z double, fallback boolean, "
        "digest string"
    )
    return clouds.select("cloud_id", "raw_index", "x", "y", "z").groupBy("cloud_id").applyInPandas(one, schema)
