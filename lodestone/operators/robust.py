"""Robust location and scatter of three-dimensional points.

Two modes with one meaning: NumPy on a cloud that fits a task (batch), and aggregates over a cloud of any size.  There
an order statistic is a few counting rounds, a start is a few aggregates, and a concentration step is one order statistic
(the distance of the h-th point) and the sums of what lies within it, for all starts at once; the driver holds moments only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ranking import FEW, SHIFTS, medians, order_statistics, running_counts
from lodestone.operators import linalg

#: Makes the median absolute deviation agree with the standard deviation of normal data.
MAD_FACTOR = 1.482602218505602
SCALE_FLOOR = 1e-12
AXES = ("x", "y", "z")
PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def mad(v: np.ndarray, center: float) -> float:
    return MAD_FACTOR * float(np.median(np.abs(v - center))) if len(v) else 0.0


def lower_median(v: np.ndarray) -> float:
    return float(np.sort(v)[(len(v) - 1) // 2])


def h_size(n: int, alpha: float, p: int = 3) -> int:
    n2 = (n + p + 1) // 2
    return int(min(max(math.floor(2 * n2 - n + 2 * min(max(alpha, 0.5), 1.0) * (n - n2)), 0), n))


def pilot_alpha(outlier_share: float) -> float:
    return min(max(1 - 1.5 * outlier_share, 0.5), 0.9)


def pilot(points: np.ndarray) -> tuple[float, float, int]:
    """Share of far points, the trimming level it asks for, and the subset size."""
    center = np.array([lower_median(points[:, a]) for a in range(3)])
    scale = max(sorted(mad(points[:, a], center[a]) for a in range(3))[1], SCALE_FLOOR)
    far = float((np.sqrt(((points - center) ** 2).sum(axis=1)) / scale > 5.2).mean())
    alpha = pilot_alpha(far)
    return far, alpha, h_size(len(points), alpha)


def pilot_far_points(cloud: DataFrame) -> dict:
    """n, the lower medians, the middle scale, the far points and their share, over a cloud of any size."""
    n = cloud.count()
    point = [F.col(a) for a in AXES]
    center = medians(cloud, point, n, low=True)
    spread = medians(cloud, [F.abs(p - m) for p, m in zip(point, center)], n)
    scale = max(sorted(MAD_FACTOR * s for s in spread)[1], SCALE_FLOOR) if n else SCALE_FLOOR
    radius = F.sqrt(sum((p - m) ** 2 for p, m in zip(point, center))) / scale
    far = cloud.agg(F.count_if(radius > 5.2)).first()[0]
    return {"n": n, "mx": center[0], "my": center[1], "mz": center[2], "scale": scale, "far": far, "share": far / n if n else 0.0}


def average_ranks(v: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return (ends - (counts - 1) / 2)[inverse]


def normal_quantile(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist

    kinds, at = np.unique(p, return_inverse=True)
    return np.vectorize(NormalDist().inv_cdf, otypes=[float])(kinds)[at].reshape(np.shape(p))


def _covariance(points: np.ndarray) -> np.ndarray:
    return np.cov(points.T) if len(points) > 1 else np.zeros((3, 3))


def _correlation(cov: np.ndarray) -> np.ndarray:
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    denominator = np.outer(spread, spread)
    out = np.divide(cov, denominator, out=np.zeros((3, 3)), where=denominator > 0)
    out = np.clip(out, -0.999, 0.999)
    np.fill_diagonal(out, 1.0)
    return out


def gk_covariance(v: np.ndarray, scale=None) -> np.ndarray:
    """Covariances from the scales of sums and differences of two columns."""
    scale = scale or (lambda c: mad(c, float(np.median(c))))
    out = np.diag([scale(v[:, a]) ** 2 for a in range(3)])
    for a in range(3):
        for b in range(a + 1, 3):
            out[a, b] = out[b, a] = (scale(v[:, a] + v[:, b]) ** 2 - scale(v[:, a] - v[:, b]) ** 2) / 4
    return out


def starts(points: np.ndarray, h: int) -> list[tuple[str, np.ndarray, np.ndarray, bool]]:
    """Six starting locations and scatters: name, location, scatter, whether it needed a ridge."""
    n = len(points)
    center = np.median(points, axis=0)
    scale = np.array([max(mad(points[:, a], center[a]), SCALE_FLOOR) for a in range(3)])
    z = (points - center) / scale
    ranks = np.column_stack([average_ranks(points[:, a]) for a in range(3)])
    length = np.sqrt((z * z).sum(axis=1, keepdims=True))
    shapes = {
        "tanh": _covariance(np.tanh(z)),
        "spearman": _covariance((ranks - (n + 1) / 2) / math.sqrt((n * n - 1) / 12)),
        "normal_score": _covariance(normal_quantile((ranks - 0.375) / (n + 0.25))),
        "spatial_sign": _covariance(np.divide(z, length, out=z.copy(), where=length > 0)),
        "ogk": gk_covariance(z),
    }
    out = {k: (center, np.outer(scale, scale) * _correlation(c)) for k, c in shapes.items()}
    inner = points[_inner(length[:, 0], points, h)]
    out["bacon"] = inner.mean(axis=0), _covariance(inner)
    order = ("tanh", "spearman", "normal_score", "spatial_sign", "bacon", "ogk")
    return [(k, out[k][0], *linalg.regularized(out[k][1])) for k in order]


def _closest(distance: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Places by distance, ties by coordinates and then by place."""
    return np.lexsort((np.arange(len(points)), points[:, 2], points[:, 1], points[:, 0], distance))


def _inner(distance: np.ndarray, points: np.ndarray, h: int) -> np.ndarray:
    """The first h places of :func:`_closest`, ascending: sorted out only where the h-th distance is shared."""
    if 0 < h < len(distance):
        inside, outside = np.partition(distance, (h - 1, h))[h - 1 : h + 1]
        if inside < outside:
            return np.flatnonzero(distance <= inside)
    return np.sort(_closest(distance, points)[:h])


def concentrate(points, center, scatter, h: int, most: int = 200, tolerance: float = 1e-12, seen: set | None = None) -> dict | None:
    """C-steps: the h closest points by Mahalanobis distance give the next location and scatter.

    A subset says all of what follows it.  So a start that meets one of ``seen``, the subsets of starts that ended, would end
    as that start did, and gives None.
    """
    before, det, met = None, math.inf, set()
    state = None
    for k in range(most):
        try:
            inverse = np.linalg.inv(scatter)
        except np.linalg.LinAlgError:
            break
        d = points - center
        inner = _inner(np.einsum("ij,jk,ik->i", d, inverse, d), points, h)
        if before is not None and np.array_equal(inner, before):
            state["converged"] = True
            break
        location, cov = points[inner].mean(axis=0), _covariance(points[inner])
        now = float(np.linalg.det(cov))
        if now > det * (1 + tolerance) + tolerance:
            break
        if seen is not None:
            if inner.tobytes() in seen:
                return None
            met.add(inner.tobytes())
        state = {"center": location, "scatter": cov, "subset": inner, "det": now, "steps": k + 1, "converged": False}
        before, det, center, scatter = inner, now, location, cov
    if seen is not None and state and state["converged"]:
        seen |= met
    return state


def rank_deficient(points: np.ndarray, tolerance: float = 1e-12) -> bool:
    return _deficient(_covariance(points), tolerance)


def _deficient(cov: np.ndarray, tolerance: float = 1e-12) -> bool:
    top = np.abs(cov).max()
    if not top > 0:
        return True
    values = linalg.jacobi_eigen(cov / top)[0]
    return not (values[0] > tolerance and np.linalg.det(cov / top) > tolerance**3)


def det_mcd(points: np.ndarray, alpha: float | None = None, least_n: int = 15) -> dict:
    """Deterministic minimum covariance determinant: the best of six concentrated starts, corrected."""
    n = len(points)
    if alpha is None:
        alpha = pilot(points)[1] if n else 0.5
    h = h_size(n, alpha)
    if n < least_n or h <= 3:
        return {"policy": "disabled_small_n", "h": h}
    if not np.isfinite(points).all() or rank_deficient(points):
        return {"policy": "disabled_rank_deficient", "h": h}
    best, seen = None, set()
    for name, center, scatter, ridge in starts(points, h):
        found = concentrate(points, center, scatter, h, seen=seen)
        if found and (best is None or found["det"] < best["det"]):
            best = found | {"start": name, "ridge": ridge}
    if best is None:
        return {"policy": "disabled_rank_deficient", "h": h}
    factor = linalg.consistency(n, 3, h) * linalg.small_sample(n, 3, alpha)
    policy = "chi2_regularized" if best["ridge"] else "hr_adjusted_f"
    return best | {"scatter": best["scatter"] * factor, "h": h, "alpha": alpha, "policy": policy}


def ogk(points: np.ndarray) -> dict:
    """Orthogonalized Gnanadesikan-Kettenring location and scatter."""
    if len(points) < 2:
        return {"policy": "disabled_small_n"}

    def scale(v: np.ndarray) -> float:
        s = mad(v, float(np.median(v)))
        return s if np.isfinite(s) and s > SCALE_FLOOR else 0.0

    scales = np.array([scale(points[:, a]) for a in range(3)])
    if not np.isfinite(points).all() or (scales <= 0).any():
        return {"policy": "disabled_rank_deficient"}
    z = points / scales
    pairwise = np.clip(gk_covariance(z, scale), -0.999, 0.999)
    np.fill_diagonal(pairwise, 1.0)
    _, axes, done = linalg.jacobi_eigen(pairwise)
    if not done:
        return {"policy": "disabled_rank_deficient"}
    turned = z @ axes
    spread = np.array([scale(turned[:, a]) ** 2 for a in range(3)])
    center = scales * (axes @ np.median(turned, axis=0))
    scatter, ridge = linalg.regularized(np.outer(scales, scales) * (axes @ np.diag(spread) @ axes.T), 1e-12)
    return {"center": center, "scatter": scatter, "policy": "chi2_regularized" if ridge else "none"}


def rho_for(cov: np.ndarray, factor: float, condition: float, least_rho: float) -> float:
    """The least ridge that brings (rho + (1 - rho) hi) / (rho + (1 - rho) lo) down to the condition."""
    values = linalg.jacobi_eigen(cov * factor)[0]
    lo, hi = values[0], values[-1]
    if lo > 0 and hi / lo <= condition:
        return least_rho
    over = hi - condition * lo
    return min(max(over / (over + condition - 1), least_rho), 1.0)


def common_rho(rhos: list[float]) -> float:
    return max(rhos) if max(rhos) <= 0.1 else max(0.1, float(np.median(rhos)))


def mrcd(points: np.ndarray, alpha: float = 0.5, condition: float = 50.0, least_rho: float = 1e-6) -> dict:
    """Minimum regularized covariance determinant: C-steps on rho I + (1 - rho) c S in standardized space."""
    n = len(points)
    h = h_size(n, alpha)
    if n < 4 or h < 2:
        return {"policy": "disabled_small_n", "h": h}
    center = np.median(points, axis=0)
    scale = np.array([max(mad(points[:, a], center[a]), SCALE_FLOOR) for a in range(3)])
    z = (points - center) / scale
    factor = linalg.consistency(n, 3, h)

    first = []
    for _, location, scatter, _ in starts(z, h):
        d = z - location
        inner = z[_inner(np.einsum("ij,jk,ik->i", d, np.linalg.inv(scatter), d), z, h)]
        first.append((inner.mean(axis=0), _covariance(inner)))
    # each start's closest points say how much ridge the condition needs
    rho = common_rho([rho_for(s, factor, condition, least_rho) for _, s in first])
    best, seen = None, set()
    for location, scatter in first:
        shape = rho * np.eye(3) + (1 - rho) * factor * scatter
        before, met, known = None, set(), False
        for _ in range(200):
            d = z - location
            inner = _inner(np.einsum("ij,jk,ik->i", d, np.linalg.inv(shape), d), z, h)
            if before is not None and np.array_equal(inner, before):
                seen |= met
                break
            known = inner.tobytes() in seen
            if known:  # from here on as the start that was there before
                break
            met.add(inner.tobytes())
            before = inner
            location = z[inner].mean(axis=0)
            shape = rho * np.eye(3) + (1 - rho) * factor * _covariance(z[inner])
        if known:
            continue
        det = float(np.linalg.det(shape))
        if best is None or det < best[0]:
            best = det, location, shape, inner
    _, location, shape, inner = best
    return {
        "center": center + scale * location, "scatter": np.outer(scale, scale) * shape, "rho": rho, "h": h,
        "subset": inner, "policy": "none",
    }


def sample_frame(points: np.ndarray) -> dict:
    return {"center": points.mean(axis=0) if len(points) else np.zeros(3), "scatter": _covariance(points)}


def fit_frame(points: np.ndarray, estimator: str = "det_mcd") -> dict:
    """Location, scatter and frame by an estimator; the sample's where it is disabled."""
    fits = {"det_mcd": det_mcd, "ogk": ogk, "mrcd": mrcd, "sample": lambda p: sample_frame(p) | {"policy": "none"}}
    fit = fits[estimator](points)
    fallback = fit["policy"].startswith("disabled")
    if fallback:
        fit = fit | sample_frame(points)
    axes, spread, half, canonical = linalg.principal_frame(fit["scatter"])
    return fit | {"axes": axes, "spread": spread, "half": half, "canonical": canonical, "fallback": fallback}


def axis_medians(cloud: DataFrame, *columns: Column | str, n: int | None = None) -> dict[str, float]:
    """Median ``m`` and scaled MAD ``s`` of columns v0, v1, ... over a whole cloud."""
    n = cloud.count() if n is None else n
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    centers = medians(cloud, columns, n)
    spread = medians(cloud, [F.abs(c - m) for c, m in zip(columns, centers)], n)
    return {f"mv{k}": m for k, m in enumerate(centers)} | {f"sv{k}": MAD_FACTOR * s for k, s in enumerate(spread)}


def _moments(rows: DataFrame, parts: list[tuple[list[Column], Column]], about: list[list[float]]) -> list[tuple]:
    """Count, mean and sum of products about the mean of the vectors of each (vector, condition), in one aggregate.

    Sums are taken about a given point, so that nothing cancels where the cloud is far from the origin.
    """
    sums = []
    for (v, condition), origin in zip(parts, about):
        d = [c - float(o) for c, o in zip(v, origin)]
        kept = lambda x: F.coalesce(F.sum(F.when(condition, x)), F.lit(0.0))  # noqa: E731, B023
        sums += [kept(F.lit(1.0)), *(kept(x) for x in d), *(kept(d[i] * d[j]) for i, j in PAIRS)]
    row = rows.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first()
    out = []
    for k, origin in enumerate(about):
        n, *rest = row[10 * k : 10 * k + 10]
        out.append((round(n), np.array(rest[:3]), np.array(rest[3:]), np.array(origin, float)))
    return out


def _finished(sums: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    n, first, second, origin = sums
    shift = first / n if n else first
    cov = np.zeros((3, 3))
    for (i, j), p in zip(PAIRS, second):
        cov[i, j] = cov[j, i] = (p - n * shift[i] * shift[j]) / (n - 1) if n > 1 else 0.0
    return n, origin + shift, cov


def covariance_of(rows: DataFrame, v: list[Column]) -> np.ndarray:
    origin = [x or 0.0 for x in rows.agg(*(F.avg(c) for c in v)).first()]
    return _finished(_moments(rows, [(v, F.lit(True))], [origin])[0])[2]


def squared_distance(v: list[Column], center, inverse) -> Column:
    d = [c - float(m) for c, m in zip(v, center)]
    across = [sum((d[j] * float(inverse[i, j]) for j in (1, 2)), d[0] * float(inverse[i, 0])) for i in range(3)]
    return sum((d[i] * across[i] for i in (1, 2)), d[0] * across[0])


def innermost(rows: DataFrame, v: list[Column], shapes: list[tuple], h: int) -> list[dict]:
    """Mean, covariance and radius of the h points nearest to each (center, inverse): ties by coordinates.

    Radix selection on the distances' bits, which order as they do: a round sums up count and moments by leading bits.
    What lies below the h-th point's bits is in; few points share them after a round or two, and come to the driver.
    Which of several equal points is taken does not matter to the moments, so the index needs no look.
    """
    points = rows.select(*(c.cast("double").alias(a) for c, a in zip(v, AXES)))
    state = [{"left": h, "prefix": None, "sums": np.zeros(9)} for _ in shapes]
    for shift, last in zip(SHIFTS, (None, *SHIFTS)):
        for t, groups in _by_bits(points, shapes, state, shift, last).items():
            s = state[t]
            for bits, n, *sums in groups:
                if n >= s["left"]:
                    s |= {"prefix": bits, "n": n}
                    break
                s["left"] -= n
                s["sums"] = s["sums"] + sums
            else:
                raise ValueError(f"{h} of fewer points")
        if all(s["n"] <= FEW for s in state):
            break
    near = _sharing(points, shapes, state, shift) if all(s["n"] <= FEW for s in state) else None
    out = []
    for t, (center, inverse) in enumerate(shapes):
        s, center = state[t], np.asarray(center, float)
        if near is not None:
            d, x = near[t]
            order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], d))[: s["left"]]
            at, radius = x[order] - center, float(d[order[-1]])
            first, second = at.sum(axis=0), np.array([(at[:, i] * at[:, j]).sum() for i, j in PAIRS])
        else:  # no bits are left: more points than that are at one distance
            radius = float(np.array([s["prefix"]], np.int64).view(np.float64)[0])
            tied = points.filter(squared_distance([F.col(a) for a in AXES], center, inverse) == radius)
            first, second = np.zeros(3), np.zeros(6)
            for point, times in _first_tied(tied, [F.col(a) for a in AXES], s["left"]):
                x = np.array(point) - center
                first, second = first + times * x, second + times * np.array([x[i] * x[j] for i, j in PAIRS])
        sums = s["sums"]
        _, mean, cov = _finished((h, sums[:3] + first, sums[3:] + second, center))
        out.append({"center": mean, "scatter": cov, "radius": radius})
    return out


def _distances(x, shapes: list[tuple]):
    """Offsets from each center and squared distances, term by term as :func:`squared_distance` adds them up."""
    for center, inverse in shapes:
        d = [c - float(m) for c, m in zip(x, center)]
        across = [d[0] * float(w[0]) + d[1] * float(w[1]) + d[2] * float(w[2]) for w in np.asarray(inverse)]
        yield d, np.maximum(d[0] * across[0] + d[1] * across[1] + d[2] * across[2], 0.0)


def _coordinates(batch) -> list:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]


def _by_bits(points: DataFrame, shapes, state, shift: int, last: int | None) -> dict[int, list]:
    """By start and leading bits, in order: count and sums of what shares the bits found so far."""
    import pyarrow as pa

    prefixes = [s["prefix"] for s in state]
    names = ["t", "bits", "n", *(f"s{k}" for k in range(9))]

    def run(batches):
        for batch in batches:
            columns: list = [[] for _ in names]
            for t, (d, d2) in enumerate(_distances(_coordinates(batch), shapes)):
                bits = d2.view(np.int64)
                if last is not None:
                    keep = bits >> last == prefixes[t]
                    bits, d = bits[keep], [c[keep] for c in d]
                kinds, at = np.unique(bits >> shift, return_inverse=True)
                weights = [None, *d, *(d[i] * d[j] for i, j in PAIRS)]
                sums = [np.bincount(at, w, minlength=len(kinds)) for w in weights]
                for c, x in zip(columns, [np.full(len(kinds), t), kinds, *sums]):
                    c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c).astype(np.int64 if k < 3 else float)) for k, c in enumerate(columns)], names=names
            )

    schema = "t long, bits long, n long, " + ", ".join(f"s{k} double" for k in range(9))
    summed = points.mapInArrow(run, schema).groupBy("t", "bits").agg(*(F.sum(c).alias(c) for c in names[2:]))
    out: dict[int, list] = {t: [] for t in range(len(shapes))}
    for r in summed.orderBy("t", "bits").toArrow().to_pylist():  # at most the exponents in use times 64, or 4,096, by start
        out[r["t"]].append(list(r.values())[1:])
    return out


def _sharing(points: DataFrame, shapes, state, shift: int) -> list[tuple]:
    """Distances and coordinates of the points that share each start's bits: ``FEW`` at most."""
    import pyarrow as pa

    prefixes = [s["prefix"] for s in state]

    def run(batches):
        for batch in batches:
            x = _coordinates(batch)
            for t, (_, d2) in enumerate(_distances(x, shapes)):
                keep = d2.view(np.int64) >> shift == prefixes[t]
                parts = [np.full(int(keep.sum()), t), d2[keep], *(c[keep] for c in x)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], names=["t", "d", *AXES])

    got = points.mapInArrow(run, "t long, d double, x double, y double, z double").toArrow()
    t, d, *x = (got.column(c).to_numpy() for c in ("t", "d", *AXES))
    x = np.column_stack(x)
    return [(d[t == k], x[t == k]) for k in range(len(shapes))]


def _first_tied(tied: DataFrame, v: list[Column], m: int) -> list[tuple[tuple, int]]:
    """The first m of tied points by coordinates, as (point, times); whole sets of lesser ones come from aggregates.

    Coordinate by coordinate, the m-th value parts those that are in for certain from those still tied.
    """
    out: list[tuple[tuple, int]] = []
    rows = tied.select(*(c.alias(a) for c, a in zip(v, AXES)))
    for axis in AXES:
        cut_at = order_statistics(rows, [(F.col(axis), m - 1)])[0]
        for point, times in _groups(rows.filter(F.col(axis) < cut_at)):
            out.append((point, times))
            m -= times
        rows = rows.filter(F.col(axis) == cut_at)
    return [*out, (tuple(rows.first()), m)]  # what is left are copies of one point


def _groups(rows: DataFrame):
    """Distinct points with their times, one part of the table after another: no more than a part is on the driver."""
    for r in rows.groupBy(*AXES).count().toLocalIterator():
        yield tuple(r[:3]), r[3]


def starts_big(cloud: DataFrame, n: int, h: int, v: list[Column] | None = None) -> list[tuple[str, np.ndarray, np.ndarray, bool]]:
    """:func:`starts` over a cloud of any size."""
    v = v or [F.col(a) for a in AXES]
    rows = cloud.select(*(c.alias(a) for c, a in zip(v, AXES)))
    v = [F.col(a) for a in AXES]
    got = axis_medians(rows, *AXES, n=n)
    center = np.array([got[f"mv{k}"] for k in range(3)])
    scale = np.array([max(got[f"sv{k}"], SCALE_FLOOR) for k in range(3)])
    z = [(c - float(m)) / float(s) for c, m, s in zip(v, center, scale)]
    length = F.sqrt(sum(x * x for x in z))
    signs = [F.when(length > 0, x / length).otherwise(x) for x in z]
    kinds = [[F.tanh(x) for x in z], signs]
    tanh, sign = (_finished(s)[2] for s in _moments(rows, [(k, F.lit(True)) for k in kinds], [[0.0] * 3] * 2))
    ranked = _with_mid_ranks(rows, n)
    middle, spread = (n + 1) / 2, math.sqrt((n * n - 1) / 12)
    kinds = [[(F.col(f"r{a}") - middle) / spread for a in AXES], [F.col(f"q{a}") for a in AXES]]
    spearman, score = (_finished(s)[2] for s in _moments(ranked, [(k, F.lit(True)) for k in kinds], [[0.0] * 3] * 2))
    pairs = [(0, 1), (0, 2), (1, 2)]
    got = axis_medians(rows, *z, *(z[a] + z[b] for a, b in pairs), *(z[a] - z[b] for a, b in pairs), n=n)
    gk = np.diag([got[f"sv{k}"] ** 2 for k in range(3)])
    for k, (a, b) in enumerate(pairs):
        gk[a, b] = gk[b, a] = (got[f"sv{3 + k}"] ** 2 - got[f"sv{6 + k}"] ** 2) / 4
    near = innermost(rows, v, [(center, np.diag(1 / scale**2))], h)[0]
    shapes = {"tanh": tanh, "spearman": spearman, "normal_score": score, "spatial_sign": sign, "ogk": gk}
    out = {k: (center, np.outer(scale, scale) * _correlation(c)) for k, c in shapes.items()}
    out["bacon"] = near["center"], near["scatter"]
    order = ("tanh", "spearman", "normal_score", "spatial_sign", "bacon", "ogk")
    return [(k, out[k][0], *linalg.regularized(out[k][1])) for k in order]


def _with_mid_ranks(rows: DataFrame, n: int) -> DataFrame:
    """Points with the mid-ranks r and normal scores q of their coordinates, found once for each distinct value."""

    @F.pandas_udf("double")
    def score(p: pd.Series) -> pd.Series:
        return pd.Series(normal_quantile(p.to_numpy()) if len(p) else np.zeros(0))

    for a in AXES:
        values = running_counts(rows.groupBy(a).count(), a)
        rank = F.col("below") + (F.col("count") + 1) / 2
        values = values.select(a, rank.alias(f"r{a}"), score((rank - 0.375) / (n + 0.25)).alias(f"q{a}"))
        rows = rows.join(values, a)  # a value that many points share is one row here: its join may be split
    return rows


#: Points about the h-th distance of a start that the driver holds at most.
BAND = 50_000


def bands(rows: DataFrame, v: list[Column], shapes: list[tuple], h: int) -> list[dict | None]:
    """For each (center, inverse) the points about the h-th distance, and the sums of all nearer ones.

    Counting rounds as in :func:`innermost`, until the h-th point's bits are shared by ``BAND`` points at most; neighbouring
    bits are added while they fit.  None where too many points are at one distance.
    """
    points = rows.select(*(c.cast("double").alias(a) for c, a in zip(v, AXES)))
    state = [{"left": h, "prefix": None, "n": 0, "sums": np.zeros(9)} for _ in shapes]
    out: list = [None] * len(shapes)
    going = list(range(len(shapes)))
    for shift, last in zip(SHIFTS, (None, *SHIFTS)):
        asked = {}
        for t, groups in _by_bits(points, [shapes[k] for k in going], [state[k] for k in going], shift, last).items():
            s, counts = state[going[t]], np.array([g[1] for g in groups])
            at = int(np.searchsorted(np.cumsum(counts), s["left"]))
            lo = hi = at
            while counts[lo : hi + 1].sum() <= BAND:  # a wider band, on either side in turn
                wider = (lo - 1, hi) if hi - at >= at - lo and lo else (lo, hi + 1) if hi + 1 < len(groups) else (lo - 1, hi)
                if wider[0] < 0 or counts[wider[0] : wider[1] + 1].sum() > BAND:
                    break
                lo, hi = wider
            low = at if counts[at] > BAND else lo
            s["n"] += int(counts[:low].sum())
            s["left"] -= int(counts[:low].sum())
            s["sums"] = s["sums"] + sum((np.array(g[2:]) for g in groups[:low]), np.zeros(9))
            s["prefix"] = groups[at][0]
            if counts[at] <= BAND:
                asked[going[t]] = (groups[lo][0], groups[hi][0])
        if asked:
            ks = sorted(asked)
            for k, x in zip(ks, _between(points, [shapes[k] for k in ks], [asked[k] for k in ks], shift)):
                ends = [float(np.array([b << shift], np.int64).view(np.float64)[0]) for b in (asked[k][0], asked[k][1] + 1)]
                out[k] = {"n": state[k]["n"], "sums": state[k]["sums"], "points": x, "ends": np.sqrt(ends), "shape": shapes[k]}
        going = [k for k in going if k not in asked]
        if not going:
            break
    return out


def _between(points: DataFrame, shapes, ends: list[tuple], shift: int) -> list[np.ndarray]:
    """Coordinates of the points whose leading bits of the distance lie between each start's ends."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = _coordinates(batch)
            for t, (_, d2) in enumerate(_distances(x, shapes)):
                bits = d2.view(np.int64) >> shift
                keep = (bits >= ends[t][0]) & (bits <= ends[t][1])
                parts = [np.full(int(keep.sum()), t), *(c[keep] for c in x)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts], names=["t", *AXES])

    got = points.mapInArrow(run, "t long, x double, y double, z double").toArrow()
    t, *x = (got.column(c).to_numpy() for c in ("t", *AXES))
    x = np.column_stack(x)
    return [x[t == k] for k in range(len(shapes))]


def from_band(band: dict | None, center, inverse, h: int) -> dict | None:
    """:func:`innermost` under a shape near the band's own, from the band alone; None where it cannot be told.

    Distances under the two shapes bound each other, A x and B x by the norms of A B^-1 and B A^-1 and the centers' way.
    While all nearer points than the band's are certain to stay within the h-th distance, and all farther ones without,
    the h nearest are the nearer ones and the first of the band.
    """
    if band is None or not 0 < h - band["n"] <= len(band["points"]):
        return None
    x = band["points"]
    d2 = next(_distances(list(x.T), [(center, inverse)]))[1]
    order = np.lexsort((x[:, 2], x[:, 1], x[:, 0], d2))[: h - band["n"]]
    radius = float(d2[order[-1]])
    before, (near, far) = np.asarray(band["shape"][0], float), band["ends"]
    try:
        now, then = (np.linalg.cholesky((w + w.T) / 2).T for w in (np.asarray(inverse), np.asarray(band["shape"][1])))
    except np.linalg.LinAlgError:
        return None
    grown, shrunk = np.linalg.norm(now @ np.linalg.inv(then), 2), np.linalg.norm(then @ np.linalg.inv(now), 2)
    way = before - center
    if band["n"] and not grown * near + np.linalg.norm(now @ way) < math.sqrt(radius) * (1 - 1e-9):
        return None
    if not (far - np.linalg.norm(then @ way)) / shrunk > math.sqrt(radius) * (1 + 1e-9):
        return None
    at = x[order] - before
    sums = band["sums"] + np.concatenate([at.sum(axis=0), [(at[:, i] * at[:, j]).sum() for i, j in PAIRS]])
    _, mean, cov = _finished((h, sums[:3], sums[3:], before))
    return {"center": mean, "scatter": cov, "radius": radius}


def _step(rows: DataFrame, v: list[Column], shapes: dict[int, tuple], h: int, held: dict[int, dict | None]) -> list[dict]:
    """:func:`innermost` of each start: by its band as long as that tells, else by a new band, else by all points."""
    found = {k: from_band(held.get(k), *shape, h) for k, shape in shapes.items()}
    lost = [k for k in shapes if found[k] is None]
    if lost:
        for k, band in zip(lost, bands(rows, v, [shapes[k] for k in lost], h)):
            held[k] = band
            found[k] = from_band(band, *shapes[k], h)
        lost = [k for k in lost if found[k] is None]
    if lost:
        for k, new in zip(lost, innermost(rows, v, [shapes[k] for k in lost], h)):
            found[k] = new
    return [found[k] for k in shapes]


def concentrate_big(rows: DataFrame, v: list[Column], first: list[dict], shape, h: int, most: int = 200) -> list[dict | None]:
    """C-steps of several starts at once, each to its own end.

    ``first`` holds center and scatter by start; ``shape`` makes of a subset's covariance the scatter that distances are
    taken by.  A step that changes no moment beyond rounding kept its subset: one exchanged point moves them by far more.
    Steps are small after the first ones, so most are taken from the points about the h-th distance, without a pass.
    """
    held: dict[int, dict | None] = {}
    state: list = [None] * len(first)
    at = [dict(s) for s in first]
    going = list(range(len(first)))
    for step in range(1, most + 1):
        shapes = {}
        for k in list(going):
            try:
                shapes[k] = at[k]["center"], np.linalg.inv(at[k]["scatter"])
            except np.linalg.LinAlgError:
                going.remove(k)
        if not going:
            break
        found = _step(rows, v, {k: shapes[k] for k in going}, h, held)
        for k, new in zip(list(going), found):
            new = new | {"scatter": shape(new["scatter"])}
            det, last = float(np.linalg.det(new["scatter"])), state[k]
            if last is not None:
                reach = np.abs(last["scatter"]).max()
                moved = max(np.abs(new["scatter"] - last["scatter"]).max(), np.abs(new["center"] - last["center"]).max() * math.sqrt(reach))
                if moved <= 1e-12 * max(reach, np.finfo(float).tiny):
                    state[k] = last | {"converged": True}
                    going.remove(k)
                    continue
                if det > last["det"] * (1 + 1e-12) + 1e-12:
                    going.remove(k)
                    continue
            state[k] = at[k] = new | {"det": det, "steps": step, "converged": False}
        # starts that have met go on as one
        for i, k in enumerate(list(going)):
            twin = next((j for j in going[:i] if j in going and np.array_equal(at[j]["scatter"], at[k]["scatter"])), None)
            if twin is not None:
                state[k] = {"same": twin}
                going.remove(k)
        if not going:
            break
    out = []
    for s in state:
        while s and "same" in s:
            s = state[s["same"]]
        out.append(s)
    return out


def det_mcd_big(cloud: DataFrame, n: int, cov: np.ndarray, alpha: float | None = None, least_n: int = 15) -> dict:
    """:func:`det_mcd` over a cloud of any size, given its count and covariance."""
    if alpha is None:
        alpha = pilot_alpha(pilot_far_points(cloud)["share"]) if n else 0.5
    h = h_size(n, alpha)
    if n < least_n or h <= 3:
        return {"policy": "disabled_small_n", "h": h}
    if _deficient(cov):
        return {"policy": "disabled_rank_deficient", "h": h}
    begun = starts_big(cloud, n, h)
    v = [F.col(a) for a in AXES]
    ended = concentrate_big(cloud, v, [{"center": c, "scatter": s} for _, c, s, _ in begun], lambda s: s, h)
    best = None
    for (name, _, _, ridge), found in zip(begun, ended):
        if found and (best is None or found["det"] < best["det"]):
            best = found | {"start": name, "ridge": ridge}
    if best is None:
        return {"policy": "disabled_rank_deficient", "h": h}
    factor = linalg.consistency(n, 3, h) * linalg.small_sample(n, 3, alpha)
    policy = "chi2_regularized" if best["ridge"] else "hr_adjusted_f"
    return best | {"scatter": best["scatter"] * factor, "h": h, "alpha": alpha, "policy": policy}


def mrcd_big(cloud: DataFrame, n: int, alpha: float = 0.5, condition: float = 50.0, least_rho: float = 1e-6) -> dict:
    """:func:`mrcd` over a cloud of any size."""
    h = h_size(n, alpha)
    if n < 4 or h < 2:
        return {"policy": "disabled_small_n", "h": h}
    got = axis_medians(cloud, *AXES, n=n)
    center = np.array([got[f"mv{k}"] for k in range(3)])
    scale = np.array([max(got[f"sv{k}"], SCALE_FLOOR) for k in range(3)])
    z = cloud.select(*(((F.col(a) - float(m)) / float(s)).alias(a) for a, m, s in zip(AXES, center, scale)))
    v = [F.col(a) for a in AXES]
    factor = linalg.consistency(n, 3, h)
    begun = starts_big(z, n, h)
    first = innermost(z, v, [(c, np.linalg.inv(s)) for _, c, s, _ in begun], h)
    rho = common_rho([rho_for(f["scatter"], factor, condition, least_rho) for f in first])
    shape = lambda s: rho * np.eye(3) + (1 - rho) * factor * s
    ended = concentrate_big(z, v, [{"center": f["center"], "scatter": shape(f["scatter"])} for f in first], shape, h)
    best = min((e for e in ended if e), key=lambda e: e["det"])
    return {
        "center": center + scale * best["center"], "scatter": np.outer(scale, scale) * best["scatter"], "rho": rho, "h": h,
        "policy": "none",
    }
