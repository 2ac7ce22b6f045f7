"""Small symmetric matrices and the distributions behind the robust cutoffs (no SciPy)."""

from __future__ import annotations

import math

import numpy as np


def jacobi_eigen(matrix, sweeps: int = 32, tolerance: float = 1e-15):
    """Eigenvalues, ascending, and eigenvectors (columns) of a symmetric 3 x 3 matrix by cyclic rotations.

    In each vector the entry of largest magnitude is not negative.  The third result tells convergence.
    """
    a = np.array(matrix, float)
    scale = np.abs(a).max()
    v = np.eye(3)
    if scale == 0 or not np.isfinite(scale):
        return np.diag(a).copy(), v, bool(np.isfinite(scale))
    a /= scale
    done = False
    for _ in range(sweeps):
        if max(abs(a[0, 1]), abs(a[0, 2]), abs(a[1, 2])) <= tolerance:
            done = True
            break
        for p, q in ((0, 1), (0, 2), (1, 2)):
            if a[p, q] == 0:
                continue
            theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
            t = math.copysign(1.0, theta) / (abs(theta) + math.hypot(theta, 1.0))
            c = 1 / math.hypot(t, 1.0)
            turn = np.eye(3)
            turn[p, p] = turn[q, q] = c
            turn[p, q], turn[q, p] = t * c, -t * c
            a = turn.T @ a @ turn
            a[p, q] = a[q, p] = 0.0
            v = v @ turn
    else:
        done = max(abs(a[0, 1]), abs(a[0, 2]), abs(a[1, 2])) <= tolerance
    order = np.argsort(np.diag(a), kind="stable")
    v = v[:, order]
    for k in range(3):
        if v[np.abs(v[:, k]).argmax(), k] < 0:
            v[:, k] = -v[:, k]
    return np.diag(a)[order] * scale, v, done


def principal_frame(scatter, tau2: float = 4.0):
    """Axes (columns, by falling spread), spreads, half extents, and whether the canonical axes stand in.

    They do where the rotation did not converge or two spreads are too close to tell the axes apart.
    """
    values, vectors, done = jacobi_eigen(scatter)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.abs(values).max()
    gap = min(values[0] - values[1], values[1] - values[2]) / top if top > 0 else 0.0
    canonical = not done or not np.isfinite(vectors).all() or gap <= 256 * np.finfo(float).eps
    if canonical:
        vectors, values = np.eye(3), np.diag(np.asarray(scatter, float)).copy()
    half = math.sqrt(tau2) * np.sqrt(np.maximum(values, 0.0))
    return vectors, values, half, canonical


def regularized(scatter, floor: float = 1e-10):
    """The scatter with its eigenvalues lifted to a share of the greatest by a ridge, and whether it was needed."""
    s = (np.asarray(scatter, float) + np.asarray(scatter, float).T) / 2
    values = jacobi_eigen(s)[0]
    least = floor * max(np.abs(values).max(), np.finfo(float).tiny)
    if values[0] >= least:
        return s, False
    return s + np.eye(3) * (least - values[0]), True


def gamma_p(a: float, x: float) -> float:
    """Regularized lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    tiny = 1e-300  # continued fraction, modified Lentz
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_cdf(x: float, k: float) -> float:
    return gamma_p(k / 2, x / 2)


def f_cdf(x: float, a: float, b: float) -> float:
    return beta_i(a / 2, b / 2, a * x / (a * x + b)) if x > 0 else 0.0


def quantile(cdf, p: float) -> float:
    """Inverse of a distribution function on the positive numbers, by bisection."""
    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(128):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(n: int, p: int, h: int) -> float:
    """Factor that makes the scatter of the h innermost of n normal points unbiased."""
    share = h / n
    if share >= 1:
        return 1.0
    return share / chi2_cdf(quantile(lambda x: chi2_cdf(x, p), share), p + 2)


def small_sample(n: int, p: int, alpha: float) -> float:
    """Published small-sample factor of the minimum covariance determinant for p > 2."""
    # fixed values: (a, b) at 2 and 3 times p squared, for alpha 0.5 and 0.875
    table = {
        0.5: ((-1.42764571687802, 1.26263336932151, 2), (-1.06141115981725, 1.28907991440387, 3)),
        0.875: ((-0.455179464070565, 1.11192541278794, 2), (-0.294241208320834, 1.09649329149811, 3)),
    }
    at = {}
    for share, ((a2, b2, m2), (a3, b3, m3)) in table.items():
        y2, y3 = math.log(-a2 / p**b2), math.log(-a3 / p**b3)
        slope = (y3 - y2) / math.log(m2 / m3)
        at[share] = 1 - math.exp(y2 + slope * math.log(m2 * p * p)) / n**slope
    if alpha <= 0.875:
        f = at[0.5] + (at[0.875] - at[0.5]) / 0.375 * (alpha - 0.5)
    else:
        f = at[0.875] + (1 - at[0.875]) / 0.125 * (alpha - 0.875)
    return 1 / f


def hardin_rocke(n: int, p: int, h: int, share: float = 0.975, adjusted: bool = True) -> float:
    """Cutoff of squared robust distances by the scaled F approximation."""
    alpha = (n - h) / n
    q = quantile(lambda x: chi2_cdf(x, p), 1 - alpha)
    c_alpha = (1 - alpha) / chi2_cdf(q, p + 2)
    c2 = -chi2_cdf(q, p + 2) / 2
    c3 = -chi2_cdf(q, p + 4) / 2
    c4 = 3 * c3
    b1 = c_alpha * (c3 - c4) / (1 - alpha)
    b2 = 0.5 + c_alpha / (1 - alpha) * (c3 - q / p * (c2 + (1 - alpha) / 2))
    v1 = (1 - alpha) * b1**2 * (alpha * (c_alpha * q / p - 1) ** 2 - 1) - 2 * c3 * c_alpha**2 * (
        3 * (b1 - p * b2) ** 2 + (p + 2) * b2 * (2 * b1 - p * b2)
    )
    v2 = n * (b1 * (b1 - p * b2) * (1 - alpha)) ** 2 * c_alpha**2
    m = 2 / (c_alpha**2 * v1 / v2)
    if adjusted:
        m *= math.exp(0.725 - 0.00663 * p - 0.0780 * math.log(n))
    f = quantile(lambda x: f_cdf(x, p, m - p + 1), share)
    return f * p * m / (m - p + 1) * c_alpha
