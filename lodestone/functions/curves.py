"""Cells and keys of space-filling curves, as column expressions with NumPy twins.

A Hilbert state is an entry corner (8) and a direction (3).  From the published recurrence a table is
derived once: for each state and cell label, the Gray rank and the next state.  Encoding a point is then a
fold over the levels with two look-ups each; with unequal depths a level appends the bits of its active
axes only.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entry corner of each Gray rank and its direction.  Fixed values.
ENTRY = (0, 0, 0, 3, 3, 6, 6, 5)
DIRECTION = (0, 1, 1, 2, 2, 1, 1, 0)


def max_code(bits: int) -> int:
    return 0 if bits == 0 else (1 << min(bits, 32)) - 1


def quantize(v: Column, lo: float, hi: float, bits: int) -> Column:
    """Cell of v in [lo, hi] cut into 2 ** bits; 0 for what has no place."""
    if bits == 0 or not lo < hi or not np.isfinite([lo, hi]).all():
        return F.lit(0).cast("long")
    top = max_code(bits)
    cell = F.least(F.floor((v - lo) / (hi - lo) * float(2**bits)), F.lit(top))
    return F.when(v.isNull() | F.isnan(v) | (v <= lo), 0).when(v >= hi, top).otherwise(cell).cast("long")


def quantize_array(v: np.ndarray, lo: float, hi: float, bits: int) -> np.ndarray:
    """The same in extended precision, as batch mode computes it."""
    if bits == 0 or not lo < hi:
        return np.zeros(len(v), np.int64)
    wide = np.asarray(v, np.longdouble)
    with np.errstate(invalid="ignore"):
        cell = np.floor((wide - np.longdouble(lo)) / (np.longdouble(hi) - np.longdouble(lo)) * np.longdouble(2**bits))
        cell = np.where(wide <= lo, 0, np.where(wide >= hi, max_code(bits), np.minimum(cell, max_code(bits))))
    return np.where(np.isfinite(v), cell, 0).astype(np.int64)


def check_depths(bits: tuple[int, int, int]) -> None:
    if min(bits) < 0 or max(bits) > 32 or sum(bits) > 63:
        raise ValueError(f"depths {bits} do not fit a 63-bit key")


def key_layout(bits: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """(axis, level, place in a Morton key) of every bit, from the least significant."""
    out = []
    for level in range(max(bits)):
        for axis in range(3):
            if bits[axis] > level:
                out.append((axis, level, len(out)))
    return out


def morton(q: list[Column], bits: tuple[int, int, int]) -> Column:
    """Interleaved key; an axis stops giving bits at its depth."""
    check_depths(bits)
    key = F.lit(0).cast("long")
    for axis, level, place in key_layout(bits):
        bit = F.shiftright(q[axis].cast("long"), level).bitwiseAND(F.lit(1).cast("long"))
        key = key.bitwiseOR(F.shiftleft(bit, place))
    return key


def morton_array(q: np.ndarray, bits: tuple[int, int, int]) -> np.ndarray:
    key = np.zeros(len(q), np.int64)
    for axis, level, place in key_layout(bits):
        key |= ((q[:, axis] >> level) & 1) << place
    return key


def _rot_right(x: int, d: int) -> int:
    return ((x >> d) | (x << (3 - d))) & 7


def _rot_left(x: int, d: int) -> int:
    return _rot_right(x, (3 - d) % 3)


@cache
def steps(mask: int) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """For the axes of ``mask``: appended bits and next state by state * 8 + label; and their inverse.

    State is entry * 3 + direction.  The inverse gives, by state * 8 + appended bits, the label, where the bits
    of axes that are not active are 0.
    """
    append, follow, label_of = [0] * 192, [0] * 192, [0] * 192
    for state in range(24):
        e, d = divmod(state, 3)
        free = _rot_right(mask, d)
        for label in range(8):
            t = _rot_right(label ^ e, d)
            g = t ^ (t >> 1) ^ (t >> 2)
            bits = 0
            for j in (2, 1, 0):
                if free >> j & 1:
                    bits = bits << 1 | (g >> j & 1)
            append[state * 8 + label] = bits
            follow[state * 8 + label] = (e ^ _rot_left(ENTRY[g], d)) * 3 + (d + DIRECTION[g] + 1) % 3
            if label & ~mask == 0:
                label_of[state * 8 + bits] = label
    return tuple(append), tuple(follow), tuple(label_of)


def masks(bits: tuple[int, int, int]) -> list[int]:
    """Active axes by level, from the top."""
    return [sum(1 << a for a in range(3) if bits[a] > level) for level in range(max(bits) - 1, -1, -1)]


#: Levels that one look-up takes.
STRIDE = 3


@cache
def strides(group: tuple[int, ...]) -> tuple[int, ...]:
    """Several levels at once: by state and each axis's bits of these levels, the appended bits and then the next state."""
    n = len(group)
    place = np.arange(24 << 3 * n)
    state, key = place >> 3 * n, np.zeros(len(place), np.int64)
    for k, mask in enumerate(group):
        append, follow, _ = (np.array(t) for t in steps(mask))
        label = sum((place >> (2 - axis) * n + n - 1 - k & 1) << axis for axis in range(3))
        at = state * 8 + label
        key = key << bin(mask).count("1") | append[at]
        state = follow[at]
    return tuple((key << 5 | state).tolist())


def hilbert(q: list[Column], bits: tuple[int, int, int]) -> Column:
    """Compact Hilbert key; with equal depths the standard one.  A look-up for each ``STRIDE`` levels, in generated code."""
    check_depths(bits)
    levels = masks(bits)
    key, found = F.lit(0).cast("long"), F.lit(0)
    for k in range(0, len(levels), STRIDE):
        group = tuple(levels[k : k + STRIDE])
        n, low = len(group), max(bits) - k - len(group)
        # as one text: a literal for each number would be as many calls
        table = F.split(F.lit(",".join(map(str, strides(group)))), ",").cast("array<int>")
        place = F.shiftleft(found.bitwiseAND(F.lit(31)), 3 * n)
        for axis, c in enumerate(q):
            part = F.shiftright(c.cast("long"), low).bitwiseAND(F.lit((1 << n) - 1).cast("long")).cast("int")
            place = place.bitwiseOR(F.shiftleft(part, (2 - axis) * n))
        found = F.get(table, place)
        key = F.shiftleft(key, sum(bin(m).count("1") for m in group)).bitwiseOR(F.shiftright(found, 5).cast("long"))
    return key


def hilbert_array(q: np.ndarray, bits: tuple[int, int, int]) -> np.ndarray:
    check_depths(bits)
    key, state = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    for k, mask in enumerate(masks(bits)):
        level = max(bits) - 1 - k
        append, follow, _ = (np.array(t) for t in steps(mask))
        label = ((q >> level) & 1) @ np.array([1, 2, 4])
        place = state * 8 + label
        key = key << bin(mask).count("1") | append[place]
        state = follow[place]
    return key


def hilbert_decode_array(key: np.ndarray, bits: tuple[int, int, int]) -> np.ndarray:
    """Cells (n, 3) of keys; a key beyond the last cell is an error."""
    check_depths(bits)
    key = np.asarray(key, np.int64)
    if len(key) and (key.min() < 0 or int(key.max()) >> sum(bits)):
        raise ValueError("key out of range")
    q, state, left = np.zeros((len(key), 3), np.int64), np.zeros(len(key), np.int64), sum(bits)
    for k, mask in enumerate(masks(bits)):
        level = max(bits) - 1 - k
        _, follow, label_of = (np.array(t) for t in steps(mask))
        n = bin(mask).count("1")
        left -= n
        label = label_of[state * 8 + ((key >> left) & ((1 << n) - 1))]
        for axis in range(3):
            q[:, axis] |= (label >> axis & 1) << level
        state = follow[state * 8 + label]
    return q


def hilbert_decode(key: Column, bits: tuple[int, int, int]) -> Column:
    """Cells of a key as an array of three numbers."""

    @F.pandas_udf("array<long>")
    def decode(keys: pd.Series) -> pd.Series:
        return pd.Series(list(hilbert_decode_array(keys.to_numpy(), bits)))

    return decode(key)
