"""Depths of the three axes: bit budgets and allocation rules (driver-side integers)."""

from __future__ import annotations

import math

KEY_BITS, AXIS_BITS = 63, 32


def equal_depth(uniform: int = 10, most: int = KEY_BITS) -> int:
    return min(uniform, most // 3, 21)


def sample_count_depth(n: int, uniform: int = 10, most: int = KEY_BITS) -> int:
    """Depth that gives n points cells of their own, as far as the budget goes."""
    needed = -(-max(n - 1, 0).bit_length() // 3)
    return min(max(uniform, needed), min(most // 3, 21))


def within_budget(bits: list[int], least: int = 0, most: int = KEY_BITS, axis_most: int = AXIS_BITS) -> tuple:
    """Clamp each depth, then take from the deepest axis, the first of equals, until the sum fits."""
    out = [min(max(b, least), axis_most) for b in bits]
    while sum(out) > min(KEY_BITS, most) and max(out) > 0:
        out[out.index(max(out))] -= 1
    return tuple(out)


def monotone_half(extents: list[float], uniform: int = 10, most: int = KEY_BITS, least: int = 1) -> tuple:
    """Half as many bits again as one axis has: ``least`` for each, the rest to the longest axes first."""
    cap = min(equal_depth(uniform, most), AXIS_BITS)
    least = min(least, cap)
    left = min(max(3 * cap // 2, 3 * least), 3 * cap) - 3 * least
    out = [least] * 3
    for axis in sorted(range(3), key=lambda a: (-extents[a], a)):
        more = min(cap - least, left)
        out[axis] += more
        left -= more
    return tuple(out)


def occupancy_request(half: list[float], n: int, least: int = 1) -> tuple:
    """Depths at which a cell of the box holds about one of n points."""
    volume = 8.0 * half[0] * half[1] * half[2]
    if n < 1 or not volume > 0 or not math.isfinite(volume):
        return (least,) * 3
    side = (volume / n) ** (1 / 3)
    return tuple(min(max(least, math.ceil(math.log2(2 * a / side))), AXIS_BITS) for a in half)


def minimax_projection(request: tuple, half: list[float], most: int = KEY_BITS) -> tuple:
    """Of the depths within a request that use the budget, those with the least greatest cell width.

    Near-equal widths (8 units in the last place) are ties; the lexicographically largest depths win them.
    """
    budget = min(sum(request), KEY_BITS, most)
    width = lambda a, b: 1 + math.log2(half[a]) - b
    best, least = None, math.inf
    for x in range(request[0], -1, -1):
        for y in range(min(request[1], budget - x), -1, -1):
            z = budget - x - y
            if not 0 <= z <= request[2]:
                continue
            worst = max(width(0, x), width(1, y), width(2, z))
            if worst < least - 8 * 2.220446049250313e-16 * max(1.0, abs(least) if best else 1.0):
                best, least = (x, y, z), worst
    return best or tuple(request)


def occupancy(half: list[float], n: int, least: int = 1, most: int = KEY_BITS) -> tuple:
    """The request, brought within the budget by minimax widths."""
    request = occupancy_request(half, n, least)
    if sum(request) <= min(KEY_BITS, most) or min(half) <= 0:
        return within_budget(list(request), 0, most)
    return minimax_projection(request, half, most)


def raw_depths(rule: str, half: list[float], n: int, uniform: int = 10, least: int = 1) -> tuple:
    """Depths for the methods that quantize the raw box."""
    if rule == "uniform":
        return (equal_depth(uniform),) * 3
    if rule == "sample_count":
        return (sample_count_depth(n, uniform),) * 3
    if rule == "monotone_half":
        return monotone_half([2 * a for a in half], uniform)
    if rule == "occupancy_floor10":
        return occupancy(half, n, max(least, equal_depth(uniform)))
    if rule in ("occupancy", "frame_core", "hybrid"):
        return occupancy(half, n, least)
    raise ValueError(f"unknown bit rule {rule}")
