"""Local refinement of a path: moves that strictly shorten it, within windows of the order.

Each step depends on the last.  A cloud that fits a task is refined as a whole; a larger one in blocks of ranks whose ends
are held, so blocks do not depend on each other and the path never grows.  Every other round the blocks begin half a block
later, so the ends of one round lie within the blocks of the next.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.store import cut

WINDOW, ALTERNATIONS, SWAPS = 16, 8, 16
#: Ranks of a block; rounds over all blocks.
BLOCK, ROUNDS = 4096, 4


def length(points: np.ndarray, order: np.ndarray) -> float:
    return float(np.sqrt((np.diff(points[order], axis=0) ** 2).sum(axis=1)).sum())


def _gap(points: np.ndarray, a: int, b) -> np.ndarray:
    return np.sqrt(((points[b] - points[a]) ** 2).sum(axis=-1))


def _pull_forward(points: np.ndarray, order: np.ndarray, held: bool) -> bool:
    """After each place, bring the best of the next points forward."""
    n, changed = len(order), False
    for at in range(n - 2):
        last = min(at + WINDOW, n - 1 - held)
        js = np.arange(at + 2, last + 1)
        if not len(js):
            break
        moved, here, after = order[js], order[at], order[at + 1]
        d = _gap(points, here, moved) + _gap(points, after, moved) - _gap(points, here, after)
        d -= np.sqrt(((points[moved] - points[order[js - 1]]) ** 2).sum(axis=1))
        inner = js + 1 < n
        nxt = order[np.minimum(js + 1, n - 1)]
        rejoin = np.sqrt(((points[nxt] - points[order[js - 1]]) ** 2).sum(axis=1))
        d += np.where(inner, rejoin - np.sqrt(((points[nxt] - points[moved]) ** 2).sum(axis=1)), 0.0)
        k = int(d.argmin())
        if d[k] < -1e-12:
            j = js[k]
            order[at + 1 : j + 1] = np.concatenate([[order[j]], order[at + 1 : j]])
            changed = True
    return changed


def _reverse_segments(points: np.ndarray, order: np.ndarray, held: bool) -> bool:
    n, changed = len(order), False
    for i in range(n - 2):
        js = np.arange(i + 2, min(i + WINDOW, n - 1 - held) + 1)
        if not len(js):
            break
        a, b, c = order[i], order[i + 1], order[js]
        d = _gap(points, a, c) - _gap(points, a, b)
        inner = js + 1 < n
        nxt = order[np.minimum(js + 1, n - 1)]
        d = d + np.where(inner, _gap(points, b, nxt) - np.sqrt(((points[nxt] - points[c]) ** 2).sum(axis=1)), 0.0)
        k = int(d.argmin())
        if d[k] < -1e-12:
            order[i + 1 : js[k] + 1] = order[i + 1 : js[k] + 1][::-1]
            changed = True
    return changed


def _swap_neighbours(points: np.ndarray, order: np.ndarray, held: bool) -> bool:
    changed = False
    for i in range(int(held), len(order) - 1 - held):
        near = order[max(i - 1, 0) : i + 3]
        tried = near.copy()
        k = min(i, 1)
        tried[k], tried[k + 1] = tried[k + 1], tried[k]
        if length(points, tried) < length(points, near) - 1e-12:
            order[i], order[i + 1] = order[i + 1], order[i]
            changed = True
    return changed


def refine(points: np.ndarray, order: np.ndarray, held: bool = False) -> np.ndarray:
    """A permutation whose path is never longer than the given one; with ``held`` its first and last point stay."""
    order = np.array(order)
    for _ in range(ALTERNATIONS):
        moved = _pull_forward(points, order, held)
        if not (_reverse_segments(points, order, held) or moved):
            break
    for _ in range(SWAPS):
        if not _swap_neighbours(points, order, held):
            break
    return order


def refine_big(ordered: DataFrame, n: int, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """An ordered cloud of any size with the ranks of a path that is never longer."""
    columns = ordered.columns

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        points = pdf[["x", "y", "z"]].to_numpy()
        at = refine(points, np.arange(len(pdf)), len(pdf) < n)
        return pdf.iloc[at].assign(rank=pdf["rank"].to_numpy())[columns]

    schema = ordered.schema
    for k in range(1 if n <= block else rounds):
        number = F.floor((F.col("rank") + (block // 2 if k % 2 else 0)) / F.lit(block))
        # each round ends in a table, so the next one does not run the moves again
        ordered = cut(ordered.groupBy(number.alias("_block")).applyInPandas(one, schema), "refined")
    return ordered
