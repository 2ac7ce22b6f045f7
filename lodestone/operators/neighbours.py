"""Exact nearest neighbours of a cloud of any size, without a cross join.

Equal points become one place first, with the least ``k + 1`` indices of its points: more of them cannot be anyone's
neighbours, so a place that a third of the cloud shares is one row.  A tree of median splits over a sample deals the places to leaves,
whose ids are the join key.  In a first round each leaf finds the nearest of its own places, which bounds the distance; in a
second one a place meets the leaves that its ball reaches into.  Ties go by index, and the leaves' balls make the answer exact
wherever the splits lie; the sample only balances them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.store import cut

#: Places of a leaf, about; places that the splits are taken from.
LEAF, SAMPLE = 2_000, 200_000
AXES = ("x", "y", "z")


class Tree:
    """Median splits of the widest axis: node k has the children 2 k + 1 and 2 k + 2; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(leaves - 1, 0).bit_length()
        self.axis = np.zeros(2**self.depth - 1, np.int8)
        self.at = np.zeros(2**self.depth - 1)
        parts = [sample]
        for k in range(len(self.at)):
            part = parts[k]
            if len(part):
                self.axis[k] = np.ptp(part, axis=0).argmax()
                v = part[:, self.axis[k]]
                self.at[k] = np.median(v)
                left = v <= self.at[k]
                parts += [part[left], part[~left]]
            else:
                parts += [part, part]
            parts[k] = None

    def leaves(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.at[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def reached(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the point, leaf) for each leaf that a closed ball may hold points of."""
        who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            off = points[who, self.axis[node]] - self.at[node]
            # one unit more in the last place than the radius, since the offset was rounded
            slack = np.nextafter(radius[who], np.inf) + np.spacing(np.abs(points[who, self.axis[node]]))
            left, right = off <= slack, off >= -slack
            who = np.concatenate([who[left], who[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return who, node - (2**self.depth - 1)


def _candidates(points: np.ndarray, places: np.ndarray, ids: list[list[int]], k: int):
    """For each point the k + 1 nearest (squared distance, index) among the places' points."""
    owner = np.repeat(np.arange(len(places)), [len(x) for x in ids])
    index = np.array([i for x in ids for i in x], np.int64)
    for a in range(0, len(points), 512):
        d = points[a : a + 512, None, :] - places[None, :, :]
        d2 = (d[:, :, 0] ** 2 + d[:, :, 1] ** 2 + d[:, :, 2] ** 2)[:, owner]
        most = min(k + 1, len(index))
        reach = np.partition(d2, most - 1, axis=1)[:, most - 1]
        for row in range(len(d2)):
            near = np.flatnonzero(d2[row] <= reach[row])
            near = near[np.lexsort((index[near], d2[row][near]))[:most]]
            yield d2[row][near], index[near]


def nearest(points: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """(raw_index, neighbour, nth): the k nearest other points of each, ties by index; nth from 1."""
    import pyarrow as pa

    spark = points.sparkSession
    least = F.slice(F.array_sort(F.collect_list("raw_index")), 1, k + 1)
    # a place's indices are cut to k + 1 in parts before they meet, so that no task gathers a hot place
    part = F.pmod(F.xxhash64("raw_index"), F.lit(64)).alias("_part")
    places = points.groupBy(*AXES, part).agg(least.alias("ids"))
    places = places.groupBy(*AXES).agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    places = cut(places.withColumn("place", F.monotonically_increasing_id()), "places")
    n = places.count()
    if not n:
        return spark.createDataFrame([], "raw_index long, neighbour long, nth int")
    share = min(1.0, SAMPLE / n)
    sample = places.select(*AXES) if share == 1 else places.select(*AXES).sample(share, seed=1)
    tree = spark.sparkContext.broadcast(Tree(np.array(sample.collect(), float).reshape(-1, 3), -(-n // leaf)))

    def deal(batches):
        for batch in batches:
            at = np.column_stack([batch.column(a).to_numpy() for a in AXES]) if len(batch) else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.value.leaves(at))], names=[*batch.schema.names, "leaf"])

    shape = "x double, y double, z double, ids array<long>, place long"
    dealt = cut(places.select(*AXES, "ids", "place").mapInArrow(deal, f"{shape}, leaf long"), "dealt")
    found = "place long, x double, y double, z double, d2 array<double>, near array<long>"

    def coordinates(t: pa.Table) -> np.ndarray:
        return np.column_stack([t.column(a).to_numpy() for a in AXES]).reshape(-1, 3)

    def rows(t: pa.Table, got: list) -> pa.Table:
        d2, near = ([list(map(kind, g[i])) for g in got] for i, kind in ((0, float), (1, int)))
        return pa.table(
            {c: t.column(c) for c in ("place", *AXES)}
            | {"d2": pa.array(d2, pa.list_(pa.float64())), "near": pa.array(near, pa.list_(pa.int64()))}
        )

    def within(t: pa.Table) -> pa.Table:
        at = coordinates(t)
        return rows(t, list(_candidates(at, at, t.column("ids").to_pylist(), k)))

    def ask(batches):
        for batch in batches:
            at = np.column_stack([batch.column(a).to_numpy() for a in AXES]) if len(batch) else np.zeros((0, 3))
            full = [x[-1] if len(x) > k else np.inf for x in batch.column("d2").to_pylist()]
            who, leaves = tree.value.reached(at, np.sqrt(np.array(full, float)))
            other = leaves != tree.value.leaves(at)[who]
            taken = batch.select(["place", *AXES]).take(pa.array(who[other]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves[other])], names=["place", *AXES, "leaf"])

    def beyond(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(held) or not len(asked):
            return pa.table({c: [] for c in ("place", *AXES, "d2", "near")}).cast(rows(asked.slice(0, 0), []).schema)
        at = coordinates(asked)
        return rows(asked, list(_candidates(at, coordinates(held), held.column("ids").to_pylist(), k)))

    first = cut(dealt.groupBy("leaf").applyInArrow(within, found), "within")
    asked = first.mapInArrow(ask, "place long, x double, y double, z double, leaf long")
    second = dealt.groupBy("leaf").cogroup(asked.groupBy("leaf")).applyInArrow(beyond, found)
    pairs = first.union(second).select("place", F.explode(F.arrays_zip("d2", "near")).alias("c"))
    best = pairs.groupBy("place").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k + 1).alias("best"))
    # back to the points: a hot place is one row here, so its join may be split
    by_place = places.select(*AXES, "place").join(best, "place").select(*AXES, "best")
    each = points.select("raw_index", *AXES).join(by_place, list(AXES))
    others = F.slice(F.filter("best", lambda c: c["near"] != F.col("raw_index")), 1, k)
    return each.select("raw_index", F.posexplode(others).alias("_nth", "c")).select(
        "raw_index", F.col("c.near").alias("neighbour"), (F.col("_nth") + 1).alias("nth")
    )
