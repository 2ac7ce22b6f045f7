"""Embedding near-duplicates by an epsilon grid order join.

Vectors of cosine c apart lie at distance sqrt(2 - 2 c) on the unit sphere, so a least cosine is a greatest
distance, epsilon.  Vectors are turned onto their principal axes (a rotation: distances stay), ordered by
their cells of side epsilon on the leading axes, and cut into blocks of neighbours in that order.  Pairs of
intervals of the order are expanded from the whole down to blocks, and a pair whose bounding boxes are farther
apart than epsilon is dropped with all that lies below it.  A pair of blocks is joined by one task, which halves
the intervals in the same way before it multiplies what is left.

Equal vectors become one before the join.  A pair of blocks returns, for each vector, the number of links,
and a spanning forest of its links: as many rows as vectors, however many links there are.

Defined results
* a null vector, a null or non-finite component, a vector of zeros or of another length than most vectors: links
  with nothing, is its own component and is kept;
* links compare cosines in double precision, at the limit included; equal vectors are links of each other;
* repeated rows with one vec_id count as vectors of their own and share the id; a null vec_id is joined too and
  is never the least of a component that has another id;
* an empty table gives no rows; other columns (labels too) are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut
from lodestone.llm.components import connected_components

#: Least cosine; leading axes that make the order; vectors of a block, and of an interval multiplied at once.
COSINE, LEADING, BLOCK, LEAF = 0.95, 6, 4096, 512
#: Blocks below one node of the next level of intervals.
FAN = 8
#: Room for rounding where boxes or cells decide; links are decided by the cosine itself.
SLACK = 1e-9


def _unit_rows(column, width: int):
    """The vectors of an Arrow list column as an array of doubles, scaled to length 1."""
    import numpy as np

    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
    # by the greatest component first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _moments(vectors: DataFrame, width: int):
    """Principal axes of all vectors, from sums over them: width * width numbers from each task."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = _unit_rows(batch.column("v"), width)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": np.arange(width * width), "x": total.ravel()})

    sums = vectors.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x"))
    scatter = np.zeros(width * width)
    for r in sums.collect():  # width * width rows
        scatter[r["at"]] = r["x"]
    return np.linalg.eigh(scatter.reshape(width, width))[1][:, ::-1]


def apart(lo_a, hi_a, lo_b, hi_b) -> float:
    """Square of the least distance between two boxes."""
    import numpy as np

    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float((gap * gap).sum())


class Links:
    """Numbers of links by weight, and a spanning forest of the links, over the places 0 .. n - 1."""

    def __init__(self, weights):
        import numpy as np

        self.weights = weights.astype(float)  # whole numbers below 2 ** 53
        self.count = np.zeros(len(weights))
        self.label = np.arange(len(weights))
        self.forest: list[tuple] = []

    def add(self, hit, s: int, p: int, alone: bool) -> None:
        """A matrix of links of the places from s on with those from p on; ``alone``: the two are one interval."""
        import numpy as np

        e, q = s + hit.shape[0], p + hit.shape[1]
        numbers = hit.astype(float)
        self.count[s:e] += numbers @ self.weights[p:q]
        if not alone:
            self.count[p:q] += self.weights[s:e] @ numbers
        i, j = np.nonzero(hit & (self.label[s:e, None] != self.label[None, p:q]))
        i, j = i + s, j + p
        while len(i):
            # each component hooks on to the least one it is linked to; the links used make the forest
            a, b = self.label[i], self.label[j]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((lo, hi))
            first = order[np.concatenate([[True], hi[order][1:] != hi[order][:-1]])]
            self.forest.append((i[first], j[first]))
            up = np.arange(len(self.label))
            up[hi[first]] = lo[first]
            while (nxt := up[up]).tobytes() != up.tobytes():
                up = nxt
            self.label = up[self.label]
            apart_still = self.label[i] != self.label[j]
            i, j = i[apart_still], j[apart_still]


def join_intervals(x, split: int, cosine: float, links: Links) -> None:
    """Add the links between the ordered intervals x[:split] and x[split:], or within x if nothing is split off.

    Intervals are halved until both are short; a pair whose boxes are provably distant is skipped.
    """
    import numpy as np

    limit = 2 - 2 * cosine + SLACK
    boxes: dict = {}

    def box(s: int, e: int):
        if (s, e) not in boxes:
            boxes[s, e] = x[s:e].min(axis=0), x[s:e].max(axis=0)
        return boxes[s, e]

    def go(s: int, e: int, p: int, q: int) -> None:
        if s == e or p == q or apart(*box(s, e), *box(p, q)) > limit:
            return
        if e - s <= LEAF and q - p <= LEAF:
            hit = x[s:e] @ x[p:q].T >= cosine
            if s == p:
                np.fill_diagonal(hit, False)
            if hit.any():
                links.add(hit, s, p, s == p)
            return
        m, n = (s + e) // 2, (p + q) // 2
        if (s, e) == (p, q):
            go(s, m, s, m)
            go(s, m, m, e)
            go(m, e, m, e)
        elif e - s >= q - p:
            go(s, m, p, q)
            go(m, e, p, q)
        else:
            go(s, e, p, n)
            go(s, e, n, q)

    if split == len(x):
        go(0, split, 0, split)
    else:
        go(0, split, split, len(x))


def blocks_in_order(vectors: DataFrame, width: int, cosine: float) -> DataFrame:
    """(part, nth, n, weights, ids, x, lo, hi) of each block of the epsilon grid order."""
    import pyarrow as pa

    axes = _moments(vectors, width)
    side = math.sqrt(2 - 2 * cosine)
    leading = min(LEADING, width)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            if not len(batch):
                continue
            turned = _unit_rows(batch.column("v"), width) @ axes
            cell = np.floor(turned[:, :leading] / side).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    batch.column("weight"),
                    *(pa.array(cell[:, k]) for k in range(leading)),
                    pa.array(turned[:, 0]),
                    pa.array([r.tobytes() for r in turned], pa.binary()),
                ],
                names=["node", "weight", *(f"c{k}" for k in range(leading)), "first", "turned"],
            )

    grid = [f"c{k}" for k in range(leading)]
    placed = vectors.select("node", "weight", "v").mapInArrow(
        cells,
        f"node string, weight long, {', '.join(f'{c} int' for c in grid)}, first double, turned binary",
    )
    order = [*grid, "first", "node"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        held: list = []

        def block(rows: list) -> pa.RecordBatch:
            turned = np.frombuffer(b"".join(r[2] for r in rows)).reshape(-1, width)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "nth": pa.array([nth], pa.int32()),
                    "nodes": [[r[0] for r in rows]],
                    "weights": [np.array([r[1] for r in rows], np.int64).tobytes()],
                    "turned": [turned.tobytes()],
                    "lo": [turned.min(axis=0).tolist()],
                    "hi": [turned.max(axis=0).tolist()],
                }
            )

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("node", "weight", "turned")))
            while len(held) >= BLOCK:
                yield block(held[:BLOCK])
                held, nth = held[BLOCK:], nth + 1
        if held:
            yield block(held)

    schema = (
        "part int, nth int, nodes array<string>, weights binary, turned binary, "
        "lo array<double>, hi array<double>"
    )
    return placed.select("node", "weight", "turned").mapInArrow(pack, schema)


def near_blocks(blocks: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b, whose boxes are within epsilon, found down a tree of intervals.

    The tree's leaves are the blocks; each level joins the children of a pair of parents on the
    parents, so work follows the pairs that are near, not the square of the blocks.
    """
    limit = 2 - 2 * cosine + SLACK
    leaves = cut(
        blocks.select(F.struct("part", "nth").alias("name"), "part", "nth", "lo", "hi"), "block-boxes"
    )
    # number the blocks by their place: (part, nth) orders them, and the parts are few
    before = leaves.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each task
    starts, total = {}, 0
    for r in before:
        starts[r["part"]] = total
        total += r["n"]
    begin = F.lit(0).cast("long")
    if starts:
        begin = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("part"))
    level = leaves.select("part", "nth", (begin + F.col("nth")).cast("long").alias("k"), "lo", "hi")
    names = level.select("k", "part", "nth")
    levels = [level.select("k", "lo", "hi")]
    while total > 1:
        total = -(-total // FAN)
        dims = levels[-1].select(F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "x"), F.expr(f"k div {FAN}").alias("k"))
        box = dims.groupBy("k", "d").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
        rows = F.array_sort(F.collect_list(F.struct("d", "lo", "hi")))  # a row for each axis
        box = box.groupBy("k").agg(rows.alias("r")).select(
            "k", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")
        )
        levels.append(cut(box, "interval-boxes"))
    top = levels.pop()
    pairs = top.select(F.col("k").alias("a"), F.col("k").alias("b"))
    gap = F.zip_with(
        F.zip_with("lo_a", "hi_b", lambda x, y: x - y),
        F.zip_with("lo_b", "hi_a", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    squared = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    while levels:
        below = levels.pop()
        side = lambda n: below.select(  # noqa: E731, B023
            F.expr(f"k div {FAN}").alias(n), F.col("k").alias(f"k_{n}"),
            F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter("k_a <= k_b").filter(squared <= limit)
        pairs = pairs.select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))
    name = lambda n: names.select(F.col("k").alias(n), F.struct("part", "nth").alias(f"name_{n}"))
    return pairs.join(name("a"), "a").join(name("b"), "b").select("name_a", "name_b")


def join_blocks(pairs: DataFrame, blocks: DataFrame, width: int, cosine: float) -> DataFrame:
    """(node, links, other): a vector's links within a pair of blocks, by weight; and the forest's links."""
    import pyarrow as pa

    side = lambda n: blocks.select(
        F.struct("part", "nth").alias(f"name_{n}"),
        *(F.col(c).alias(f"{c}_{n}") for c in ("nodes", "weights", "turned")),
    )
    dealt = pairs.join(side("a"), "name_a").join(side("b"), "name_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for r in range(len(batch)):
                sides = "a" if batch.column("name_a")[r] == batch.column("name_b")[r] else "ab"
                read = lambda c, n, kind: np.frombuffer(batch.column(f"{c}_{n}")[r].as_buffer(), kind)  # noqa: E731, B023
                x = [read("turned", n, float).reshape(-1, width) for n in sides]
                links = Links(np.concatenate([read("weights", n, np.int64) for n in sides]))
                join_intervals(np.concatenate(x), len(x[0]), cosine, links)
                names = np.array([v for n in sides for v in batch.column(f"nodes_{n}")[r].as_py()], object)
                hit = np.flatnonzero(links.count)
                u = np.concatenate([[], *(f[0] for f in links.forest)]).astype(np.int64)
                v = np.concatenate([[], *(f[1] for f in links.forest)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([names[hit], names[u]]), pa.string()),
                        pa.array(np.concatenate([links.count[hit].astype(np.int64), np.zeros(len(u), np.int64)])),
                        pa.array([None] * len(hit) + names[v].tolist(), pa.string()),
                    ],
                    names=["node", "links", "other"],
                )

    return dealt.mapInArrow(run, "node string, links long, other string")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id (least vec_id reachable) and kept of every vector."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select("vec_id", v.alias("v")).withColumn(
        "v", F.when(sound & F.exists("v", lambda x: x != 0), F.col("v"))
    )
    lengths = rows.filter("v is not null").groupBy(F.size("v").alias("n")).count()
    usual = lengths.orderBy(F.desc("count"), "n").first()  # a row for each length that occurs
    width = usual["n"] if usual else 1
    # equal vectors have one name: two 64-bit hashes
    name = F.concat_ws("-", F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.reverse("v"))))
    rows = rows.withColumn("node", F.when(F.size("v") == width, name))
    vectors = cut(
        rows.filter("node is not null")
        .groupBy("node")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("rep"), F.any_value("v").alias("v")),
        "vectors",
    )
    blocks = cut(blocks_in_order(vectors, width, cosine), "blocks")
    joined = cut(join_blocks(near_blocks(blocks, cosine), blocks, width, cosine), "joined")
    links = joined.groupBy("node").agg(F.sum("links").alias("links"))
    forest = joined.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v"))
    reached = connected_components(forest)
    named = (
        vectors.select("node", "weight", "rep")
        .join(reached, "node", "left")
        .join(links, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("node", "weight", "links", "component_id")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "node").join(named, "node", "left").select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
