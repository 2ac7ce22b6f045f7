"""Locality, recall, block diameter and stability of an order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.ranking import order_statistics
from lodestone.functions.store import cut
from lodestone.operators.neighbours import nearest


def distance(a: str, b: str) -> Column:
    """Distance of two points given as struct columns or aliases."""
    return F.sqrt(sum((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in ("x", "y", "z")))


def edges(ordered: DataFrame) -> DataFrame:
    """Each rank but the first with its point, the one before, their keys and distance.

    A self-join on rank + 1: distributed by rank, where an unpartitioned ``lag`` would take one task.
    """
    now, last = ordered.alias("b"), ordered.alias("a")
    joined = last.join(now, F.col("a.rank") + 1 == F.col("b.rank"))
    return joined.select(
        F.col("b.rank").alias("rank"),
        F.col("a.key").alias("key_before"),
        F.col("b.key").alias("key"),
        distance("a", "b").alias("d"),
    )


def miad(ordered: DataFrame) -> DataFrame:
    """Mean distance of neighbours along the path; 0 for fewer than two points."""
    return edges(ordered).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("miad"), F.count("*").alias("edges"))


def normalized_miad(ordered: DataFrame) -> DataFrame:
    spans = [F.max(a) - F.min(a) for a in ("x", "y", "z")]
    diagonal = ordered.agg(F.sqrt(sum(s * s for s in spans)).alias("diagonal"))
    return miad(ordered).join(F.broadcast(diagonal)).select(  # one row each
        F.when(F.col("diagonal") > 0, F.col("miad") / F.col("diagonal")).otherwise(0.0).alias("normalized_miad")
    )


def same_key_split(ordered: DataFrame) -> DataFrame:
    """Path length within and across keys, the share of edges within one, and the largest group of a key."""
    same = F.col("key") == F.col("key_before")
    split = edges(ordered).agg(
        F.sum(F.when(same, F.col("d")).otherwise(0.0)).alias("within"),
        F.sum(F.when(~same, F.col("d")).otherwise(0.0)).alias("across"),
        F.avg(same.cast("double")).alias("same_key_share"),
    )
    top = ordered.groupBy("key").count().agg(F.max("count").alias("largest_group"))
    return split.join(F.broadcast(top))  # one row each


def block_diameter(ordered: DataFrame, block: int = 32) -> DataFrame:
    """Mean and 95th percentile (nearest rank) of the diameters of blocks of ranks; single points are skipped."""
    if block < 2:
        raise ValueError("a block has two points at least")
    widths = cut(block_widths(ordered, block), "widths")
    mean, n = widths.agg(F.avg("d"), F.count("*")).first()
    p95 = order_statistics(widths, [(F.col("d"), max(math.ceil(0.95 * n) - 1, 0))])[0] if n else None
    kind = "mean_diameter double, p95_diameter double, blocks long"
    return ordered.sparkSession.createDataFrame([(mean, p95, n)], kind)


def block_widths(ordered: DataFrame, block: int) -> DataFrame:
    """(block, d): the diameter of each block of ranks with two points or more.

    Runs of whole blocks are dealt to tasks, which meet each point with the next ones of its block, many blocks at a time.
    """
    import pyarrow as pa

    def widths(rank: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        of = rank // block
        most = np.full(len(of), -1.0)
        for step in range(1, len(of)):
            same = of[step:] == of[:-step]
            if not same.any():
                break
            d = points[step:] - points[:-step]
            square = d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2
            pair = same & (rank[step:] != rank[:-step])
            np.maximum(most[:-step], np.where(pair, square, -1.0), out=most[:-step])
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        most = np.maximum.reduceat(most, starts) if len(of) else most
        some = most >= 0
        return pa.RecordBatch.from_arrays([pa.array(of[starts][some]), pa.array(np.sqrt(most[some]))], names=["block", "d"])

    def run(batches):
        rank, points = np.empty(0, np.int64), np.empty((0, 3))
        for batch in batches:
            rank = np.concatenate([rank, batch.column("rank").to_numpy()])
            points = np.concatenate([points, np.column_stack([batch.column(c).to_numpy() for c in ("x", "y", "z")])])
            whole = np.searchsorted(rank, rank[-1] // block * block) if len(rank) else 0  # the last block may go on
            yield widths(rank[:whole], points[:whole])
            rank, points = rank[whole:], points[whole:]
        yield widths(rank, points)

    dealt = ordered.select("rank", "x", "y", "z").repartition(F.expr(f"rank div {block * 1024}")).sortWithinPartitions("rank")
    return dealt.mapInArrow(run, "block long, d double")


def l1_l2_locality(ordered: DataFrame, ceiling: float = float("inf"), gaps: int = 64) -> DataFrame:
    """Greatest and least d^3 / gap over all pairs of ranks; null for fewer than two points.

    Exact for a cloud of any size, without forming all pairs: see :func:`_greatest_ratio` and :func:`_least_ratio`.
    """
    spark = ordered.sparkSession
    ordered = cut(ordered.select("rank", "x", "y", "z"), "path")
    spans = [F.max(c) - F.min(c) for c in ("x", "y", "z")]
    n, diagonal = ordered.agg(F.count("*"), F.sqrt(sum(s * s for s in spans))).first()
    if n < 2:
        return spark.createDataFrame([(None, None)], "l1 double, l2 double")
    steps = ordered.alias("a").join(ordered.alias("b"), F.col("a.rank") + 1 == F.col("b.rank")).select(distance("a", "b").alias("d"))
    cube = F.pow("d", F.lit(3.0))
    most, least, short = steps.agg(F.max(cube), F.min(cube), F.percentile_approx("d", 0.01)).first()
    return spark.createDataFrame([(_greatest_ratio(ordered, n, most), _least_ratio(ordered, n, least, short, diagonal))], "l1 double, l2 double")


def _ratio() -> Column:
    return F.pow(distance("a", "b"), F.lit(3.0)) / (F.col("b.rank") - F.col("a.rank"))


def _greatest_ratio(ordered: DataFrame, n: int, best: float) -> float:
    """The greatest ratio, at least ``best``: only blocks of ranks are paired that can hold a greater one.

    Blocks have sqrt(n) points, so there are n / 2 pairs of them.  A pair's boxes and the ranks between bound its ratio
    from above; the blocks' first points, exactly paired, bound the best from below.
    """
    size = max(math.isqrt(n), 16)
    block = F.expr(f"rank div {size}")
    boxes = ordered.groupBy(block.alias("block")).agg(
        *(f(c).alias(k + c) for c in ("x", "y", "z") for k, f in (("lo_", F.min), ("hi_", F.max))),
        F.min("rank").alias("from"), F.max("rank").alias("to"), F.min_by(F.struct("x", "y", "z"), "rank").alias("first"),
    )
    boxes = cut(boxes.select("*", F.col("from").alias("rank"), "first.*"), "boxes")
    pairs = boxes.alias("a").join(F.broadcast(boxes.alias("b")), F.col("a.block") <= F.col("b.block"))  # sqrt(n) boxes
    best = max(best, pairs.filter("a.block < b.block").agg(F.max(_ratio())).first()[0] or 0.0)
    wide = [F.greatest(F.col(f"b.hi_{c}") - F.col(f"a.lo_{c}"), F.col(f"a.hi_{c}") - F.col(f"b.lo_{c}")) for c in ("x", "y", "z")]
    bound = F.pow(F.sqrt(sum(w * w for w in wide)), F.lit(3.0)) / F.greatest(F.col("b.from") - F.col("a.to"), F.lit(1))
    able = pairs.filter(bound * (1 + 1e-9) >= best).select(F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    points = ordered.withColumn("block", block)
    found = able.join(points.alias("a"), F.col("i") == F.col("a.block")).join(points.alias("b"), F.col("j") == F.col("b.block"))
    found = found.filter(F.col("a.rank") < F.col("b.rank"))
    return max(best, found.agg(F.max(_ratio())).first()[0] or 0.0)


def _least_ratio(ordered: DataFrame, n: int, best: float, reach: float, diagonal: float) -> float:
    """The least ratio, at most ``best``: a gap is below n, so no pair farther apart than (best (n - 1))^(1/3) has a lesser one.

    Pairs within ``reach`` are met by cells of that side; it doubles until it is as far as the best found asks for.
    """
    while best:
        asked = (best * (n - 1)) ** (1 / 3) * (1 + 1e-9)
        side = max(min(reach, asked), diagonal * 1e-15)
        cell = [F.floor(F.col(c) / side) for c in ("x", "y", "z")]
        rows = ordered.select("rank", "x", "y", "z", *(c.alias(f"c{k}") for k, c in enumerate(cell)))
        around = rows
        for k in range(3):
            around = around.withColumn(f"c{k}", F.explode(F.sequence(F.col(f"c{k}") - 1, F.col(f"c{k}") + 1)))
        on = [F.col(f"a.c{k}") == F.col(f"b.c{k}") for k in range(3)]
        pairs = around.alias("a").join(rows.alias("b"), [*on, F.col("a.rank") < F.col("b.rank")])
        least = pairs.agg(F.min(_ratio())).first()[0]
        best = best if least is None else min(best, least)
        if side >= asked:
            break
        reach = 2 * side
    return best


def l1_by_bands(ordered: DataFrame, first: int = 64) -> float:
    """The greatest ratio for a cloud of any size: bands of rank gaps until no larger gap can win."""
    ordered = ordered.select("rank", "x", "y", "z").persist()
    spans = [F.max(a) - F.min(a) for a in ("x", "y", "z")]
    n, diagonal = ordered.agg(F.count("*"), F.sqrt(sum(s * s for s in spans))).first()
    best, lo = 0.0, 1
    while n and lo < n and diagonal**3 / lo > best:
        hi = min(lo + first, n)
        shifted = ordered.select("x", "y", "z", F.explode(F.sequence(F.col("rank") + lo, F.col("rank") + hi - 1)).alias("to"),
                                 F.col("rank").alias("from"))
        pairs = shifted.alias("a").join(ordered.alias("b"), F.col("a.to") == F.col("b.rank"))
        ratio = F.pow(distance("a", "b"), F.lit(3.0)) / (F.col("a.to") - F.col("a.from"))
        best = max(best, pairs.agg(F.max(ratio)).first()[0] or 0.0)
        lo = hi
    ordered.unpersist()
    return best


def recall_in_window(ordered: DataFrame, k: int = 8, window: int = 64) -> DataFrame:
    """Mean share of a point's k nearest that lie within ``window`` / 2 ranks of it; 1 for a single point."""
    ranks = ordered.select("raw_index", "rank")
    n = ordered.count()
    each = min(k, n - 1)
    if each < 1:
        return ordered.sparkSession.createDataFrame([(1.0,)], "recall double")
    found = (
        nearest(ordered, k)
        .join(ranks, "raw_index")
        .join(ranks.toDF("neighbour", "other"), "neighbour")
        .filter(F.abs(F.col("rank") - F.col("other")) <= window // 2)
    )
    return found.agg((F.count("*") / F.lit(float(n * each))).alias("recall"))


def kendall_tau(a: DataFrame, b: DataFrame, clean: int) -> DataFrame:
    """Concordant and discordant pairs and tau of two orders over the points below ``clean``; null for fewer than two points.

    Pairs are counted by :func:`kendall_tau_big`, which forms none.
    """
    up, down = kendall_tau_big(a, b, clean)
    tau = (up - down) / (up + down) if up + down else None
    return a.sparkSession.createDataFrame([(up, down, tau)], "concordant long, discordant long, tau double")


def inversions(q: np.ndarray) -> int:
    """Pairs out of order, by merging sorted runs of doubling length."""
    n = len(q)
    if n < 2:
        return 0
    q = np.unique(q, return_inverse=True)[1].astype(np.int64)  # equal values are in order
    total, width, place = 0, 1, np.arange(n)
    while width < n:
        # sort each pair of runs at once: an element of the right run passes the greater ones of the left
        order = np.lexsort((place % (2 * width) >= width, q, place // (2 * width)))
        is_left = order % (2 * width) < width
        block = order // (2 * width)
        lefts = np.cumsum(is_left)
        upto = np.concatenate([[0], lefts])[np.searchsorted(block, block, side="left")]  # lefts of earlier blocks
        held = np.bincount(block[is_left], minlength=block[-1] + 1)[block]
        total += int((held - (lefts - upto))[~is_left].sum())
        q, width = q[order], 2 * width
    return total


#: Second ranks are told apart by so many bits in a round.
DIGIT = 6


def kendall_tau_big(a: DataFrame, b: DataFrame, clean: int, parts: int | None = None) -> tuple[int, int]:
    """(concordant, discordant) for orders of any size, by merging in rounds.

    A round sorts rows by the leading bits of the second rank and, within them, by the first rank.  A task counts the
    inversions of the runs of equal leading bits in its part.  Only the first and the last run of a part can go on in
    another one: between such runs the counts of the next bits tell the inversions, and pairs that these bits do not
    part are left to the next round, which holds no other rows.  Tasks stay as large as parts are; the driver holds two rows a part.
    """
    import pyarrow as pa

    both = (
        a.select("raw_index", F.col("rank").alias("p"))
        .join(b.select("raw_index", F.col("rank").alias("q")), "raw_index")
        .filter(F.col("raw_index") < clean)
    )
    left = cut(both.select("p", "q"), "rank-pairs")
    n, top = left.agg(F.count("*"), F.coalesce(F.max("q"), F.lit(0))).first()
    shift, down = int(top).bit_length(), 0
    kind = "part int, prefix long, place int, whole long, apart long, counts array<long>"

    def runs(lower: int, upper: int):
        def count(batches):
            from pyspark import TaskContext

            got = [batch for batch in batches if len(batch)]
            if not got:
                return
            table = pa.Table.from_batches(got)
            q = table.column("q").to_numpy()
            edges = np.flatnonzero(np.diff(q >> upper, prepend=-1, append=-1))
            inner, shared = 0, []
            for k, (x, y) in enumerate(zip(edges[:-1], edges[1:])):
                run = q[x:y]
                if 0 < k < len(edges) - 2:
                    inner += inversions(run)
                    continue
                digit = (run >> lower) & ((1 << (upper - lower)) - 1)
                shared.append((int(run[0] >> upper), k, inversions(run), inversions(digit), np.bincount(digit, minlength=1 << (upper - lower)).tolist()))
            shared.append((-1, -1, inner, 0, []))
            part = TaskContext.get().partitionId()
            columns = [[part] * len(shared), *zip(*shared)]
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[x.split()[0] for x in kind.split(", ")])

        return count

    while shift:
        lower, upper = max(shift - DIGIT, 0), shift
        prefix = F.shiftright("q", upper)
        dealt = left.repartitionByRange(prefix, "p") if parts is None else left.repartitionByRange(parts, prefix, "p")
        dealt = dealt.sortWithinPartitions(prefix, "p")
        by_prefix: dict[int, list] = {}
        for r in sorted(dealt.mapInArrow(runs(lower, upper), kind).collect(), key=lambda r: (r["part"], r["place"])):
            if r["place"] < 0:
                down += r["whole"]
            else:
                by_prefix.setdefault(r["prefix"], []).append(r)
        again = []
        for value, found in by_prefix.items():
            if len(found) == 1:
                down += found[0]["whole"]
                continue
            again.append(value)
            seen = np.zeros(1 << (upper - lower), np.int64)
            for r in found:
                counts = np.array(r["counts"], np.int64)
                greater = np.cumsum(seen[::-1])[::-1] - seen  # earlier rows of a greater digit
                down += r["apart"] + int((greater * counts).sum())
                seen += counts
        if not again:
            break
        left = cut(left.filter(F.shiftright("q", upper).isin(again)), "rank-pairs")  # two for each part at most
        shift = lower
    return n * (n - 1) // 2 - down, down


def frame_angle(a: np.ndarray, b: np.ndarray) -> float:
    """Greatest angle between the matching axes of two frames, whatever their signs."""
    return float(np.arccos(np.clip(np.abs((a * b).sum(axis=0)), -1, 1)).max())


def duplicate_mass(keyed: DataFrame, *by: str) -> DataFrame:
    """Rows in groups of more than one, every member counted."""
    groups = keyed.groupBy(*by).count()
    return groups.agg(
        F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("duplicated"),
        F.max("count").alias("largest_group"),
        F.count("*").alias("groups"),
    )


def permutation_check(ordered: DataFrame, n: int) -> DataFrame:
    return ordered.agg(
        F.count("*").alias("rows"),
        F.countDistinct("raw_index").alias("distinct_rows"),
        F.min("raw_index").alias("least"),
        F.max("raw_index").alias("greatest"),
    ).withColumn("valid", F.expr(f"rows = {n} and distinct_rows = {n} and least = 0 and greatest = {n - 1}"))


def checked_miad(ordered: DataFrame, n: int) -> DataFrame:
    """:func:`miad` of an order that must name each of n points once, in ranks 0 to n - 1; 0 if it does not."""
    ranks = ordered.agg(
        (F.countDistinct("rank") == n).alias("_all"), (F.coalesce(F.min("rank"), F.lit(0)) == 0).alias("_from"),
        (F.coalesce(F.max("rank"), F.lit(n - 1)) == n - 1).alias("_to"),
    )
    sound = permutation_check(ordered, n).select("valid").join(F.broadcast(ranks))  # one row each
    sound = sound.select(((F.col("valid") | F.lit(n == 0)) & F.col("_all") & F.col("_from") & F.col("_to")).alias("valid"))
    found = miad(ordered).join(F.broadcast(sound))
    return found.select(F.when(F.col("valid"), F.col("miad")).otherwise(0.0).alias("miad"), F.coalesce("valid", F.lit(False)).alias("valid"))


def order_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ranks at which two orders name different points, or only one has a point."""
    joined = a.select("rank", F.col("raw_index").alias("left_index")).join(
        b.select("rank", F.col("raw_index").alias("right_index")), "rank", "full_outer"
    )
    return joined.filter(~F.col("left_index").eqNullSafe(F.col("right_index")))
