"""Paired statistics of measured cases: contrasts, tests, intervals, effect sizes and selections."""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ranking import rank_runs, with_row_number
from lodestone.functions.store import cut
from lodestone.operators import linalg


def paired_contrast(rows: DataFrame, arm: str, base: str, target: str, keys: list[str], metric: str) -> DataFrame:
    """``metric`` of arm ``target`` less that of arm ``base`` on each key that has both."""
    a = rows.filter(F.col(arm) == target).select(*keys, F.col(metric).alias("a"))
    b = rows.filter(F.col(arm) == base).select(*keys, F.col(metric).alias("b"))
    return a.join(b, keys).select(*keys, (F.col("a") - F.col("b")).alias("delta"))


def holm(p_values: DataFrame, family: list[str]) -> DataFrame:
    """Step-down adjusted p within each family: the running maximum of (m - r) p, at most 1."""
    order = Window.partitionBy(*family).orderBy("p", "name")
    m = F.count("*").over(Window.partitionBy(*family))
    raised = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col("p"))
    return p_values.withColumn("_raised", raised).withColumn(
        "p_holm", F.max("_raised").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_raised")


def cliffs_delta(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(more - fewer) / pairs over all pairs, from running counts of b: no pair is formed."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("is_a")).union(b.select(value, F.lit(0)))
    by = both.groupBy("v").agg(F.sum("is_a").alias("na"), F.sum(1 - F.col("is_a")).alias("nb"))
    below = F.sum("nb").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    total = Window.partitionBy()
    rows = by.select("na", "nb", F.coalesce(below, F.lit(0)).alias("below"), F.sum("nb").over(total).alias("all_b"))
    return rows.agg(
        (
            F.sum(F.col("na") * (F.col("below") - (F.col("all_b") - F.col("below") - F.col("nb"))))
            / (F.sum("na") * F.sum("nb"))
        ).alias("delta")
    )


def sign_counts(contrasts: DataFrame, by: list[str]) -> DataFrame:
    d = F.col("delta")
    return contrasts.groupBy(*by).agg(
        F.count_if(d > 0).alias("above"),
        F.count_if(d < 0).alias("below"),
        F.count_if(d == 0).alias("ties"),
        F.avg(F.signum(d)).alias("paired_delta"),
    )


def sign_test(wins: int, losses: int) -> float:
    """One-sided binomial p of at least so many wins, ties dropped."""
    n = wins + losses
    return sum(math.comb(n, k) for k in range(wins, n + 1)) / 2**n if n else 1.0


def signed_rank_p(blocks: list[list[tuple[str, float]]], draws: int = 20_000, seed: int = 20260513) -> float:
    """One-sided p of so low a signed-rank sum when whole blocks change sign; exact up to 20 blocks.

    A block lists (stratum, difference); ranks are mid-ranks of the magnitudes within a stratum.
    """
    flat = [(s, d, k) for k, b in enumerate(blocks) for s, d in b if d != 0]
    ranks = np.zeros(len(flat))
    for s in {f[0] for f in flat}:
        at = [i for i, f in enumerate(flat) if f[0] == s]
        v = np.abs([flat[i][1] for i in at])
        _, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
        ranks[at] = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    sums = np.zeros(len(blocks))
    for r, (_, d, k) in zip(ranks, flat):
        sums[k] += math.copysign(r, d)
    observed = sums.sum()
    if len(blocks) <= 20:
        signs = 1 - 2 * ((np.arange(2 ** len(blocks))[:, None] >> np.arange(len(blocks))) & 1)
        return float((signs @ sums <= observed + 1e-12).mean())
    signs = np.random.default_rng(seed).choice([-1, 1], size=(draws, len(blocks)))
    return float(((signs @ sums <= observed + 1e-12).sum() + 1) / (draws + 1))


def median_bootstrap(strata: dict[str, list[float]], draws: int = 20_000, seed: int = 20260513) -> tuple:
    """Median of all values and its percentile interval, resampled within strata."""
    draw = random.Random(seed)
    values = [v for k in sorted(strata) for v in strata[k]]
    medians = sorted(
        float(np.median([x for k in sorted(strata) for x in draw.choices(strata[k], k=len(strata[k]))]))
        for _ in range(draws)
    )
    return float(np.median(values)), medians[int(0.025 * draws)], medians[min(draws - 1, int(0.975 * draws))]


def drawn(seed: int, *names: Column | str) -> Column:
    """A number of 32 bits that follows from the seed and the names alone, in whatever task it is drawn."""
    said = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(n).cast("string") if isinstance(n, str) else n for n in names)))
    return F.conv(F.substring(said, 1, 8), 16, 10).cast("long")


#: Placed rows that are broadcast to the draws; more of them meet the draws by a shuffle.
TABLED = 1 << 20


def resampled(
    rows: DataFrame, strata: list[str], order: str, value: str, draws: int = 2000, seed: int = 1, reach: int = 4
) -> DataFrame:
    """(draw, mean, median) of ``draws`` resamples with replacement within strata, each as large as the rows.

    Draws are counter-based, so they are dealt over tasks and come out the same however they are dealt.
    """
    return _resamples(_placed(rows, strata, order, value), strata, draws, seed, reach)


def _placed(rows: DataFrame, strata: list[str], order: str, value: str) -> DataFrame:
    """The rows' strata and value ``_v``, with the place ``_p`` of the value among all (nulls last) and ``_g`` by stratum and order."""
    some = cut(rows.select(*strata, F.col(order).alias("_order"), F.col(value).cast("double").alias("_v")), "resampled")
    by_value = with_row_number(some, [F.col("_v").asc_nulls_last(), *strata, "_order"], "_p")
    return with_row_number(by_value, [*strata, "_order"], "_g").drop("_order")


def _resamples(placed: DataFrame, strata: list[str], draws: int, seed: int, reach: int) -> DataFrame:
    """Resamples of placed rows.

    A draw's median lies near the middle of all values: about ``reach`` times the root of their number to either side of it,
    drawn places are counted one by one, farther ones by side only.  Draws whose median lies farther out are counted again
    over a wider band, so a task holds few counts for a draw and each median is exact.
    """
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, values = placed.agg(F.count("*"), F.count("_v")).first()
    sizes = placed.groupBy(*strata).agg(F.min("_g").alias("_from"), F.count("*").alias("_n"))
    within = placed.join(sizes, strata) if strata else placed.crossJoin(sizes)
    within = within.select(*strata, (F.col("_g") - F.col("_from")).alias("_i"), "_n", "_p", "_v")
    dealt = within.select(*strata, "_i", "_n").repartition(parts)
    table = within.drop("_n") if n > TABLED else F.broadcast(within.drop("_n"))
    numbers, wide, out = F.sequence(F.lit(0), F.lit(draws - 1)), reach * math.isqrt(values) + 1, []
    while True:
        low, high = values // 2 - wide, values // 2 + wide
        asked = dealt.select(*strata, "_i", "_n", F.explode(numbers).alias("draw"))
        asked = asked.select("draw", *strata, (drawn(seed, "draw", *strata, "_i") % F.col("_n")).alias("_i"))
        side = F.greatest(F.least("_p", F.lit(high + 1)), F.lit(low - 1)).alias("_b")
        counts = asked.join(table, [*strata, "_i"]).groupBy("draw", side).agg(
            F.count("_v").alias("_c"), F.sum("_v").alias("_s"), F.max("_v").alias("_v")
        )
        out_of = lambda there: F.sum(F.when(there, F.col("_c")).otherwise(0))
        farther = F.greatest(out_of(F.col("_b") < low), out_of(F.col("_b") > high))
        got = cut(
            counts.groupBy("draw").agg(
                F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean"),
                F.percentile("_v", 0.5, F.col("_c")).alias("median"),
                ((farther * 2 < F.sum("_c")) | (F.sum("_c") == 0)).alias("_met"),
            ),
            "resamples",
        )
        out.append(got.filter("_met").drop("_met"))
        left = [r["draw"] for r in got.filter("not _met").select("draw").collect()]
        if not left:
            return reduce(DataFrame.union, out)
        numbers, wide = F.array(*(F.lit(k) for k in left)), wide * 8


def resampled_interval(rows: DataFrame, strata: list[str], order: str, value: str, draws: int = 2000, seed: int = 1) -> DataFrame:
    """Mean and median of all rows with their percentile intervals over stratified resamples: one row."""
    placed = _placed(rows, strata, order, value)
    got = _resamples(placed, strata, draws, seed, 4)
    at = lambda c, share: F.get(F.array_sort(F.collect_list(c)), F.lit(min(draws - 1, int(share * draws))))
    ends = got.agg(*(at(c, share).alias(f"{c}_{k}") for c in ("mean", "median") for k, share in (("low", 0.025), ("high", 0.975))))
    values = placed.agg(F.count("_v")).first()[0]
    # the median of all is the mean of the values at the middle places, one or two
    lo, hi = (F.max(F.when(F.col("_p") == k, F.col("_v"))) for k in ((values - 1) // 2, values // 2))
    whole = placed.agg(
        F.avg("_v").alias("mean"), F.when(lo == hi, lo).otherwise(lo / 2 + hi / 2).alias("median"), F.count("*").alias("n")
    )
    return whole.join(F.broadcast(ends))  # one row each


def flipped_share(sums: DataFrame, value: str) -> DataFrame:
    """One-sided p of so low a total of block sums when blocks change sign: all 2^n flips, dealt over tasks in ranges.

    The sums of at most 30 blocks come to the driver and stand in the plan.
    """
    blocks = [float(r[0]) for r in sums.select(value).orderBy(value).limit(31).collect()]
    if len(blocks) > 30:
        raise ValueError("more than 30 blocks: draw flips instead")
    flips = sums.sparkSession.range(1 << len(blocks))
    sign = lambda k: 1 - 2 * F.shiftright("id", k).bitwiseAND(F.lit(1))
    total = sum((sign(k) * b for k, b in enumerate(blocks)), F.lit(0.0))
    lower = F.count_if(total <= sum(blocks) + 1e-9)
    return flips.agg(F.lit(len(blocks)).cast("long").alias("blocks"), lower.alias("lower"), (lower / F.count("*")).alias("p"))


def signed_rank_sums(rows: DataFrame, stratum: list[str], block: list[str], value: str) -> DataFrame:
    """By block the sum of signed mid-ranks of the magnitudes within a stratum; zeros are dropped.

    Mid-ranks come from counts of equal magnitudes, so ties need no look at each other.  The rows are written once: the
    counts meet them by magnitude, and sums that are added up again may differ in their last bit.
    """
    some = cut(rows.filter(F.col(value) != 0).withColumn("_m", F.abs(value)), "magnitudes")
    counts = some.groupBy(*stratum, "_m").agg(F.count("*").alias("_c"))
    below = F.sum("_c").over(Window.partitionBy(*stratum).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.select(*stratum, "_m", (F.coalesce(below, F.lit(0)) + (F.col("_c") + 1) / 2).alias("_r"))
    return some.join(ranks, [*stratum, "_m"]).groupBy(*block).agg(F.sum(F.signum(value) * F.col("_r")).alias("signed"))


#: Values that a resampling task draws at once.
AT_ONCE = 4_000_000


def bootstrap_by_group(rows: DataFrame, group: str, value: str, draws: int = 2000, seed: int = 1) -> DataFrame:
    """Median and percentile interval of each group, a task for each.

    A task holds its group's values and ``AT_ONCE`` drawn ones: resamples follow each other in one stream of draws, so
    they come out as if they were drawn together.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf[value].to_numpy(float))
        rng = np.random.default_rng(seed)
        each = max(AT_ONCE // len(v), 1)
        sizes = [min(each, draws - k) for k in range(0, draws, each)]
        medians = np.sort(np.concatenate([np.median(rng.choice(v, size=(m, len(v))), axis=1) for m in sizes]))
        return pd.DataFrame(
            {
                group: [pdf[group].iloc[0]], "n": [len(v)], "median": [float(np.median(v))],
                "low": [medians[int(0.025 * draws)]], "high": [medians[min(draws - 1, int(0.975 * draws))]],
            }
        )

    kind = dict(rows.dtypes)[group]
    schema = f"{group} {kind}, n long, median double, low double, high double"
    return rows.select(group, value).groupBy(group).applyInPandas(one, schema)


#: Groups whose percentiles are selected by rounds of counts; more groups are gathered one by one.
SELECTED = 64


def percentiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50, p95 and p99 by linear interpolation.

    Few groups may be huge: theirs come from radix selection, whose rounds send counts only.  With more than ``SELECTED``
    groups each is gathered, as counts of its distinct values.
    """
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    clean = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    groups = rows.groupBy(*by).agg(F.count(value).alias("_n"), F.count_if(clean).alias("_clean")).limit(SELECTED + 1).collect()
    if len(groups) > SELECTED or any(g["_n"] != g["_clean"] for g in groups):  # values that are not finite have no rounds
        return rows.groupBy(*by).agg(*(F.percentile(value, p).alias(c) for c, p in shares.items()))
    places = lambda n: [math.floor(p * (n - 1)) + k for p in shares.values() for k in (0, 1)]
    wanted = []
    for g in groups:
        if g["_n"]:
            inside = [F.col(c).eqNullSafe(F.lit(g[c])) for c in by]
            # what is not of the group becomes a NaN, which stands after all values
            wanted.append((F.when(reduce(lambda a, b: a & b, inside), F.col(value)), *(min(k, g["_n"] - 1) for k in places(g["_n"]))))
    found = iter(rank_runs(rows, wanted))
    out = []
    for g in groups:
        ends = next(found) if g["_n"] else ()
        parts = [p * (g["_n"] - 1) % 1 for p in shares.values()]
        out.append((*(g[c] for c in by), *(lo + (hi - lo) * part for lo, hi, part in zip(ends[::2], ends[1::2], parts))) if ends else (*(g[c] for c in by), None, None, None))
    kinds = dict(rows.dtypes)
    return rows.sparkSession.createDataFrame(out, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), *(f"{c} double" for c in shares)]))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    q = lambda p: F.percentile(value, p)
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), q(0.25).alias("q25"), q(0.5).alias("median"),
        q(0.75).alias("q75"), F.max(value).alias("high"),
    )


def student_quantile(freedom: int, share: float = 0.975) -> float:
    """Quantile above the middle of Student's t: the root of the F quantile with 1 and ``freedom`` degrees."""
    return math.sqrt(linalg.quantile(lambda x: linalg.f_cdf(x, 1, freedom), 2 * share - 1))


def mean_interval(rows: DataFrame, by: list[str], value: str, share: float = 0.975) -> DataFrame:
    """Mean with Student's t standard errors on either side, n - 1 degrees; no interval around a single value."""

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        return n.map({k: student_quantile(int(k) - 1, share) for k in n.unique() if k > 1}).astype(float)

    found = rows.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n")
    )
    reach = quantile("_n") * F.col("_sd") / F.sqrt(F.col("_n").cast("double"))
    return found.select(*by, "mean", (F.col("mean") - reach).alias("low"), (F.col("mean") + reach).alias("high"))


def leader(rows: DataFrame, by: list[str], arm: str, value: str) -> DataFrame:
    """The arm of least mean in each cell, ties by name."""
    means = rows.groupBy(*by, arm).agg(F.avg(value).alias("mean"))
    first = Window.partitionBy(*by).orderBy("mean", arm)
    return means.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")


def median_if_complete(value: str) -> Column:
    """The median, withheld where any repeat lacks the value."""
    return F.when(F.count(value) == F.count("*"), F.median(value))


def break_even(cost: Column, saving: Column) -> Column:
    """Queries after which a dearer preparation has paid; null where nothing is saved."""
    return F.when(saving > 0, F.greatest(cost, F.lit(0.0)) / saving)


def miss_rate(misses: Column, references: Column) -> Column:
    return F.try_divide(misses.cast("double"), references)


def cheapest_eligible(policies: DataFrame, grid: DataFrame) -> DataFrame:
    """For each scenario (tau_min, budget) the cheapest policy that meets both, ties by name."""
    fits = policies.join(F.broadcast(grid), (F.col("tau") >= F.col("tau_min")) & (F.col("cost") <= F.col("budget")))
    chosen = fits.groupBy("tau_min", "budget").agg(F.min(F.struct("cost", "policy")).alias("best"))
    return grid.join(chosen, ["tau_min", "budget"], "left").select(
        "tau_min", "budget", F.col("best.policy").alias("policy"), F.col("best.cost").alias("cost")
    )
