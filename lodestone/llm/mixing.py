"""Mixing sources to target weights as a time-varying curriculum (native: DataFrame functions only).

Every source has a weight schedule over training time t in [0, 1].  Its integral is the source's
share of the demand; inverting the cumulative demand turns a running count of a source's words into
a training position, and the documents are range-sorted by position.

Defined results
* null text: size 0, never taken; null source: a source of its own, last in the order;
* empty table: no rows; all sizes 0: targets 0 and nothing taken;
* ties and repeated rows: a row is named by a hash of its id, source and text, and rows alike by an occurrence
  number, so each row is placed, and reruns agree;
* other columns are passed on; names the operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import columns_of, cut, unique, words_in

#: Weight of the k-th source in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Multiplier of that weight at t = 0 and at t = 1, linear between; the share stays the weight's.
SCHEDULE = ((0.5, 1.5), (1.5, 0.5), (1.0, 1.0))
#: Running sums are taken within this many hash ranges of a source, then over the ranges.
RANGES = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes`` (source, source_size), a row per source, with slot and target added.

    Demand is ``share`` of all words and is dealt by weight; a source stops at ``cap`` times its
    size and its excess goes to the others by weight.  The level at which that ends is found by
    running sums over the sources in the order in which they reach their caps.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(named) - 1
    slot = (nth % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), slot + 1)
    everywhere = Window.partitionBy()
    filling = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = (F.lit(share) * F.col("_all") - F.coalesce(F.sum("_cap").over(filling), F.lit(0.0))) / (
        F.col("_weights") - F.coalesce(F.sum("_weight").over(filling), F.lit(0.0))
    )
    return (
        sizes.withColumn("slot", slot)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("_all", F.sum("source_size").over(everywhere))
        .withColumn("_weights", F.sum("_weight").over(everywhere))
        .withColumn("_level", level)
        # a source is full where the level left to it would lift it over its cap
        .withColumn("_open", F.col("_level") * F.col("_weight") < F.col("_cap"))
        # of the open ones the first holds: all before it are full, none after it is
        .withColumn("_turn", F.struct(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source"))
        .withColumn(
            "_final", F.min_by("_level", F.when(F.col("_open"), F.col("_turn"))).over(everywhere)
        )
        .withColumn(
            "target",
            F.least(F.col("_cap"), F.coalesce(F.col("_final") * F.col("_weight"), F.col("_cap"))),
        )
        .select("source", "source_size", "slot", "target")
    )


def training_position(part: Column, slot: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Invert the integrated schedule: the time t by which ``part`` of a source's demand has arisen.

    The integral of a + (b - a) t is a t + (b - a) t^2 / 2, and (a + b) / 2 in all.
    """
    pick = lambda k: F.element_at(F.array(*(F.lit(float(s[k])) for s in schedule)), slot + 1)
    a, b = pick(0), pick(1)
    whole = (a + b) / 2
    curved = (F.sqrt(F.greatest(a * a + F.lit(2.0) * (b - a) * whole * part, F.lit(0.0))) - a) / (b - a)
    return F.when(F.abs(b - a) < 1e-12, part).otherwise(curved)


def _row_name() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def _alike():
    return Window.partitionBy("_row").orderBy("doc_id", "source")


def plan_mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    schedule: Sequence[tuple[float, float]] = SCHEDULE,
    share: float = 1.5,
    cap: float = 2.0,
    ranges: int = RANGES,
) -> DataFrame:
    """One row per document: doc_id, _row, occurrence, size, source_size, target, taken, positions.

    ``positions`` holds a training position for each copy that the mix takes, so it is empty for a
    document left out.  A document is taken whole, as often as its middle lies before the target in
    the source's stream of epochs; so each source's total is off by half a document at most.
    """
    rows = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), _row_name().alias("_row"))
    # the text is read once: what follows works on these few columns
    rows = cut(rows, "mix-sizes")
    place = F.xxhash64(F.lit(11), "_row", "occurrence")
    rows = (
        rows.withColumn("occurrence", F.row_number().over(_alike()))
        .withColumn("_place", place)
        .withColumn("_range", F.pmod(F.shiftrightunsigned("_place", 20), F.lit(ranges)))
        .withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    )
    by_range = rows.groupBy("_source", "source", "_range").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select(
        "_source", "_range", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before")
    )
    sizes = by_range.groupBy("_source", "source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, cap).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_source"), "source_size", "slot", "target"
    )
    within = (
        Window.partitionBy("_source", "_range")
        .orderBy("_place", "_row", "occurrence")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    epochs = int(-(-cap // 1))
    middle = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2
    positions = F.filter(
        F.array(
            *(
                F.when(
                    (F.col("size") > 0) & (F.col("_middle") + k * F.col("source_size") < F.col("target")),
                    training_position(
                        (F.col("_middle") + k * F.col("source_size")) / F.col("target"), F.col("slot"), schedule
                    ),
                )
                for k in range(epochs)
            )
        ),
        lambda p: p.isNotNull(),
    )
    return (
        rows.join(starts, ["_source", "_range"])
        .withColumn("_middle", middle)
        .join(targets, "_source")
        .withColumn("positions", positions)
        .withColumn("taken", (F.col("size") * F.size("positions")).cast("long"))
        .select("doc_id", "_row", "occurrence", "size", "source_size", "target", "taken", "positions")
    )


def mix(docs: DataFrame, position: str = "training_position", **parameters) -> DataFrame:
    """The training order: a row per copy taken, range-sorted by the column ``position``.

    All columns of ``docs`` stay, but for one of that name; copies of a document differ in their position only.
    """
    row, occurrence, nth, positions = map(unique, ("row", "occurrence", "nth", "positions"))
    plan = plan_mix(docs, **parameters).filter(F.size("positions") > 0)
    plan = plan.select(F.col("_row").alias(row), F.col("occurrence").alias(nth), F.col("positions").alias(positions))
    kept = [c for c, name in zip(columns_of(docs), docs.columns) if name != position]
    alike = Window.partitionBy(row).orderBy("doc_id", "source")
    rows = docs.select(*kept, _row_name().alias(row)).withColumn(occurrence, F.row_number().over(alike))
    # written as a difference, the second condition is no join key, and the texts stay dealt by row alone
    placed = rows.join(plan, row).filter(F.col(occurrence) - F.col(nth) == 0)
    return placed.select(*kept, F.explode(positions).alias(position)).orderBy(position, "doc_id")
