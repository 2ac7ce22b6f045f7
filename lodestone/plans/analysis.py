"""Registered queries of the statistical operators and set checks, with their DuckDB counterparts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import metrics, ordering, stats
from lodestone.operators.ordering import OrderingConfig, order_cloud
from lodestone.plans.clouds import BOX_SQL, CLOUD_SQL, EMBED_SQL, ORDER_SQL, cells_sql, embed_cloud, hilbert_sql, lineitem_cloud, table
from lodestone.plans.queries import HILBERT, QUERIES, SQL, TEN, _named, _r, query
from lodestone.sources import generators, readers

# A measured case is a line: its arm the return flag, its key the supplier, its metric the price for a unit.
UNIT = "l_extendedprice / l_quantity"
MEANS = f"""cases AS (SELECT l_suppkey AS cloud_id, l_returnflag AS arm, avg({UNIT}) AS v FROM lineitem GROUP BY 1, 2)"""
DELTAS = """deltas AS (SELECT a.cloud_id, a.v - b.v AS delta FROM cases a JOIN cases b USING (cloud_id)
 WHERE a.arm = 'R' AND b.arm = 'N')"""


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("cloud_id"), F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("status"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"),
    )


def _cases(spark, sf):
    """Mean of each supplier and flag, from sums of decimals: these are the same in whatever order rows come, so equal
    cases have equal means and a mean that is asked for twice is the same twice."""
    exact = F.sum(F.col("v").cast("decimal(28,14)")).cast("double") / F.count("v")
    return _lines(spark, sf).groupBy("cloud_id", "arm").agg(exact.alias("v"))


@query(f"WITH {MEANS}, {DELTAS} SELECT cloud_id, round(delta, 6) AS delta FROM deltas")
def paired_contrast(spark, sf):
    return _named(stats.paired_contrast(_cases(spark, sf), "arm", "N", "R", ["cloud_id"], "v"))


@query(f"""WITH {MEANS}, {DELTAS} SELECT cloud_id % 3 AS stratum, count(*) FILTER (delta > 0) AS above,
 count(*) FILTER (delta < 0) AS below, count(*) FILTER (delta = 0) AS ties, round(avg(sign(delta)), 6) AS paired_delta
 FROM deltas GROUP BY 1""")
def sign_counts(spark, sf):
    d = stats.paired_contrast(_cases(spark, sf), "arm", "N", "R", ["cloud_id"], "v")
    return _named(stats.sign_counts(d.withColumn("stratum", F.col("cloud_id") % 3), ["stratum"]))


@query("""WITH p AS (SELECT o_orderpriority AS family, o_orderstatus AS name, round(count(*) / 1e5, 6) AS p FROM orders GROUP BY 1, 2),
 r AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) * p)
  AS raised FROM p)
 SELECT family, name, p, round(max(raised) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""")
def holm(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("name"))
    return _named(stats.holm(rows.agg(_r(F.count("*") / F.lit(1e5)).alias("p")), ["family"]))


@query("""WITH a AS (SELECT p_size AS v FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_size AS v FROM part WHERE p_partkey % 2 = 1)
 SELECT round(avg(sign(a.v - b.v)), 6) AS delta FROM a, b""")
def cliffs_delta(spark, sf):
    part = table(spark, sf, "part")
    return _named(stats.cliffs_delta(part.filter("p_partkey % 2 = 0"), part.filter("p_partkey % 2 = 1"), "p_size"))


@query(f"""SELECT l_returnflag AS arm, round(quantile_cont({UNIT}, 0.5), 6) AS p50, round(quantile_cont({UNIT}, 0.95), 6) AS p95,
 round(quantile_cont({UNIT}, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""")
def percentiles(spark, sf):
    return _named(stats.percentiles(_lines(spark, sf), ["arm"], "v"))


@query("""SELECT l_suppkey AS cloud_id, count(*) AS n, min(l_extendedprice) AS low,
 round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(median(l_extendedprice), 4) AS median,
 round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, max(l_extendedprice) AS high FROM lineitem GROUP BY 1""")
def group_summary(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "cloud_id")
    found = stats.summary(rows, ["cloud_id"], "l_extendedprice")
    return found.select("cloud_id", "n", "low", *(_r(c, 4).alias(c) for c in ("q25", "median", "q75")), "high")


@query(f"""WITH m AS (SELECT l_linestatus AS status, l_returnflag AS arm, avg({UNIT}) AS mean FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY mean, arm) AS nth FROM m)
 SELECT status, arm, round(mean, 6) AS mean FROM r WHERE nth = 1""")
def argmin_leader(spark, sf):
    return _named(stats.leader(_lines(spark, sf), ["status"], "arm", "v"))


# Student's quantile by its expansion in 1 / degrees of freedom about the normal one
@query(f"""WITH g AS (SELECT l_returnflag AS arm, avg({UNIT}) AS mean, stddev_samp({UNIT}) / sqrt(count(*)) AS error,
 count(*) - 1 AS v, 1.959963984540054 AS z FROM lineitem GROUP BY 1),
 t AS (SELECT arm, mean, error * (z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2)
  + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)) AS reach FROM g)
 SELECT arm, round(mean, 6) AS mean, round(mean - reach, 6) AS low, round(mean + reach, 6) AS high FROM t""")
def mean_interval(spark, sf):
    return _named(stats.mean_interval(_lines(spark, sf), ["arm"], "v"))


# prices have two decimals, so medians are added up as whole numbers and engines agree to the last bit
@query("""WITH q AS (SELECT o_custkey % 7 AS query_id, k, CAST(round(m * 200) AS BIGINT) AS m FROM (SELECT o_custkey,
 o_orderstatus AS k, median(o_totalprice) AS m FROM orders GROUP BY 1, 2))
 SELECT query_id, k, CAST(sum(m) AS DOUBLE) / (200.0::DOUBLE * count(*)) AS m FROM q GROUP BY 1, 2""")
def mean_of_medians(spark, sf):
    inner = table(spark, sf, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("k")).agg(F.median("o_totalprice").alias("m"))
    rows = inner.select((F.col("o_custkey") % 7).alias("query_id"), "k", F.round(F.col("m") * 200).cast("long").alias("m"))
    return rows.groupBy("query_id", "k").agg((F.sum("m").cast("double") / (F.lit(200.0) * F.count("*"))).alias("m"))


@query("""SELECT event_type, CASE WHEN count(CASE WHEN value > 1 THEN value END) = count(*) THEN round(median(value), 6) END AS withheld,
 round(median(value), 6) AS whole FROM events GROUP BY 1""")
def median_if_complete(spark, sf):
    rows = table(spark, sf, "events").withColumn("seen", F.when(F.col("value") > 1, F.col("value")))
    return rows.groupBy("event_type").agg(
        _r(stats.median_if_complete("seen")).alias("withheld"), _r(F.median("value")).alias("whole")
    )


@query("""SELECT s_suppkey, CASE WHEN s_acctbal - 2000 > 0 THEN round(greatest(5000 - s_acctbal, 0) / (s_acctbal - 2000), 6) END AS queries,
 CASE WHEN s_nationkey = 0 THEN NULL ELSE round(s_acctbal / s_nationkey, 6) END AS rate FROM supplier""")
def break_even(spark, sf):
    rows = table(spark, sf, "supplier")
    return rows.select(
        "s_suppkey",
        _r(stats.break_even(5000 - F.col("s_acctbal"), F.col("s_acctbal") - 2000)).alias("queries"),
        _r(stats.miss_rate(F.col("s_acctbal"), F.col("s_nationkey"))).alias("rate"),
    )


@query(f"""WITH m AS (SELECT l_linestatus AS status, l_suppkey AS arm, avg({UNIT}) AS mean FROM lineitem GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY mean, arm) AS nth FROM m)
 SELECT round(corr(a.nth, b.nth), 6) AS rho, count(*) AS arms FROM r a JOIN r b USING (arm) WHERE a.status = 'F' AND b.status = 'O'""")
def rank_correlation(spark, sf):
    means = _lines(spark, sf).groupBy("status", F.col("cloud_id").alias("arm")).agg(F.avg("v").alias("mean"))
    ranks = means.withColumn("nth", F.row_number().over(Window.partitionBy("status").orderBy("mean", "arm")))
    a = ranks.filter("status = 'F'").select("arm", F.col("nth").alias("a"))
    b = ranks.filter("status = 'O'").select("arm", F.col("nth").alias("b"))
    return a.join(b, "arm").agg(_r(F.corr("a", "b")).alias("rho"), F.count("*").alias("arms"))


@query(f"""WITH m AS (SELECT l_suppkey AS cloud_id, avg({UNIT}) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS rf,
 avg({UNIT}) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS af, avg({UNIT}) FILTER (l_returnflag = 'N' AND l_linestatus = 'F')
 AS nf, avg({UNIT}) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS no FROM lineitem GROUP BY 1)
 SELECT cloud_id, round((rf + af) / 2 - nf, 6) AS frame_effect, round(no - nf, 6) AS rule_effect, round(rf - af - (no - nf), 6)
 AS interaction FROM m""")
def factorial_contrasts(spark, sf):
    cell = F.concat("arm", "status")
    lines = _lines(spark, sf).withColumn("cell", cell)
    wide = lines.groupBy("cloud_id").pivot("cell", ["RF", "AF", "NF", "NO"]).agg(F.avg("v"))
    return wide.select(
        "cloud_id",
        _r((F.col("RF") + F.col("AF")) / 2 - F.col("NF")).alias("frame_effect"),
        _r(F.col("NO") - F.col("NF")).alias("rule_effect"),
        _r(F.col("RF") - F.col("AF") - (F.col("NO") - F.col("NF"))).alias("interaction"),
    )


@query(f"""WITH {MEANS}, {DELTAS}, g AS (SELECT cloud_id % 5 AS cell, count(*) AS n, bool_and(delta < 500) AS holds FROM deltas GROUP BY 1)
 SELECT bool_and(holds) AND count(*) >= 2 AS passes, sum(n)::BIGINT AS n FROM g""")
def directional_gate(spark, sf):
    d = stats.paired_contrast(_cases(spark, sf), "arm", "N", "R", ["cloud_id"], "v")
    cells = d.groupBy((F.col("cloud_id") % 5).alias("cell")).agg(F.count("*").alias("n"), F.bool_and(F.col("delta") < 500).alias("holds"))
    return cells.agg((F.bool_and("holds") & (F.count("*") >= 2)).alias("passes"), F.sum("n").alias("n"))


@query(f"""SELECT l_returnflag AS arm, round(avg({UNIT}), 6) AS mean, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag))""")
def pooled_and_stratified(spark, sf):
    _lines(spark, sf).createOrReplaceTempView("_pooled_lines")
    return spark.sql(
        "select arm, round(avg(v), 6) as mean, count(*) as n from _pooled_lines group by grouping sets ((), (arm))"
    )


@query("""WITH p AS (SELECT p_brand AS policy, avg(p_size) / 50 AS tau, min(p_retailprice) / 100 AS cost FROM part GROUP BY 1),
 g AS (SELECT tau_min, budget FROM (VALUES (0.4::DOUBLE), (0.5), (0.51), (0.6)) t(tau_min), (VALUES (9.0::DOUBLE), (9.1), (10), (20)) b(budget)),
 f AS (SELECT tau_min, budget, policy, cost, row_number() OVER (PARTITION BY tau_min, budget ORDER BY cost, policy) AS nth
  FROM p JOIN g ON tau >= tau_min AND cost <= budget)
 SELECT tau_min, budget, policy, round(cost, 6) AS cost FROM g LEFT JOIN (SELECT * FROM f WHERE nth = 1) USING (tau_min, budget)""")
def scenario_grid(spark, sf):
    policies = table(spark, sf, "part").groupBy(F.col("p_brand").alias("policy")).agg(
        (F.avg("p_size") / 50).alias("tau"), (F.min("p_retailprice") / 100).alias("cost")
    )
    taus = spark.createDataFrame([(t,) for t in (0.4, 0.5, 0.51, 0.6)], "tau_min double")
    budgets = spark.createDataFrame([(b,) for b in (9.0, 9.1, 10.0, 20.0)], "budget double")
    return _named(stats.cheapest_eligible(policies, taus.join(F.broadcast(budgets))))


@query(f"""SELECT l_suppkey AS cloud_id, count(DISTINCT l_returnflag || l_linestatus) AS allocations, median(l_quantity) AS median_bits,
 count(*) FILTER (l_tax > 0.05) AS fallback, count(*) FILTER (l_tax IS NULL) AS unknown FROM lineitem GROUP BY 1""")
def allocation_histogram(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cloud_id")).agg(
        F.countDistinct(F.concat("l_returnflag", "l_linestatus")).alias("allocations"),
        F.median("l_quantity").alias("median_bits"),
        F.count_if(F.col("l_tax") > 0.05).alias("fallback"),
        F.count_if(F.col("l_tax").isNull()).alias("unknown"),
    )


@query(f"""WITH m AS (SELECT l_suppkey AS policy, l_returnflag AS cond, avg({UNIT}) AS v FROM lineitem GROUP BY 1, 2)
 SELECT policy, round(min(v), 6) AS worst, round(max(v), 6) AS best, arg_min(cond, (v, cond)) AS worst_at FROM m GROUP BY 1""")
def worst_case(spark, sf):
    return _cases(spark, sf).groupBy(F.col("cloud_id").alias("policy")).agg(
        _r(F.min("v")).alias("worst"), _r(F.max("v")).alias("best"), F.min_by("arm", F.struct("v", "arm")).alias("worst_at")
    )


CASES = """SELECT a.method, b.rule, c.cond, g.geometry, n.points, s.seed
 FROM (VALUES ('hilbert'), ('morton'), ('pca_hilbert'), ('robust_hilbert')) a(method),
 (VALUES ('uniform'), ('monotone_half'), ('frame_core')) b(rule), (VALUES ('D0'), ('D1'), ('D2'), ('D3'), ('D4')) c(cond),
 (VALUES ('E0'), ('E1'), ('E2'), ('E5'), ('E6'), ('E7'), ('E8')) g(geometry), (VALUES (256), (384)) n(points),
 (SELECT DISTINCT s_suppkey::INT AS seed FROM supplier) s WHERE NOT (a.method = 'hilbert' AND b.rule <> 'uniform')"""


@query(CASES)
def case_matrix(spark, sf):
    from lodestone.plans.matrix import expand

    return expand(spark, table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("seed")).distinct())


@query("""WITH lo AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy, count(*) n FROM (SELECT l_quantity x, l_tax y FROM lineitem))
 SELECT n AS clean, round_even(n * 0.25, 0)::BIGINT AS outliers, n::BIGINT AS first_outlier, 0::BIGINT AS inside FROM lo""")
def contaminate_union(spark, sf):
    cloud = lineitem_cloud(spark, sf).select("raw_index", "x", "y", "z")
    lo, hi, _, n = generators.spans(cloud)
    inside = F.lit(True)
    for c, a, b in zip("xyz", lo, hi):
        inside = inside & F.col(c).between(a, b)
    dirty = generators.contaminate(cloud, "uniform_bbox", 0.25, 7)
    extra = F.col("raw_index") >= n
    return dirty.agg(
        F.count_if(~extra).alias("clean"),
        F.count_if(extra).alias("outliers"),
        F.min(F.when(extra, F.col("raw_index"))).alias("first_outlier"),
        F.count_if(extra & inside).alias("inside"),
    )


@query(f"""WITH {CLOUD_SQL}, {BOX_SQL} SELECT n AS rows, n AS distinct_rows, 0::BIGINT AS least, n - 1 AS greatest, true AS valid FROM box""")
def perm_check(spark, sf):
    cloud = lineitem_cloud(spark, sf)
    return metrics.permutation_check(order_cloud(cloud, HILBERT).ordered, table(spark, sf, "lineitem").count())


@query("""WITH e AS (SELECT DISTINCT c_custkey AS k FROM customer), a AS (SELECT DISTINCT o_custkey AS k FROM orders)
 SELECT (SELECT count(*) FROM (SELECT k FROM e EXCEPT SELECT k FROM a)) AS missing,
 (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM e)) AS unexpected""")
def anti_join_coverage(spark, sf):
    expected = table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).distinct()
    actual = table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    rows = expected.join(actual, "k", "left_anti").select(F.lit(1).alias("m"), F.lit(0).alias("u")).union(
        actual.join(expected, "k", "left_anti").select(F.lit(0), F.lit(1))
    )
    return rows.agg(F.coalesce(F.sum("m"), F.lit(0)).cast("long").alias("missing"), F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("unexpected"))


SMALL = f"WITH {EMBED_SQL}, {BOX_SQL}, {cells_sql(TEN)}, {hilbert_sql(TEN)}, {ORDER_SQL}"


@query(f"""{SMALL}, lex AS (SELECT raw_index, row_number() OVER (ORDER BY x, y, z, raw_index) - 1 AS rank FROM cloud)
 SELECT coalesce(a.rank, b.rank) AS rank, a.raw_index AS left_index, b.raw_index AS right_index FROM ordered a FULL JOIN lex b
 ON a.rank = b.rank WHERE a.raw_index IS DISTINCT FROM b.raw_index""")
def order_diff(spark, sf):
    cloud = embed_cloud(spark, sf)
    lex = order_cloud(cloud, OrderingConfig(method="lexicographic")).ordered
    return metrics.order_diff(order_cloud(cloud, HILBERT).ordered, lex)


@query("""SELECT p_partkey AS line, p_size::DOUBLE AS x, round(p_retailprice, 2) AS y, p_partkey::DOUBLE AS z FROM part""")
def xyz_parse(spark, sf):
    line = F.concat_ws(" ", F.concat("p_size", F.lit(", ")), F.concat(F.round("p_retailprice", 2), F.lit(";")), "p_partkey", F.lit("rest"))
    x, y, z = readers.parse_line(F.col("value"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("line"), line.alias("value"))
    return rows.select("line", x.alias("x"), y.alias("y"), z.alias("z"))


@query("""WITH s AS (SELECT i, ((42 + (i + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS s
  FROM (SELECT DISTINCT o_orderkey AS i FROM orders)),
 a AS (SELECT i, ((xor(s, s >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS s FROM s),
 b AS (SELECT i, ((xor(s, s >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS s FROM a)
 SELECT i AS id, (xor(s, s >> 31) >> 11)::BIGINT AS top FROM b""")
def splitmix_stream(spark, sf):
    @F.pandas_udf("long")
    def top(i: pd.Series) -> pd.Series:
        return pd.Series((generators.draws(42, i.to_numpy()) >> np.uint64(11)).astype(np.int64))

    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).distinct().select("id", top("id").alias("top"))


@query()
def generated_clouds(spark, sf):
    out = None
    seeds = sorted(r[0] for r in table(spark, sf, "region").select("r_regionkey").distinct().collect())
    for seed in seeds:
        for k, family in enumerate(generators.FAMILIES):
            c = generators.cloud(spark, family, 500, 100 * (seed + 1) + k)
            c = c.withColumns({"family": F.lit(family), "seed": F.lit(seed)})
            out = c if out is None else out.unionByName(c)
    return out


@query()
def contaminated_tau(spark, sf):
    """Stability of two orders under clustered outliers."""
    cloud = embed_cloud(spark, sf).select("raw_index", "x", "y", "z")
    n = table(spark, sf, "embeddings").count()
    dirty = generators.contaminate(cloud, "clustered", 0.25, 3)
    rows = []
    for config in (HILBERT, OrderingConfig()):
        up, down = metrics.kendall_tau_big(order_cloud(cloud, config).ordered, order_cloud(dirty, config).ordered, n)
        rows.append((config.name, (up - down) / max(up + down, 1)))
    return spark.createDataFrame(rows, "method string, tau double")


@query()
def bootstrap_ci(spark, sf):
    return stats.bootstrap_by_group(_cases(spark, sf), "arm", "v")


@query()
def case_measurements(spark, sf):
    from lodestone.plans.matrix import expand, measure

    seeds = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("seed")).distinct()
    return measure(expand(spark, seeds).filter("points = 256 and geometry in ('E0', 'E1', 'E2')"))


__all__ = ["QUERIES", "SQL", "ordering"]


# --- resampling -------------------------------------------------------------------------------------------------

STRATA = f"""WITH {MEANS}, {DELTAS}, d AS (SELECT cloud_id, cloud_id % 3 AS stratum, delta,
 row_number() OVER (PARTITION BY cloud_id % 3 ORDER BY cloud_id) - 1 AS i, count(*) OVER (PARTITION BY cloud_id % 3) AS n FROM deltas)"""
DRAWS = 500


def _deltas(spark, sf):
    d = stats.paired_contrast(_cases(spark, sf), "arm", "N", "R", ["cloud_id"], "v")
    return d.withColumn("stratum", F.col("cloud_id") % 3)


@query(f"""{STRATA}, drawn AS (SELECT b, stratum, ('0x' || substr(md5('7:' || b || ':' || stratum || ':' || i), 1, 8))::BIGINT % n AS i
  FROM d, range({DRAWS}) t(b)),
 boots AS (SELECT b, avg(delta) AS mean, median(delta) AS median FROM drawn JOIN d USING (stratum, i) GROUP BY b),
 ends AS (SELECT list_sort(list(mean)) AS m, list_sort(list(median)) AS k FROM boots)
 SELECT round((SELECT avg(delta) FROM d), 6) AS mean, round((SELECT median(delta) FROM d), 6) AS median, (SELECT count(*) FROM d) AS n,
 round(m[{int(0.025 * DRAWS) + 1}], 6) AS mean_low, round(m[{int(0.975 * DRAWS) + 1}], 6) AS mean_high,
 round(k[{int(0.025 * DRAWS) + 1}], 6) AS median_low, round(k[{int(0.975 * DRAWS) + 1}], 6) AS median_high FROM ends""")
def stratified_bootstrap(spark, sf):
    """Mean difference and median with percentile intervals, resampled within strata by counter-based draws."""
    return _named(stats.resampled_interval(_deltas(spark, sf), ["stratum"], "cloud_id", "delta", DRAWS, 7))


SIGNED = f"""{STRATA}, ranked AS (SELECT cloud_id % 11 AS block, sign(delta) * (rank() OVER (PARTITION BY stratum ORDER BY abs(delta))
  + (count(*) OVER (PARTITION BY stratum, abs(delta)) - 1) / 2.0::DOUBLE) AS r FROM d WHERE delta <> 0),
 sums AS (SELECT block, sum(r) AS signed FROM ranked GROUP BY 1)"""


@query(f"{SIGNED} SELECT block, round(signed, 6) AS signed FROM sums")
def signed_rank_blocks(spark, sf):
    rows = _deltas(spark, sf).withColumn("block", F.col("cloud_id") % 11)
    return _named(stats.signed_rank_sums(rows, ["stratum"], ["block"], "delta"))


@query(f"""{SIGNED}, s AS (SELECT list(signed ORDER BY signed) AS s FROM sums),
 flips AS (SELECT list_sum(list_transform(range(len(s)), lambda k: s[k + 1] * (1 - 2 * ((i >> k) & 1)))) AS total,
  list_sum(s) AS seen, len(s) AS blocks FROM range((1 << (SELECT len(s) FROM s))::BIGINT) t(i), s)
 SELECT any_value(blocks) AS blocks, count(*) FILTER (total <= seen + 1e-9) AS lower,
 round(count(*) FILTER (total <= seen + 1e-9) / count(*), 6) AS p FROM flips""")
def sign_flip_test(spark, sf):
    """Exact block sign-flip test of the signed ranks: every flip is looked at."""
    rows = _deltas(spark, sf).withColumn("block", F.col("cloud_id") % 11)
    return _named(stats.flipped_share(stats.signed_rank_sums(rows, ["stratum"], ["block"], "delta"), "signed"))
