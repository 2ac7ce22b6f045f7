"""Registered queries of validators, ablations and designs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import layout
from lodestone.operators.ordering import OrderingConfig, keyed, order_cloud
from lodestone.plans.clouds import BOX_SQL, CLOUD_SQL, EMBED_SQL, ORDER_SQL, cells_sql, embed_cloud, hilbert_sql, lineitem_cloud, lineitem_points, table
from lodestone.plans.queries import HILBERT, INSIDE, QUERIES, SQL, TEN, UNIFORM, WINDOWS, _r, query


@query(f"""WITH {CLOUD_SQL}, {BOX_SQL}, {WINDOWS}, hits AS (SELECT q.query_id, count(*) AS c, sum(raw_index) AS ids
  FROM cloud p JOIN windows q ON {INSIDE} GROUP BY 1)
 SELECT query_id, coalesce(c, 0) AS result_count, coalesce(ids, 0)::BIGINT AS id_sum, true AS agree FROM windows LEFT JOIN hits USING (query_id)""")
def cross_layout_agreement(spark, sf):
    """The same windows over four stored orders give the same points."""
    cloud = lineitem_cloud(spark, sf)
    windows = layout.smoke_windows(cloud)
    found = None
    for name, config in (("input", OrderingConfig(method="input")), ("lexicographic", OrderingConfig(method="lexicographic")),
                         ("morton", UNIFORM), ("hilbert", HILBERT)):
        paged = layout.with_pages(order_cloud(cloud, config).ordered)
        hits = layout.pruned_query(paged, layout.page_directory(paged), windows).groupBy("query_id").agg(
            F.count("*").alias("c"), F.sum("raw_index").alias("ids")
        )
        rows = windows.select("query_id").join(hits, "query_id", "left").fillna(0, ["c", "ids"]).withColumn("layout", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("query_id").agg(
        F.first("c").alias("result_count"), F.first("ids").alias("id_sum"), (F.countDistinct("c", "ids") == 1).alias("agree")
    )


@query(f"""WITH {CLOUD_SQL}, d AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy FROM cloud WHERE flag = 'R' AND x < 40)
 SELECT raw_index, floor((x - lx) / (hx - lx) * 1024)::BIGINT AS sx, floor((y - ly) / (hy - ly) * 1024)::BIGINT AS sy,
 (x < lx OR x > hx OR y < ly OR y > hy) AS outside FROM cloud, d""")
def signed_lattice(spark, sf):
    """Cells of a frozen domain without clamping: points outside have codes below 0 or beyond the last."""
    cloud = lineitem_cloud(spark, sf)
    domain = cloud.filter("flag = 'R' and x < 40").agg(
        F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy")
    )
    code = lambda c: F.floor((F.col(c) - F.col(f"l{c}")) / (F.col(f"h{c}") - F.col(f"l{c}")) * 1024.0)
    return cloud.join(F.broadcast(domain)).select(  # one row
        "raw_index", code("x").alias("sx"), code("y").alias("sy"),
        F.expr("x < lx or x > hx or y < ly or y > hy").alias("outside"),
    )


@query(f"""WITH {EMBED_SQL}, {BOX_SQL}, {cells_sql((3, 3, 3))}, {hilbert_sql((3, 3, 3))}
 SELECT row_number() OVER (ORDER BY key, x + y, x - y, z, x, y, raw_index) - 1 AS rank, raw_index, key FROM keyed""")
def projected_tie_break(spark, sf):
    """Keys unchanged; ties go by turned coordinates before the raw ones."""
    from lodestone.functions.ranking import with_row_number

    config = OrderingConfig(method="hilbert", bits="uniform", uniform_bits=3)
    cells = keyed(embed_cloud(spark, sf), config)[0].withColumn("u", F.col("x") + F.col("y")).withColumn("v", F.col("x") - F.col("y"))
    return with_row_number(cells, ["key", "u", "v", "z", "x", "y", "raw_index"], "rank").select("rank", "raw_index", "key")


@query(f"""WITH {EMBED_SQL}, {BOX_SQL}, {cells_sql(TEN)}, {hilbert_sql(TEN)}, {ORDER_SQL},
 s AS (SELECT (i * ((SELECT n FROM box) - 1)) // 99 AS rank FROM range(100) t(i))
 SELECT rank, raw_index FROM ordered JOIN s USING (rank)""")
def sampled_ranks(spark, sf):
    """The ranks at which metrics of a large order are sampled: evenly spread, both ends included."""
    ordered = order_cloud(embed_cloud(spark, sf), HILBERT).ordered
    n = table(spark, sf, "embeddings").count()
    chosen = spark.range(100).select(F.expr(f"id * {n - 1} div 99").alias("rank"))
    return ordered.join(F.broadcast(chosen), "rank").select("rank", "raw_index")


@query(f"WITH {CLOUD_SQL}, {BOX_SQL} SELECT round(sqrt((hx - lx) ** 2 + (hy - ly) ** 2 + (hz - lz) ** 2), 6) AS half_width FROM box")
def shared_cube(spark, sf):
    spans = [F.max(a) - F.min(a) for a in ("x", "y", "z")]
    return lineitem_points(spark, sf).agg(_r(F.sqrt(sum(s * s for s in spans))).alias("half_width"))


@query(f"""WITH {CLOUD_SQL} SELECT cloud_id, count(*) AS n, max(x) - min(x) AS extent_x, round(max(y) - min(y), 6) AS extent_y,
 round(max(z) - min(z), 6) AS extent_z, round(covar_samp(x, y) / sqrt(var_samp(x) * var_samp(y)), 6) AS shear FROM cloud GROUP BY 1""")
def geometry_descriptors(spark, sf):
    span = lambda c: F.max(c) - F.min(c)
    shear = F.covar_samp("x", "y") / F.sqrt(F.var_samp("x") * F.var_samp("y"))
    return lineitem_points(spark, sf).groupBy("cloud_id").agg(
        F.count("*").alias("n"), span("x").alias("extent_x"), _r(span("y")).alias("extent_y"), _r(span("z")).alias("extent_z"),
        _r(shear).alias("shear"),
    )


@query(f"""WITH {CLOUD_SQL}, g AS (SELECT cloud_id, (max(x) - min(x)) / 1024 AS wx, (max(y) - min(y)) / 1024 AS wy FROM cloud GROUP BY 1)
 SELECT round(max(wx), 9) AS width_x, round(max(wy), 9) AS width_y, round(max(wx) * 512, 6) AS half_x, round(max(wy) * 512, 6) AS half_y FROM g""")
def matched_resolution(spark, sf):
    """One physical cell width for all arms: the greatest that any of them needs, and the domain that follows."""
    width = lambda c: ((F.max(c) - F.min(c)) / 1024).alias(f"w{c}")
    g = lineitem_points(spark, sf).groupBy("cloud_id").agg(width("x"), width("y"))
    return g.agg(
        _r(F.max("wx"), 9).alias("width_x"), _r(F.max("wy"), 9).alias("width_y"),
        _r(F.max("wx") * 512).alias("half_x"), _r(F.max("wy") * 512).alias("half_y"),
    )


@query("""WITH w AS (SELECT (i // 256) AS block, i AS nth FROM range(1024) t(i))
 SELECT count(*) AS windows, count(DISTINCT nth) AS ids, 256::BIGINT AS first_block, 0::BIGINT AS misplaced,
 (SELECT round(max(l_quantity) - min(l_quantity), 6) FROM lineitem) AS extent_x FROM w""")
def workload_nesting(spark, sf):
    """256, 512 and 1,024 windows: each is the start of the next, and ids are unique."""
    from lodestone.plans.workload import nested_workload

    ends = lineitem_points(spark, sf).agg(*(f(c) for f in (F.min, F.max) for c in "xyz")).first()
    box = list(ends[:3]), list(ends[3:])
    small, middle, large = (nested_workload(*box, seed=7, n=n) for n in (256, 512, 1024))
    misplaced = sum(a != b for a, b in zip(small, large)) + sum(a != b for a, b in zip(middle, large))
    row = (len(large), len({w[0] for w in large}), len(small), misplaced, round(float(ends[3] - ends[0]), 6))
    return spark.createDataFrame([row], "windows long, ids long, first_block long, misplaced long, extent_x double")


@query(f"""WITH {CLOUD_SQL}, r AS (SELECT cloud_id, flag, x, rank() OVER (PARTITION BY cloud_id, flag ORDER BY x) AS low,
  count(*) OVER (PARTITION BY cloud_id, flag, x) AS ties FROM cloud)
 SELECT cloud_id, flag, round(sum((low + (ties - 1) / 2.0::DOUBLE) * sign(x - 25)), 4) AS signed_rank FROM r GROUP BY 1, 2""")
def signed_ranks(spark, sf):
    """Signed mid-rank sums within strata."""
    low = F.rank().over(Window.partitionBy("cloud_id", "flag").orderBy("x"))
    ties = F.count("*").over(Window.partitionBy("cloud_id", "flag", "x"))
    rows = lineitem_points(spark, sf).select("cloud_id", "flag", "x", (low + (ties - 1) / F.lit(2.0)).alias("mid"))
    return rows.groupBy("cloud_id", "flag").agg(_r(F.sum(F.col("mid") * F.signum(F.col("x") - 25)), 4).alias("signed_rank"))


@query()
def resolution_arms(spark, sf):
    """The frame replayed with other depths: balanced, weakest axis raised, uniform."""
    from lodestone.operators import allocation

    cloud = lineitem_cloud(spark, sf)
    rows = []
    for method in ("pca_hilbert",):
        about = keyed(cloud, OrderingConfig(method=method, bits="frame_core"))[1]
        bits = tuple(about["bits"])
        balanced = allocation.within_budget([-(-sum(bits) // 3)] * 3, 0, sum(bits))
        arms = {"replay": bits, "balanced": balanced, "uniform_10": TEN}
        arms |= {f"weakest_{b}": tuple(max(x, b) if x == min(bits) else x for x in bits) for b in (4, 7, 10)}
        rows += [(method, arm, *map(int, b)) for arm, b in arms.items()]
    return spark.createDataFrame(rows, "method string, arm string, bits_x int, bits_y int, bits_z int")


__all__ = ["QUERIES", "SQL"]
