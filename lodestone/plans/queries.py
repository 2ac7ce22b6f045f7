"""Registered queries of the point operators, each with the same result in DuckDB SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import curves
from lodestone.functions.store import cut, fresh_path, kept
from lodestone.operators import layout, metrics, ordering, refine, robust, stats
from lodestone.operators.ordering import OrderingConfig, keyed, order_cloud
from lodestone.plans.clouds import (
    BOX_SQL, CLOUD_SQL, EMBED_SQL, EVENTS_SQL, ORDER_SQL, cells_sql, embed_cloud, events_cloud, hilbert_sql,
    lineitem_cloud, lineitem_points, morton_sql, table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TEN = (10, 10, 10)
COMPACT = (10, 4, 1)
UNIFORM = OrderingConfig(method="morton", bits="uniform")
HILBERT = OrderingConfig(method="hilbert", bits="uniform")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def _one_row(spark: SparkSession, values: dict) -> DataFrame:
    kinds = {int: "long", float: "double"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def _named(df: DataFrame) -> DataFrame:
    """Every double rounded, so that sums in another order compare equal."""
    return df.select(*(_r(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# --- clouds, bounds, orders -----------------------------------------------------------------------------------

WITH = f"WITH {CLOUD_SQL}, {BOX_SQL}"
MORTON = f"{WITH}, {cells_sql(TEN)}, {morton_sql(TEN)}, {ORDER_SQL}"
HILB = f"{WITH}, {cells_sql(TEN)}, {hilbert_sql(TEN)}, {ORDER_SQL}"
# the longest axis of lineitem is y, then x, then z
HALF = (4, 10, 1)
COMP = f"{WITH}, {cells_sql(HALF)}, {hilbert_sql(HALF)}, {ORDER_SQL}"


@query(f"""{WITH} SELECT n, lx, hx, ly, hy, lz, hz, (hx - lx) / 2 AS half_x, (hy - ly) / 2 AS half_y,
 (hz - lz) / 2 AS half_z FROM box""")
def cloud_bounds(spark, sf):
    cloud = lineitem_points(spark, sf)
    b = cloud.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{c}") for c in "xyz" for k, f in (("l", F.min), ("h", F.max))))
    return b.select("*", *(((F.col(f"h{c}") - F.col(f"l{c}")) / 2).alias(f"half_{c}") for c in "xyz"))


@query(f"""WITH {CLOUD_SQL} SELECT row_number() OVER (ORDER BY x, y, z, raw_index) - 1 AS rank, raw_index FROM cloud""")
def lex_order(spark, sf):
    return order_cloud(lineitem_cloud(spark, sf), OrderingConfig(method="lexicographic")).ordered.select("rank", "raw_index")


@query(f"WITH {CLOUD_SQL} SELECT raw_index AS rank, raw_index, raw_index AS key FROM cloud")
def input_order(spark, sf):
    return order_cloud(lineitem_cloud(spark, sf), OrderingConfig(method="input")).ordered.select("rank", "raw_index", "key")


@query(f"{WITH}, {cells_sql(TEN)} SELECT raw_index, qx, qy, qz FROM cells")
def quantize_uniform(spark, sf):
    return keyed(lineitem_cloud(spark, sf), UNIFORM)[0].select("raw_index", "qx", "qy", "qz")


@query(f"{WITH}, {cells_sql(TEN)}, {morton_sql(TEN)} SELECT raw_index, key FROM keyed")
def morton_key(spark, sf):
    return keyed(lineitem_cloud(spark, sf), UNIFORM)[0].select("raw_index", "key")


@query(f"{MORTON} SELECT rank, raw_index, key FROM ordered")
def morton_order(spark, sf):
    return order_cloud(lineitem_cloud(spark, sf), UNIFORM).ordered.select("rank", "raw_index", "key")


@query(f"{WITH}, {cells_sql(TEN)}, {hilbert_sql(TEN)} SELECT raw_index, key FROM keyed")
def hilbert_key(spark, sf):
    return keyed(lineitem_cloud(spark, sf), HILBERT)[0].select("raw_index", "key")


@query(f"{HILB} SELECT rank, raw_index, key FROM ordered")
def hilbert_order(spark, sf):
    return order_cloud(lineitem_cloud(spark, sf), HILBERT).ordered.select("rank", "raw_index", "key")


@query(f"{COMP} SELECT rank, raw_index, key FROM ordered")
def compact_hilbert_order(spark, sf):
    config = OrderingConfig(method="compact_hilbert", bits="monotone_half")
    return order_cloud(lineitem_cloud(spark, sf), config).ordered.select("rank", "raw_index", "key")


@query(f"{WITH}, {cells_sql(TEN)} SELECT raw_index, qx, qy, qz FROM cells")
def hilbert_decode(spark, sf):
    rows = keyed(lineitem_cloud(spark, sf), HILBERT)[0].select("raw_index", curves.hilbert_decode(F.col("key"), TEN).alias("q"))
    return rows.select("raw_index", *(F.col("q")[k].alias(f"q{c}") for k, c in enumerate("xyz")))


@query(f"""WITH {EVENTS_SQL}, {BOX_SQL}, {cells_sql((21, 21, 21))}, {hilbert_sql((21, 21, 21))}
 SELECT cloud_id, count(*) AS n, max(key) AS top, min(key) AS low FROM keyed GROUP BY cloud_id""")
def hilbert_63_bits(spark, sf):
    cloud = events_cloud(spark, sf)
    config = OrderingConfig(method="hilbert", bits="uniform", uniform_bits=21)
    cells = keyed(cloud, config)[0].join(cloud.select("raw_index", "cloud_id"), "raw_index")
    return cells.groupBy("cloud_id").agg(F.count("*").alias("n"), F.max("key").alias("top"), F.min("key").alias("low"))


# --- pages and windows ------------------------------------------------------------------------------------------

PAGED = "paged AS (SELECT *, rank // 128 AS page_id FROM ordered)"
DIRECTORY = """directory AS (SELECT page_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
  min(z) AS min_z, max(z) AS max_z, count(*) AS valid_count FROM paged GROUP BY page_id)"""
WINDOWS = """mid AS (SELECT cloud.x, cloud.y, cloud.z FROM cloud, box WHERE raw_index = n // 2),
windows AS (
  SELECT 'bbox_all' AS query_id, lx AS min_x, ly AS min_y, lz AS min_z, hx AS max_x, hy AS max_y, hz AS max_z FROM box
  UNION ALL SELECT 'center_local', (lx + hx) / 2 - 0.05::DOUBLE * (hx - lx), (ly + hy) / 2 - 0.05::DOUBLE * (hy - ly),
    (lz + hz) / 2 - 0.05::DOUBLE * (hz - lz), (lx + hx) / 2 + 0.05::DOUBLE * (hx - lx),
    (ly + hy) / 2 + 0.05::DOUBLE * (hy - ly), (lz + hz) / 2 + 0.05::DOUBLE * (hz - lz) FROM box
  UNION ALL SELECT 'point_exact', x, y, z, x, y, z FROM mid
  UNION ALL SELECT 'outside_empty', hx + (hx - lx) + 1, hy + (hy - ly) + 1, hz + (hz - lz) + 1, hx + (hx - lx) + 2,
    hy + (hy - ly) + 2, hz + (hz - lz) + 2 FROM box)"""
INSIDE = "p.x BETWEEN q.min_x AND q.max_x AND p.y BETWEEN q.min_y AND q.max_y AND p.z BETWEEN q.min_z AND q.max_z"
MEETS = " AND ".join(f"q.max_{c} >= d.min_{c} AND q.min_{c} <= d.max_{c}" for c in "xyz")
STORE = f"{HILB}, {PAGED}, {DIRECTORY}, {WINDOWS}"
SCAN = f"SELECT q.query_id, p.raw_index FROM cloud p JOIN windows q ON {INSIDE}"
COUNTERS = f"""counters AS (SELECT w.query_id, coalesce(c.pages, 0) AS candidate_pages, coalesce(c.pages, 0) AS pages_read,
  coalesce(c.examined, 0)::BIGINT AS records_examined, coalesce(c.pages, 0) * 4096 AS logical_bytes,
  coalesce(h.hits, 0) AS result_count FROM windows w
  LEFT JOIN (SELECT q.query_id, count(*) AS pages, sum(d.valid_count) AS examined FROM directory d JOIN windows q
    ON {MEETS} GROUP BY 1) c USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS hits FROM ({SCAN}) GROUP BY 1) h USING (query_id))"""


def _store(spark, sf):
    """The cloud, its points and directory as stored pages, and four windows; stored once in a session."""
    cloud = lineitem_cloud(spark, sf)
    points, directory = stored_layout(cloud, sf)
    return cloud, points, directory, layout.smoke_windows(cloud)


def stored_layout(cloud: DataFrame, sf: str, pages_per_file: int = 512) -> tuple[DataFrame, DataFrame]:
    spark = cloud.sparkSession

    def write() -> str:
        path = fresh_path(spark, "layout")
        layout.write_layout(order_cloud(cloud, HILBERT).ordered, path, pages_per_file)
        return path

    return layout.read_layout(spark, kept(("layout", sf, pages_per_file), table(spark, sf, "lineitem"), write))


@query(f"{HILB}, {PAGED}, {DIRECTORY} SELECT * FROM directory")
def page_directory(spark, sf):
    return layout.page_directory(layout.with_pages(order_cloud(lineitem_cloud(spark, sf), HILBERT).ordered))


@query(f"WITH {CLOUD_SQL}, {BOX_SQL}, {WINDOWS} {SCAN}")
def window_full_scan(spark, sf):
    cloud = lineitem_cloud(spark, sf)
    return layout.full_scan(cloud, layout.smoke_windows(cloud))


@query(f"WITH {CLOUD_SQL}, {BOX_SQL}, {WINDOWS} {SCAN}")
def window_pruned(spark, sf):
    _, paged, directory, windows = _store(spark, sf)
    return layout.pruned_query(paged, directory, windows)


@query(f"{STORE}, {COUNTERS} SELECT * FROM counters")
def window_counters(spark, sf):
    _, paged, directory, windows = _store(spark, sf)
    return layout.query_counters(paged, directory, windows)


@query(f"""{STORE}, {COUNTERS} SELECT round(median((records_examined - result_count) / result_count), 6) AS median_overfetch,
 round(avg((records_examined - result_count) / result_count), 6) AS mean_overfetch,
 round(quantile_cont((records_examined - result_count) / result_count, 0.95), 6) AS p95_overfetch FROM counters WHERE result_count > 0""")
def overfetch(spark, sf):
    _, paged, directory, windows = _store(spark, sf)
    over = (F.col("records_examined") - F.col("result_count")) / F.col("result_count")
    rows = layout.query_counters(paged, directory, windows).filter("result_count > 0")
    return rows.agg(
        _r(F.median(over)).alias("median_overfetch"), _r(F.avg(over)).alias("mean_overfetch"),
        _r(F.percentile(over, 0.95)).alias("p95_overfetch"),
    )


@query(f"""{STORE}, {COUNTERS} SELECT round(1 - avg(pages_read) / (SELECT count(*) FROM directory), 6) AS pruned
 FROM counters""")
def page_pruning(spark, sf):
    _, paged, directory, windows = _store(spark, sf)
    pages = directory.agg(F.count("*").alias("pages"))
    rows = layout.query_counters(paged, directory, windows).agg(F.avg("pages_read").alias("read"))
    return rows.join(F.broadcast(pages)).select(_r(1 - F.col("read") / F.col("pages")).alias("pruned"))


@query(f"""{STORE} SELECT count(*) AS pages, 0::BIGINT AS damaged, sum(valid_count)::BIGINT AS records,
 count(DISTINCT page_id // 512) AS files FROM directory""")
def stored_pages(spark, sf):
    """The stored pages read back and held against their directory: number, box and checksum of each."""
    _, points, directory, _ = _store(spark, sf)
    damaged = layout.damaged_pages(points, directory).agg(F.count("*").alias("damaged"))
    facts = points.agg(
        F.countDistinct("page_id").alias("pages"), F.count("*").alias("records"), F.countDistinct("file_id").alias("files")
    )
    return facts.join(F.broadcast(damaged)).select("pages", "damaged", "records", "files")  # one row each


@query("SELECT 0::BIGINT AS violations")
def directory_check(spark, sf):
    _, paged, directory, _ = _store(spark, sf)
    return layout.directory_violations(paged, directory).agg(F.count("*").alias("violations"))


@query(f"""{STORE}, {COUNTERS} SELECT count(*) FILTER (logical_bytes <> pages_read * 4096 OR result_count > records_examined
 OR records_examined > pages_read * 128) AS violations FROM counters""")
def counter_check(spark, sf):
    _, paged, directory, windows = _store(spark, sf)
    bad = F.expr(
        "logical_bytes <> pages_read * 4096 or result_count > records_examined or records_examined > pages_read * 128"
    )
    return layout.query_counters(paged, directory, windows).agg(F.count_if(bad).alias("violations"))


# --- metrics ----------------------------------------------------------------------------------------------------

EDGES = """edges AS (SELECT key, lag(key) OVER w AS key_before, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2
  + (z - lag(z) OVER w) ** 2) AS d, rank FROM ordered WINDOW w AS (ORDER BY rank))"""
SMALL = f"WITH {EMBED_SQL}, {BOX_SQL}, {cells_sql(TEN)}, {hilbert_sql(TEN)}, {ORDER_SQL}"
DIST = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


def _ordered(spark, sf, config=HILBERT):
    """The points in order, without their index: what is measured along a path does not tell equal points apart."""
    return order_cloud(lineitem_points(spark, sf), config).ordered


def _small(spark, sf):
    return order_cloud(embed_cloud(spark, sf), HILBERT).ordered


@query(f"{MORTON}, {EDGES} SELECT round(avg(d), 6) AS miad, count(d) AS edges FROM edges")
def miad(spark, sf):
    return _named(metrics.miad(_ordered(spark, sf, UNIFORM)))


@query(f"""{HILB}, {EDGES} SELECT flag, CASE WHEN flag = 'whole' THEN (SELECT round(avg(d), 6) FROM edges) ELSE 0 END AS miad,
 flag = 'whole' AS valid FROM (VALUES ('whole'), ('one lost'), ('one twice')) t(flag)""")
def checked_path(spark, sf):
    """The path length of an order, and 0 for the same order with a point lost or named twice."""
    ordered = order_cloud(lineitem_cloud(spark, sf), HILBERT).ordered
    n = ordered.count()
    lost = ordered.filter(F.col("rank") != n // 2)
    twice = ordered.withColumn("raw_index", F.when(F.col("rank") == 1, F.lit(0).cast("long")).otherwise(F.col("raw_index")))
    twice = twice.withColumn("raw_index", F.when(F.col("rank") == 2, F.lit(0).cast("long")).otherwise(F.col("raw_index")))
    cases = (("whole", ordered), ("one lost", lost), ("one twice", twice))
    rows = [_named(metrics.checked_miad(o, n)).withColumn("flag", F.lit(name)) for name, o in cases]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""{HILB}, {EDGES} SELECT round((SELECT avg(d) FROM edges) / sqrt((hx - lx) ** 2 + (hy - ly) ** 2 + (hz - lz) ** 2), 6)
 AS normalized_miad FROM box""")
def normalized_miad(spark, sf):
    return _named(metrics.normalized_miad(_ordered(spark, sf)))


@query(f"""{HILB}, {EDGES} SELECT round(sum(CASE WHEN key = key_before THEN d ELSE 0 END), 2) AS within,
 round(sum(CASE WHEN key <> key_before THEN d ELSE 0 END), 2) AS across,
 round(avg((key = key_before)::INT), 6) AS same_key_share,
 (SELECT max(c) FROM (SELECT count(*) AS c FROM keyed GROUP BY key)) AS largest_group FROM edges WHERE rank > 0""")
def same_key_split(spark, sf):
    r = metrics.same_key_split(_ordered(spark, sf))
    return r.select(_r("within", 2).alias("within"), _r("across", 2).alias("across"),
                    _r("same_key_share").alias("same_key_share"), "largest_group")


@query(f"""{HILB}, widths AS (SELECT a.rank // 32 AS block, max({DIST}) AS d FROM ordered a JOIN ordered b
 ON a.rank // 32 = b.rank // 32 AND a.rank < b.rank GROUP BY 1)
 SELECT round(avg(d), 6) AS mean_diameter, round(quantile_disc(d, 0.95), 6) AS p95_diameter, count(*) AS blocks FROM widths""")
def block_diameter(spark, sf):
    return _named(metrics.block_diameter(_ordered(spark, sf)))


@query(f"""{SMALL} SELECT round(max(({DIST}) ** 3 / (b.rank - a.rank)), 6) AS l1,
 round(min(({DIST}) ** 3 / (b.rank - a.rank)), 6) AS l2 FROM ordered a JOIN ordered b ON a.rank < b.rank""")
def l1_l2_locality(spark, sf):
    return _named(metrics.l1_l2_locality(_small(spark, sf)))


KNN = """near AS (SELECT a.raw_index, b.raw_index AS other, row_number() OVER (PARTITION BY a.raw_index ORDER BY
 (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, b.raw_index) AS nth FROM cloud a JOIN cloud b
 ON a.raw_index <> b.raw_index)"""


@query(f"WITH {EMBED_SQL}, {KNN} SELECT raw_index, other AS neighbour, nth FROM near WHERE nth <= 8")
def nearest_neighbours(spark, sf):
    return metrics.nearest(embed_cloud(spark, sf), 8).select("raw_index", "neighbour", F.col("nth").cast("long").alias("nth"))


@query(f"""{SMALL}, {KNN} SELECT round(count(*) / (8.0 * (SELECT count(*) FROM cloud)), 6) AS recall FROM near
 JOIN ordered a USING (raw_index) JOIN ordered b ON b.raw_index = other WHERE nth <= 8 AND abs(a.rank - b.rank) <= 32""")
def recall_k_window(spark, sf):
    return _named(metrics.recall_in_window(_small(spark, sf), 8, 64))


LEX = "lex AS (SELECT raw_index, row_number() OVER (ORDER BY x, y, z, raw_index) - 1 AS q FROM cloud)"
TAU = f"""{SMALL}, {LEX}, pq AS (SELECT rank AS p, q FROM ordered JOIN lex USING (raw_index)),
 c AS (SELECT count(*) FILTER (a.q < b.q) AS concordant, count(*) FILTER (a.q > b.q) AS discordant
  FROM pq a JOIN pq b ON a.p < b.p)"""


@query(f"{TAU} SELECT *, round((concordant - discordant) / (concordant + discordant), 6) AS tau FROM c")
def kendall_tau(spark, sf):
    cloud = embed_cloud(spark, sf)
    lex = order_cloud(cloud, OrderingConfig(method="lexicographic")).ordered
    n = table(spark, sf, "embeddings").count()
    return _named(metrics.kendall_tau(order_cloud(cloud, HILBERT).ordered, lex, n))


@query(f"{TAU} SELECT concordant, discordant FROM c")
def kendall_tau_merged(spark, sf):
    cloud = embed_cloud(spark, sf)
    lex = order_cloud(cloud, OrderingConfig(method="lexicographic")).ordered
    n = table(spark, sf, "embeddings").count()
    up, down = metrics.kendall_tau_big(order_cloud(cloud, HILBERT).ordered, lex, n)
    return spark.createDataFrame([(up, down)], "concordant long, discordant long")


@query(f"""{HILB}, g AS (SELECT count(*) AS c FROM keyed GROUP BY key) SELECT sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT
 AS duplicated, max(c) AS largest_group, count(*) AS groups FROM g""")
def dup_key_mass(spark, sf):
    return metrics.duplicate_mass(keyed(lineitem_points(spark, sf), HILBERT)[0], "key")


@query(f"""{HILB}, g AS (SELECT key, count(*) AS c, count(DISTINCT (x, y, z)) AS kinds FROM keyed GROUP BY key)
 SELECT count(*) FILTER (c > 1 AND kinds = 1) AS duplicate_groups, count(*) FILTER (kinds > 1) AS mixed_groups,
 max(c) AS largest_group, max(kinds) AS most_kinds FROM g""")
def shared_key_split(spark, sf):
    groups = keyed(lineitem_points(spark, sf), HILBERT)[0].groupBy("key", "x", "y", "z").count()
    by_key = groups.groupBy("key").agg(F.sum("count").alias("c"), F.count("*").alias("kinds"))
    return by_key.agg(
        F.count_if((F.col("c") > 1) & (F.col("kinds") == 1)).alias("duplicate_groups"),
        F.count_if(F.col("kinds") > 1).alias("mixed_groups"),
        F.max("c").alias("largest_group"),
        F.max("kinds").alias("most_kinds"),
    )


@query(f"""{WITH}, {cells_sql(TEN)} SELECT count(*) AS n,
 {", ".join(f"count(*) FILTER (q{c} IN (0, 1023)) AS boundary_{c}, count(*) FILTER ({c} <= l{c} OR {c} >= h{c}) AS saturated_{c}" for c in "xyz")}
 FROM cells, box""")
def quant_diagnostics(spark, sf):
    cells, about = keyed(lineitem_points(spark, sf), UNIFORM)
    counts = []
    for k, c in enumerate("xyz"):
        lo, hi = float(about["lo"][k]), float(about["hi"][k])
        counts += [
            F.count_if(F.col(f"q{c}").isin(0, 1023)).alias(f"boundary_{c}"),
            F.count_if((F.col(c) <= lo) | (F.col(c) >= hi)).alias(f"saturated_{c}"),
        ]
    return cells.agg(F.count("*").alias("n"), *counts)


@query(f"""{HILB} SELECT round(sum(0.25 * x + 0.5 * y + z), 3) AS checksum, count(*) AS n FROM ordered""")
def block_checksum(spark, sf):
    return _ordered(spark, sf).agg(
        _r(F.sum(0.25 * F.col("x") + 0.5 * F.col("y") + F.col("z")), 3).alias("checksum"), F.count("*").alias("n")
    )


# --- robust statistics ------------------------------------------------------------------------------------------

K = robust.MAD_FACTOR


@query(f"""WITH {CLOUD_SQL}, m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM cloud)
 SELECT round(any_value(mx), 6) AS mx, round(any_value(my), 6) AS my, round(any_value(mz), 6) AS mz,
 round(median(abs(x - mx)) * {K}, 6) AS sx, round(median(abs(y - my)) * {K}, 6) AS sy,
 round(median(abs(z - mz)) * {K}, 6) AS sz FROM cloud, m""")
def median_mad(spark, sf):
    got = robust.axis_medians(lineitem_points(spark, sf), "x", "y", "z")
    names = {f"{p}v{k}": f"{p}{c}" for p in "ms" for k, c in enumerate("xyz")}
    return _named(_one_row(spark, {b: got[a] for a, b in names.items()}))


PILOT = f"""m AS (SELECT quantile_disc(x, 0.5) AS mx, quantile_disc(y, 0.5) AS my, quantile_disc(z, 0.5) AS mz FROM cloud),
 s AS (SELECT greatest(list_sort([median(abs(x - mx)), median(abs(y - my)), median(abs(z - mz))])[2] * {K}, 1e-12) AS scale
  FROM cloud, m)"""


@query(f"""WITH {CLOUD_SQL}, {PILOT}, c AS (SELECT count(*) AS n, count(*) FILTER (sqrt((x - mx) ** 2 + (y - my) ** 2
 + (z - mz) ** 2) / scale > 5.2) AS far FROM cloud, m, s) SELECT n, far, round(far / n, 6) AS share,
 round(least(greatest(1 - 1.5 * (far / n), 0.5), 0.9), 6) AS alpha, round(scale, 6) AS scale, mx, my, mz FROM c, m, s""")
def pilot_alpha(spark, sf):
    row = _one_row(spark, robust.pilot_far_points(lineitem_points(spark, sf)))
    alpha = F.least(F.greatest(1 - 1.5 * F.col("share"), F.lit(0.5)), F.lit(0.9))
    return row.select("n", "far", _r("share").alias("share"), _r(alpha).alias("alpha"), _r("scale").alias("scale"), "mx", "my", "mz")


@query(f"""WITH {CLOUD_SQL} SELECT {", ".join(f"round(covar_samp({a}, {b}), 4) AS c{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))},
 {", ".join(f"round(avg({a}), 9) AS m{a}" for a in "xyz")} FROM cloud""")
def sample_cov(spark, sf):
    return lineitem_points(spark, sf).agg(
        *(_r(F.covar_samp(a, b), 4).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")),
        *(_r(F.avg(a), 9).alias(f"m{a}") for a in "xyz"),
    )


@query(f"""WITH {CLOUD_SQL} SELECT raw_index, rank() OVER (PARTITION BY cloud_id ORDER BY x)
 + (count(*) OVER (PARTITION BY cloud_id, x) - 1) / 2.0::DOUBLE AS mid_rank FROM cloud""")
def average_rank(spark, sf):
    rank = F.rank().over(Window.partitionBy("cloud_id").orderBy("x"))
    ties = F.count("*").over(Window.partitionBy("cloud_id", "x"))
    return lineitem_cloud(spark, sf).select("raw_index", (rank + (ties - 1) / F.lit(2.0)).alias("mid_rank"))


def _mid_ranks(cloud: DataFrame) -> DataFrame:
    """Mid-ranks of each axis from counts of its values: windows over distinct values of a cloud_id."""
    for c in "xyz":
        counts = cloud.groupBy("cloud_id", c).agg(F.count("*").alias("c"))
        below = F.sum("c").over(Window.partitionBy("cloud_id").orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        ranks = counts.select("cloud_id", c, (F.coalesce(below, F.lit(0)) + (F.col("c") + 1) / 2).alias(f"r{c}"))
        cloud = cloud.join(ranks, ["cloud_id", c])
    return cloud


@query(f"""WITH {CLOUD_SQL}, r AS (SELECT cloud_id, {", ".join(f"rank() OVER (PARTITION BY cloud_id ORDER BY {c}) + (count(*) OVER (PARTITION BY cloud_id, {c}) - 1) / 2.0::DOUBLE AS r{c}" for c in "xyz")} FROM cloud)
 SELECT cloud_id, round(corr(rx, ry), 6) AS xy, round(corr(rx, rz), 6) AS xz, round(corr(ry, rz), 6) AS yz FROM r GROUP BY 1""")
def spearman_start(spark, sf):
    ranks = _mid_ranks(lineitem_points(spark, sf).select("cloud_id", "x", "y", "z"))
    return ranks.groupBy("cloud_id").agg(*(_r(F.corr(f"r{a}", f"r{b}")).alias(a + b) for a, b in ("xy", "xz", "yz")))


def _mad_sql(v: str, name: str) -> str:
    return f"{name}m AS (SELECT median({v}) AS m FROM z), {name} AS (SELECT median(abs({v} - m)) * {K} AS s FROM z, {name}m)"


@query(f"""WITH {CLOUD_SQL}, m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM cloud),
 sc AS (SELECT median(abs(x - mx)) * {K} AS sx, median(abs(y - my)) * {K} AS sy, median(abs(z - mz)) * {K} AS sz FROM cloud, m),
 z AS (SELECT x / sx AS x, y / sy AS y, z / sz AS z FROM cloud, sc),
 {", ".join(_mad_sql(f"({a} + {b})", f"u{a}{b}") + ", " + _mad_sql(f"({a} - {b})", f"d{a}{b}") for a, b in ("xy", "xz", "yz"))}
 SELECT {", ".join(f"round((u{p}.s * u{p}.s - d{p}.s * d{p}.s) / 4, 6) AS {p}" for p in ("xy", "xz", "yz"))}
 FROM {", ".join(f"u{p}, d{p}" for p in ("xy", "xz", "yz"))}""")
def gk_pairwise(spark, sf):
    cloud = lineitem_points(spark, sf)
    n = cloud.count()
    row = robust.axis_medians(cloud, "x", "y", "z", n=n)
    z = {c: F.col(c) / row[f"sv{k}"] for k, c in enumerate("xyz")}
    pairs = ("xy", "xz", "yz")
    spread = robust.axis_medians(cloud, *(z[a] + z[b] for a, b in pairs), *(z[a] - z[b] for a, b in pairs), n=n)
    return _named(_one_row(spark, {p: (spread[f"sv{k}"] ** 2 - spread[f"sv{k + 3}"] ** 2) / 4 for k, p in enumerate(pairs)}))


@query()
def robust_frames(spark, sf):
    """Batch mode: a frame for each supplier's cloud by three estimators."""
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.sort_values("raw_index")[["x", "y", "z"]].to_numpy()
        rows = []
        for name in ("det_mcd", "ogk", "mrcd"):
            f = robust.fit_frame(points, name)
            rows.append((int(pdf["cloud_id"].iloc[0]), name, f["policy"], len(points), *map(float, f["center"]), *map(float, f["half"])))
        return pd.DataFrame(rows, columns=["cloud_id", "estimator", "policy", "n", "cx", "cy", "cz", "hx", "hy", "hz"])

    schema = "cloud_id long, estimator string, policy string, n long, cx double, cy double, cz double, hx double, hy double, hz double"
    return lineitem_cloud(spark, sf).groupBy("cloud_id").applyInPandas(one, schema)


@query()
def robust_hilbert_order(spark, sf):
    return order_cloud(lineitem_cloud(spark, sf), OrderingConfig(estimator="ogk")).ordered


@query()
def det_mcd_hilbert_order(spark, sf):
    """The default: six concentrated starts; as aggregates beyond ``ordering.GATHERED`` points."""
    return order_cloud(embed_cloud(spark, sf), OrderingConfig()).ordered


@query()
def robust_morton_order(spark, sf):
    return order_cloud(lineitem_cloud(spark, sf), OrderingConfig(method="robust_morton", estimator="ogk", bits="hybrid")).ordered


@query()
def pca_hilbert_order(spark, sf):
    return order_cloud(lineitem_cloud(spark, sf), OrderingConfig(method="pca_hilbert", bits="occupancy")).ordered


@query()
def batch_orders(spark, sf):
    return ordering.order_clouds(embed_cloud(spark, sf), OrderingConfig())


@query()
def refined_orders(spark, sf):
    return ordering.order_clouds(embed_cloud(spark, sf), OrderingConfig(method="hilbert", bits="uniform", refinement="all"))


@query(f"""{SMALL} SELECT true AS shorter, count(*) AS n, count(DISTINCT raw_index) AS points, min(raw_index) AS least,
 max(raw_index) AS greatest FROM ordered""")
def refined_in_blocks(spark, sf):
    """The path over blocks of ranks is never longer and still visits every point once."""
    plain = _small(spark, sf)
    n = plain.count()
    better = refine.refine_big(plain, n, 128, 2)
    long = metrics.miad(plain).first()["miad"]
    facts = better.agg(
        F.count("*").alias("n"), F.countDistinct("raw_index").alias("points"), F.min("raw_index").alias("least"),
        F.max("raw_index").alias("greatest"),
    )
    short = metrics.miad(better).select((F.col("miad") <= long).alias("shorter"))
    return short.join(F.broadcast(facts))  # one row each


ASKED = """asked AS (SELECT 'w' || lpad(i::VARCHAR, 4, '0') AS query_id, CASE i % 3 WHEN 0 THEN 0.015625 WHEN 1 THEN 0.0625 ELSE 0.25 END AS share, raw_index
  FROM range(256) t(i), box, cloud WHERE raw_index = (i * n) // 256),
 windows AS (SELECT query_id, x - share * (hx - lx) AS min_x, y - share * (hy - ly) AS min_y, z - share * (hz - lz) AS min_z,
  x + share * (hx - lx) AS max_x, y + share * (hy - ly) AS max_y, z + share * (hz - lz) AS max_z FROM asked JOIN cloud USING (raw_index), box)"""


def _asked(cloud: DataFrame) -> DataFrame:
    """256 windows around evenly spread points, of three sizes in turn."""
    box = cloud.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}{c}") for c in "xyz" for k, f in (("l", F.min), ("h", F.max))))
    n = box.first()["n"]
    chosen = cloud.sparkSession.range(256).select(F.col("id").alias("i"), F.expr(f"id * {n} div 256").alias("raw_index"))
    share = F.when(F.col("i") % 3 == 0, 0.015625).when(F.col("i") % 3 == 1, 0.0625).otherwise(0.25)
    rows = cloud.join(F.broadcast(chosen), "raw_index").join(F.broadcast(box))  # 256 rows and one
    edge = lambda c, sign: (F.col(c) + sign * share * (F.col(f"h{c}") - F.col(f"l{c}")))
    sides = [edge(c, s).alias(f"{k}_{c}") for k, s in (("min", -1), ("max", 1)) for c in "xyz"]
    return rows.select(F.format_string("w%04d", "i").alias("query_id"), *sides)


@query(f"""WITH {CLOUD_SQL}, {BOX_SQL}, {ASKED}, hits AS (SELECT q.query_id, count(*) AS c FROM cloud p JOIN windows q ON {INSIDE} GROUP BY 1)
 SELECT query_id, coalesce(c, 0) AS result_count, true AS oracle_match FROM windows LEFT JOIN hits USING (query_id)""")
def frozen_workflow(spark, sf):
    """A workload frozen with the digests of a full scan, written, read back, and answered from stored pages."""
    from lodestone.plans import workload

    cloud = lineitem_cloud(spark, sf)
    windows = cut(_asked(cloud), "asked")  # read again and again
    path = fresh_path(spark, "frozen")
    workload.write_frozen(windows, workload.result_digests(layout.full_scan(cloud, windows), windows), path)
    done = workload.answered(stored_layout(cloud, sf), workload.read_frozen(spark, path))
    return done.select("query_id", "result_count", "oracle_match")
