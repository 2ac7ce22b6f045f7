"""Pages, their directory of boxes, and exact window queries.

A page is 128 ranks.  A window query joins the windows with the directory, a table 128 times smaller than
the points, and then only candidate pages with their points, which are checked exactly.  Windows are a
broadcast side behind a check of their number; more are asked in turns of that many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.store import cut
from lodestone.schema import PAGE

AXES = ("x", "y", "z")
#: Windows broadcast at once.
WINDOWS_AT_ONCE = 10_000
#: Pairs of a file and a window that it may answer, broadcast at once.
PAIRS = 1_000_000


def with_pages(ordered: DataFrame, page: int = PAGE) -> DataFrame:
    return ordered.withColumn("page_id", F.expr(f"rank div {page}"))


def page_directory(paged: DataFrame, *more: Column) -> DataFrame:
    """Box and number of points of every page, and what ``more`` says of it."""
    return paged.groupBy("page_id").agg(
        *(F.min(a).alias(f"min_{a}") for a in AXES),
        *(F.max(a).alias(f"max_{a}") for a in AXES),
        F.count("*").alias("valid_count"),
        *more,
    )


def page_checksum() -> Column:
    """Combined hashes of a page's records: any changed, lost, repeated or added one changes it."""
    h = F.xxhash64("rank", "raw_index", "key", *AXES)
    # the hashes' sum from the sums of their halves: a decimal for each page, not for each record
    high, low = (F.sum(half).cast("decimal(20,0)") for half in (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))))
    return (high * F.lit(1 << 32).cast("decimal(10,0)") + low).cast("decimal(38,0)").alias("checksum")


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def contains(q: str = "q") -> Column:
    """The closed box of window ``q`` holds the point."""
    return _every([F.col(a).between(F.col(f"{q}.min_{a}"), F.col(f"{q}.max_{a}")) for a in AXES])


def intersects(q: str = "q", p: str = "p") -> Column:
    return _every(
        [
            (F.col(f"{q}.max_{a}") >= F.col(f"{p}.min_{a}")) & (F.col(f"{q}.min_{a}") <= F.col(f"{p}.max_{a}"))
            for a in AXES
        ]
    )


def checked_windows(windows: DataFrame) -> DataFrame:
    """The windows, or an error: bounds must be finite and ordered, ids present and unique."""
    bounds = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
    sound = _every([F.col(b).isNotNull() & ~F.isnan(b) & (F.abs(b) < float("inf")) for b in bounds])
    sound = sound & _every([F.col(f"min_{a}") <= F.col(f"max_{a}") for a in AXES]) & (F.col("query_id") != "")
    row = windows.agg(
        F.count("*").alias("n"),
        F.countDistinct("query_id").alias("ids"),
        F.count_if(~F.coalesce(sound, F.lit(False))).alias("bad"),
    ).first()
    if row["bad"] or row["ids"] != row["n"]:
        raise ValueError(f"windows: {row['bad']} unsound, {row['n'] - row['ids']} repeated ids")
    return windows


def _in_turns(windows: DataFrame, ask) -> DataFrame:
    n = checked_windows(windows).count()
    if n <= WINDOWS_AT_ONCE:
        return ask(F.broadcast(windows.alias("q")))
    turns = -(-n // WINDOWS_AT_ONCE) * 2
    parts = [windows.filter(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == k) for k in range(turns)]
    return reduce(DataFrame.unionByName, [ask(F.broadcast(p.alias("q"))) for p in parts])


def full_scan(points: DataFrame, windows: DataFrame) -> DataFrame:
    """(query_id, raw_index): each point against each window."""
    ask = lambda q: points.join(q, contains()).select("query_id", "raw_index")
    return _in_turns(windows, ask)


def candidates(directory: DataFrame, windows: DataFrame) -> DataFrame:
    """(query_id, page_id, valid_count, bounds): pages whose box a window meets."""
    bounds = [f"q.{m}_{a}" for m in ("min", "max") for a in AXES]
    ask = lambda q: directory.alias("p").join(q, intersects()).select(
        "query_id", "page_id", "valid_count", *bounds
    )
    return _in_turns(windows, ask)


def pruned_query(paged: DataFrame, directory: DataFrame, windows: DataFrame) -> DataFrame:
    """(query_id, raw_index) by candidate pages, each point checked exactly.

    Of a stored layout only the files are opened that hold a candidate page; within them row groups are skipped by page.
    Its points meet the windows of their file, which are few enough to be broadcast, so that no point is shuffled: a window
    that holds a point meets the box of its page.  Of more than ``PAIRS`` files and windows the points are dealt by page.
    """
    found = candidates(directory, windows)
    if "file_id" in paged.columns:
        bounds = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
        asked = found.groupBy(_file_of(F.col("page_id"), directory).alias("file_id"), "query_id", *bounds).agg(
            F.min("page_id").alias("first"), F.max("page_id").alias("last")
        )
        pages = asked.agg(F.collect_set("file_id"), F.min("first"), F.max("last"), F.count("*")).first()
        files = sorted(pages[0])  # a number for each file that is needed
        paged = paged.filter(F.col("file_id").isin(files) & F.col("page_id").between(pages[1] or 0, pages[2] if files else -1))
        if pages[3] <= PAIRS:
            return paged.join(F.broadcast(asked.alias("q")), "file_id").filter(contains()).select("query_id", "raw_index")
    return paged.join(found.alias("q"), "page_id").filter(contains()).select("query_id", "raw_index")


def _file_of(page: Column, directory: DataFrame) -> Column:
    """The file of a page: the directory's pages carry how many of them a file holds."""
    each = directory.select("pages_per_file").first()
    return F.floor(page / F.lit(each[0] if each else 1)).cast("long")


def query_counters(paged: DataFrame, directory: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidate pages, pages read, records examined, logical bytes and matches of every window."""
    pages = candidates(directory, windows).groupBy("query_id").agg(
        F.count("*").alias("candidate_pages"), F.sum("valid_count").alias("records_examined")
    )
    hits = pruned_query(paged, directory, windows).groupBy("query_id").agg(F.count("*").alias("result_count"))
    none = F.lit(0).cast("long")
    return (
        windows.select("query_id")
        .join(pages, "query_id", "left")
        .join(hits, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("candidate_pages", none).alias("candidate_pages"),
            F.coalesce("candidate_pages", none).alias("pages_read"),
            F.coalesce("records_examined", none).alias("records_examined"),
            (F.coalesce("candidate_pages", none) * 4096).alias("logical_bytes"),
            F.coalesce("result_count", none).alias("result_count"),
        )
    )


def directory_violations(paged: DataFrame, directory: DataFrame) -> DataFrame:
    """Points outside their page's box: none in a sound layout."""
    inside = _every([F.col(a).between(F.col(f"min_{a}"), F.col(f"max_{a}")) for a in AXES])
    return paged.join(directory, "page_id").filter(~inside)


def write_layout(ordered: DataFrame, path: str, pages_per_file: int = 8192) -> None:
    """Points as Parquet, ``pages_per_file`` whole pages in each file, and their directory of boxes and checksums.

    A file's pages are a folder of its own, so a reader that knows its pages opens no other file.
    """
    if pages_per_file < 1:
        raise ValueError("a file has a page at least")
    paged = with_pages(ordered).withColumn("file_id", F.expr(f"page_id div {pages_per_file}"))
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = paged.repartitionById(parts, (F.col("file_id") % parts).cast("int"))  # evenly, without a sample
    dealt.sortWithinPartitions("file_id", "rank").write.partitionBy("file_id").parquet(f"{path}/points", compression="zstd")
    directory = page_directory(paged, page_checksum()).withColumn("pages_per_file", F.lit(pages_per_file).cast("long"))
    # written before it is sorted, whose sample would make it twice
    directory = cut(directory, "directory")
    directory.repartitionByRange("page_id").sortWithinPartitions("page_id").write.parquet(f"{path}/directory")


def read_layout(spark, path: str) -> tuple[DataFrame, DataFrame]:
    kind = "rank long, raw_index long, key long, x double, y double, z double, page_id long, file_id long"
    return spark.read.schema(kind).parquet(f"{path}/points"), spark.read.parquet(f"{path}/directory")


def damaged_pages(points: DataFrame, directory: DataFrame) -> DataFrame:
    """(page_id, stored, found): pages whose records, read back, differ from the directory in number, box or checksum."""
    bounds = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
    facts = lambda d, name: d.select("page_id", F.struct("valid_count", "checksum", *bounds).alias(name))
    both = facts(directory, "stored").join(facts(page_directory(points, page_checksum()), "found"), "page_id", "full_outer")
    return both.filter(~F.col("stored").eqNullSafe(F.col("found")))


def smoke_windows(points: DataFrame) -> DataFrame:
    """Four windows: the whole box, the middle within 5 percent, one point exactly, and one outside."""
    spark = points.sparkSession
    b = points.agg(
        F.count("*").alias("n"), *(F.min(a).alias(f"lo_{a}") for a in AXES), *(F.max(a).alias(f"hi_{a}") for a in AXES)
    ).first()
    middle = points.filter(F.col("raw_index") == b["n"] // 2).first()
    lo, hi = [b[f"lo_{a}"] for a in AXES], [b[f"hi_{a}"] for a in AXES]
    mid = [(x + y) / 2 for x, y in zip(lo, hi)]
    near = [0.05 * (y - x) for x, y in zip(lo, hi)]
    far = [y + (y - x) + 1 for x, y in zip(lo, hi)]
    rows = [
        ("bbox_all", *lo, *hi),
        ("center_local", *(m - n for m, n in zip(mid, near)), *(m + n for m, n in zip(mid, near))),
        ("point_exact", *(middle[a] for a in AXES), *(middle[a] for a in AXES)),
        ("outside_empty", *far, *(f + 1 for f in far)),
    ]
    from lodestone.schema import WINDOWS

    return spark.createDataFrame(rows, WINDOWS)


def workload(lo: list[float], hi: list[float], seed: int, n: int = 256) -> list[tuple]:
    """Seeded windows: a third each of 1/32, 1/8 and 1/2 of the box's extents, the first third one more."""
    import random

    draw = random.Random(seed)
    third = n // 3
    counts = ((1 / 32, n - 2 * third), (1 / 8, third), (1 / 2, third))
    rows = []
    for share, count in counts:
        for _ in range(count):
            size = [(h - x) * share for x, h in zip(lo, hi)]
            at = [x + draw.random() * max(h - x - s, 0.0) for x, h, s in zip(lo, hi, size)]
            rows.append((f"w{seed}_{len(rows):04d}", *at, *(a + s for a, s in zip(at, size))))
    return rows
