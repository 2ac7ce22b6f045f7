"""Connected components of a link table, by alternating large stars and small stars.

Nodes are any orderable type.  A large star links every larger neighbour of a node to the least node it sees;
a small star does so for the smaller ones.  Both are a grouped minimum (summed up before the shuffle) and a
join, so a node with very many links is never gathered in one task, and the rounds needed grow with
the logarithm of the graph.  Each round ends in a table in the shared folder, and rounds end when every link
leads to the least node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one link and no lesser end is the larger end of another."""
    ends = edges.select(F.col("u").alias("end"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    by_end = ends.groupBy("end").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by_end.filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v): the least node that it reaches.

    Links are undirected; loops, repeats and nulls are ignored.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = cut(edges.filter("u is not null and v is not null and u <> v").distinct(), "links")
    while not _is_forest_of_stars(edges):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(least.select("u", "m").toDF("u", "v")).distinct(), "stars")
    # each node but the least of its component has one link, to that least node
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()
    )
