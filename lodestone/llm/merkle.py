"""Merkle manifest of a dataset: a tree for each source, a tree over their roots, and a proof for each row.

A leaf is the digest of a row's fields.  Within a source leaves ascend by doc_id; every ``ARITY`` consecutive nodes
become their digest until one remains, the source's subroot; the subroots, ordered by source, become the root likewise.

Trees are reduced in superblocks: nodes are dealt to buckets of ``ARITY ** LEVELS`` consecutive ones, a bucket's
levels are collapsed in one group, and the bucket roots are the nodes of the next stage.  A group never holds more
than a bucket, however many rows one source has, and the number of stages grows with the logarithm.
Proofs come back down the stages: a bucket's upper proof meets the bucket's nodes, and the lower part is put before it.
Only bucket roots and their proofs are kept on the way, a row for each bucket.

A node's place in its tree comes from a range sort: a (part, tree) run's first row and the length of earlier
runs of the tree are a small table, so no window ever holds a tree.

Defined results
* a null field is spelled ``-``, so it differs from an empty text; null doc_ids come first in their source, and for
  tampering a null doc_id counts as the text "";
* a null source is a source of its own, before all others;
* rows with one doc_id are ordered by their leaves, so equal rows give the same tree in any order;
* a source of one row: the leaf is its subroot; one source only: its subroot is the root;
* very long texts are digested whole, in the JVM; an empty table gives no rows;
* other columns are not part of a leaf, and :func:`prove` passes on those that it is asked for.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Nodes that become one; levels that a bucket collapses at once.
ARITY, LEVELS = 3, 7
#: Fields of a row that its leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PLACE_BITS = 33


def spelled(value: Column) -> Column:
    """Byte count, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(spelled, values)), 256)


def digest_of(run: list[str]) -> str:
    """The digest of digests, which go in as hex text, one after another."""
    return hashlib.sha256("".join(run).encode()).hexdigest()


def tree_key(source: Column) -> Column:
    """A source's name as a key that is never null and sorts as the sources do, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def numbered(nodes: DataFrame, order: list[Column], what: str) -> DataFrame:
    """``nodes`` with ``idx``, a row's place in its ``tree`` when sorted by ``order``."""
    sort = [F.col("tree"), *order]
    placed = nodes.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # written once: places stay, whatever bounds another sampling would give
    placed = cut(placed.withColumn("_at", F.monotonically_increasing_id()), what)
    placed = placed.withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    runs = placed.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", "tree", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx")
    return placed.join(runs, ["_part", "tree"]).select(*nodes.columns, place)


def levels_of(nodes: list[str], bucket: int, arity: int, levels: int) -> list[list[str]]:
    """The nodes and what they become, level by level.

    The first bucket is a whole tree if it is not full: then one node remains.  All others lose ``levels`` levels, so a
    last bucket of one node is digested as often as its neighbours are.
    """
    whole = bucket == 0 and len(nodes) < arity**levels
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        at = out[-1]
        out.append([digest_of(at[k : k + arity]) for k in range(0, len(at), arity)])
    return out


def reduce_trees(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """Stages of (tree, idx, node): the nodes, the roots of their buckets, and so on, up to one node for each tree."""

    def collapse(key: tuple, bucket: pd.DataFrame) -> pd.DataFrame:
        found = levels_of(bucket.sort_values("idx")["node"].tolist(), key[1], arity, levels)
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "node": found[-1]})

    stages = [nodes]
    while len(stages) == 1 or not stages[-1].filter("idx > 0").isEmpty():
        by_bucket = stages[-1].select("tree", "idx", "node").groupBy("tree", _bucket(arity, levels))
        roots = by_bucket.applyInPandas(collapse, "tree string, idx long, node string")
        stages.append(cut(roots, "bucket-roots"))
    return stages


def _bucket(arity: int, levels: int) -> Column:
    return F.floor(F.col("idx") / F.lit(arity**levels)).cast("long").alias("_bucket")


def proofs(stages: list[DataFrame], above: DataFrame, passed: str, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The first stage's nodes with their proofs: ``left`` and ``right`` hold, for each level, the siblings before and
    after, one digest after another.

    ``above`` has a row for each tree: (tree, idx 0, left, right, subroot, root), the part of the proof that lies above it.
    ``passed`` is the schema of further columns of the first stage.
    """
    import pyarrow as pa

    ways = pa.list_(pa.string())

    def run(extra: list[str]):
        def meet(key: tuple, nodes: pa.Table, upper: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("idx")
            found = levels_of(nodes.column("node").to_pylist(), key[1].as_py(), arity, levels)
            up = upper.to_pylist()[0]
            before, after = [], []
            for level in found[:-1]:
                first = [k - k % arity for k in range(len(level))]
                before.append(["".join(level[a:k]) for k, a in enumerate(first)])
                after.append(["".join(level[k + 1 : a + arity]) for k, a in enumerate(first)])
            steps = [arity**k for k in range(len(before))]
            n = len(nodes)
            left = [[b[k // s] for b, s in zip(before, steps)] + up["left"] for k in range(n)]
            right = [[b[k // s] for b, s in zip(after, steps)] + up["right"] for k in range(n)]
            out = {c: nodes.column(c) for c in ("tree", "idx", "node", *extra)}
            out |= {"left": pa.array(left, ways), "right": pa.array(right, ways)}
            return pa.table(out | {c: pa.array([up[c]] * n, pa.string()) for c in ("subroot", "root")})

        return meet

    top = F.col("idx").alias("_bucket")
    for k in range(len(stages) - 2, -1, -1):
        schema = "tree string, idx long, node string" + (f", {passed}" if passed and not k else "")
        extra = [x.split()[0] for x in passed.split(",")] if passed and not k else []
        by_bucket = stages[k].select("tree", "idx", "node", *extra).groupBy("tree", _bucket(arity, levels))
        met = by_bucket.cogroup(above.groupBy("tree", top)).applyInArrow(
            run(extra), schema + ", left array<string>, right array<string>, subroot string, root string"
        )
        above = cut(met, "bucket-proofs") if k else met
    return above


def prove(docs: DataFrame, leaf: Column | None = None, passed: dict[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """leaf, left, right, subroot and root of every row, and the columns that ``passed`` names."""
    passed = passed or {}
    leaf = digest(*map(F.col, FIELDS)) if leaf is None else leaf
    rows = docs.select(
        tree_key(F.col("source")).alias("tree"),
        F.col("doc_id").alias("_order"),
        leaf.alias("node"),
        *(c.alias(f"_passed{k}") for k, c in enumerate(passed.values())),
    )
    kinds = dict(rows.dtypes)
    leaves = numbered(rows, [F.col("_order").asc_nulls_first(), F.col("node")], "leaves")
    stages = reduce_trees(leaves, arity, levels)
    subroots = stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    top = reduce_trees(numbered(subroots, [F.col("name")], "subroots"), arity, levels)
    none = F.array().cast("array<string>")
    above = top[-1].select(
        "tree", "idx", none.alias("left"), none.alias("right"), F.lit("").alias("subroot"), F.col("node").alias("root")
    )
    above = proofs(top, above, "name string", arity, levels)
    above = above.select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "left", "right", F.col("node").alias("subroot"), "root"
    )
    extra = ", ".join(f"_passed{k} {kinds[f'_passed{k}']}" for k in range(len(passed)))
    found = proofs(stages, cut(above, "source-proofs"), extra, arity, levels)
    return found.select(
        *(F.col(f"_passed{k}").alias(c) for k, c in enumerate(passed)),
        F.col("node").alias("leaf"), "left", "right", "subroot", "root",
    )


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    levels = F.arrays_zip(left.alias("l"), right.alias("r"))
    return F.aggregate(levels, leaf, lambda at, x: F.sha2(F.concat(x["l"], at, x["r"]), 256))


def proof_digest(left: Column, right: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(left, right, lambda a, b: F.concat(a, b)), ""), 256)


def tampered_leaf() -> Column:
    """The leaf of a row whose text lost its line feeds, where 2 divides the CRC of the decimal doc_id; else the row's own."""
    hit = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    fields = [F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text")) if c == "text" else F.col(c) for c in FIELDS]
    return digest(*fields)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    found = prove(docs, passed={"doc_id": F.col("doc_id"), "altered": tampered_leaf()})
    way = F.col("left"), F.col("right")
    return found.select(
        "doc_id", "leaf", "subroot", "root",
        proof_digest(*way).alias("proof_sha256"),
        fold(F.col("altered"), *way).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def duckdb_sql(source_levels: int = 12, top_levels: int = 6) -> str:
    """The same rows for up to 3 ** source_levels rows of a source and 3 ** top_levels sources."""
    said = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(said(text if c == "text" else c) for c in FIELDS) + ")"
    # crc32 of a decimal doc_id, bit by bit: only its parity is asked for
    parts = [
        f"""rows_ AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS leaf,
  CASE WHEN crc % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS altered
  FROM (SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen(coalesce(doc_id::VARCHAR, ''))),
    lambda i: ascii(substr(doc_id::VARCHAR, (i + 1)::INTEGER, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x % 2 = 1
      THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc_, xor(crc_, 4294967295) AS crc FROM documents))""",
        "s0 AS MATERIALIZED (SELECT r, source, leaf AS node, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM rows_)",
        "ns0 AS (SELECT source, idx, node FROM s0)",
    ]
    run = "string_agg(node, '' ORDER BY idx)"

    def grow(p: str, key: str, n: int) -> None:
        for k in range(n):
            parts.append(
                f"n{p}{k + 1} AS MATERIALIZED (SELECT {key}, idx // 3 AS idx, "
                f"CASE WHEN max(most) = 0 THEN any_value(node) ELSE sha256({run}) END AS node FROM "
                f"(SELECT *, max(idx) OVER (PARTITION BY {key}) AS most FROM n{p}{k}) GROUP BY {key}, idx // 3)"
            )

    def climb(p: str, key: str, who: str, n: int) -> None:
        for k in range(n):
            parts.append(
                f"""c{p}{k + 1} AS MATERIALIZED (SELECT c.{who}, c.{key}, c.idx // 3 AS idx,
  c.proof || coalesce(string_agg(o.node, '' ORDER BY o.idx) FILTER (o.idx <> c.idx), '') AS proof,
  c.steps || CASE WHEN any_value(o.most) = 0 THEN [] ELSE [struct_pack(
    a := coalesce(string_agg(o.node, '' ORDER BY o.idx) FILTER (o.idx < c.idx), ''),
    b := coalesce(string_agg(o.node, '' ORDER BY o.idx) FILTER (o.idx > c.idx), ''))] END AS steps
  FROM c{p}{k} c JOIN (SELECT *, max(idx) OVER (PARTITION BY {key}) AS most FROM n{p}{k}) o
    ON o.{key} IS NOT DISTINCT FROM c.{key} AND o.idx // 3 = c.idx // 3 GROUP BY c.{who}, c.{key}, c.idx, c.proof, c.steps)"""
            )

    grow("s", "source", source_levels)
    parts.append(
        f"t0 AS MATERIALIZED (SELECT source AS who, 1 AS one, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx "
        f"FROM ns{source_levels})"
    )
    parts.append("nt0 AS (SELECT one, idx, node FROM t0)")
    grow("t", "one", top_levels)
    none = "'' AS proof, []::STRUCT(a VARCHAR, b VARCHAR)[] AS steps"
    parts.append(f"cs0 AS (SELECT r, source, idx, {none} FROM s0)")
    climb("s", "source", "r", source_levels)
    parts.append(f"ct0 AS (SELECT who, one, idx, {none} FROM t0)")
    climb("t", "one", "who", top_levels)
    return f"""WITH {", ".join(parts)},
done AS (SELECT d.doc_id, d.leaf, u.node AS subroot, z.node AS root, sha256(s.proof || t.proof) AS proof_sha256,
  list_reduce(list_prepend(struct_pack(a := d.altered, b := ''), s.steps || t.steps),
    lambda x, y: struct_pack(a := sha256(y.a || x.a || y.b), b := '')).a AS folded_root
  FROM rows_ d JOIN cs{source_levels} s USING (r) JOIN t0 u ON u.who IS NOT DISTINCT FROM d.source
  JOIN ct{top_levels} t ON t.who IS NOT DISTINCT FROM d.source, nt{top_levels} z)
SELECT *, folded_root = root AS verified FROM done"""
