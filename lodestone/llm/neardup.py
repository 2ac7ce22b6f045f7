"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star edges.

1. Each document's set of word shingles is hashed once.  The hashes fall into ``BANDS * ROWS`` bins and each
   bin keeps its least; an empty bin copies the first non-empty one in a random order of its own, the same
   for all documents.
2. Documents with equal sets become one node.  Nodes that agree in all rows of a band share a bucket.
3. In each bucket the node that shares buckets with most others is the centre (the text that a group was copied
   from agrees with its copies more often than they do with each other), and the others are compared with
   it: a bucket of n gives n - 1 candidates.  Candidates are confirmed on the full sets.
4. Components are formed.  A bucket whose nodes beyond its centres still lie in several components may hide
   a link, so further centres follow there (1, then 8, 64, ... of them), only across components, until each
   pair in a bucket is compared, known to be in one component, or known to be no link by one of two bounds:
   one minus the similarity is a distance, so two nodes whose distances to the first centre differ by more than
   the greatest distance of a link cannot be linked; and an intersection holds at most the fewer of the two nodes'
   shingles that the centre has, and the fewer of those that neither the centre has nor one undecided node alone.
   A node with more than a fifth of its shingles to itself is done.  No bucket is capped.

Shingles are 64-bit hashes and a set's name is a 128-bit hash of them.  With 32 bands of 6 rows a pair of
similarity 0.8 shares no bucket with probability 6e-5, one of 0.85 with 1e-6.

Defined results
* A-Z are lowered, other letters are not; words are runs of anything but the six ASCII white-space characters;
* fewer words than a shingle has: the whole sequence is the one shingle; no words or a null text: an empty set,
  linked with nothing; very long texts are taken whole;
* repeated rows: each gets a row, equal doc_ids are one document, and texts of one doc_id are linked;
* rows with a null doc_id are documents of their own, named by their texts (equal texts are repeated rows); they reach
  the least id of their component, or null if it has none, and then the one of least name is kept;
* an empty table gives no rows;
* other columns, whatever their names, are not read, and :func:`deduplicate` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, columns_of, cut, give_back, slices, unique
from lodestone.llm.components import connected_components

#: Bands and rows of a signature; words in a shingle; least similarity in percent.
BANDS, ROWS, WORDS, PERCENT = 32, 6, 5, 80
#: Word hashes a worker remembers: bounds its memory.
REMEMBERED = 1 << 19
#: Keys (8 to 24 bytes each) that are broadcast at most; more of them are shuffled.
BROADCAST = 1 << 20


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED and len(word) <= 64:
            self[word] = h
        return h


def _mixed(h):
    """Finaliser of SplitMix64 over an array of unsigned 64-bit integers."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int, known: dict):
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at ASCII
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, n)
    width = min(n, words)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : n - width + 1 + k]
    return np.unique(_mixed(out))


class Sketcher:
    """Signatures by one permutation hashing with optimal densification."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        import numpy as np

        self.bands, self.rows, self.bins = bands, rows, bands * rows
        cell = np.arange(self.bins * self.bins, dtype=np.uint64)
        # the order in which an empty bin looks at the others
        self.order = _mixed(cell + np.uint64(0x632BE59BD9B4E019)).reshape(self.bins, self.bins)
        self.none = np.uint64(0xFFFFFFFFFFFFFFFF)

    def signature(self, hashes):
        import numpy as np

        h = _mixed(hashes + np.uint64(0x2545F4914F6CDD1D))
        place = ((h >> np.uint64(40)) * np.uint64(self.bins) >> np.uint64(24)).astype(np.int64)
        out = np.full(self.bins, self.none)
        np.minimum.at(out, place, h & np.uint64(0xFFFFFFFFFF))
        empty = np.flatnonzero(out == self.none)
        if len(empty):
            full = np.flatnonzero(out != self.none)
            out[empty] = out[full[self.order[np.ix_(empty, full)].argmin(axis=1)]]
        return out

    def buckets(self, signatures):
        """Bucket of each band, for a stack of signatures; a band's number is part of its buckets."""
        import numpy as np

        parts = signatures.reshape(-1, self.bands, self.rows)
        out = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for k in range(self.rows):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
        return out.view(np.int64)


def _name(hashes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def text_name() -> Column:
    """What names a row whose doc_id is null: a hash of its text, empty for a null text; null for other rows."""
    name = F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b""))
    return F.when(F.col("doc_id").isNull(), name).alias("name")


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """row, doc_id, name, n_shingles, node (name of the set, null if empty) and buckets; one pass, no shuffle.

    Row numbers hold once they are written.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        known, sketcher = _WordHashes(), Sketcher()
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            counts, names, found = [], [], []
            for text in batch.column("text"):
                h = shingles(text.as_py(), words, known)
                counts.append(len(h))
                names.append(_name(h) if len(h) else None)
                if len(h):
                    found.append(sketcher.signature(h))
            buckets = sketcher.buckets(np.array(found, np.uint64)).ravel() if found else np.empty(0, np.int64)
            sizes = np.where(np.array(counts, np.int64) > 0, sketcher.bands, 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(batch)), pa.int64()),
                    batch.column("doc_id"),
                    batch.column("name"),
                    pa.array(counts, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets)),
                ],
                names=["row", "doc_id", "name", "n_shingles", "node", "buckets"],
            )
            row += len(batch)
            del batch, found, buckets
            give_back()

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, name binary, n_shingles long, node binary, buckets array<long>"
    return docs.select("doc_id", "text", text_name()).mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """node and set (its sorted hashes as bytes) of every document."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in slices(batches):
            sets = [shingles(t.as_py(), words, known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_name, sets), pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())],
                names=["node", "set"],
            )
            del batch, sets
            give_back()

    return docs.select("text").mapInArrow(run, "node binary, set binary")


def _few(keys: DataFrame) -> DataFrame:
    """``keys``, marked to be broadcast if they are counted to be few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes with what their full sets share, their distance, and whether 100 |A & B| >= percent |A or B|.

    Only sets that stand in a pair are dealt out.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches):
            linked, apart, shared = [], [], []
            for a, b in zip(batch.column("a"), batch.column("b")):
                a = np.frombuffer(a.as_buffer(), np.uint64)
                b = np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
                apart.append(1 - both / (len(a) + len(b) - both))
                shared.append(both)
            columns = [pa.array(shared, pa.int64()), pa.array(apart, pa.float64()), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), *columns], names=["u", "v", "both", "apart", "linked"]
            )
            del batch, columns
            give_back()

    pairs = cut(pairs, "pairs")
    side = lambda k, s: sets.toDF(k, s).join(_few(pairs.select(k).distinct()), k, "left_semi")
    both = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b")
    return both.mapInArrow(run, "u long, v long, both long, apart double, linked boolean")


def exclusive(sets: DataFrame) -> DataFrame:
    """id and the number of its shingles that no other of the sets holds, where there are any."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for k, s in zip(batch.column("id").to_pylist(), batch.column("set")):
                h = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k)), pa.array(h)], names=["id", "shingle"])

    held = sets.mapInArrow(run, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return held.filter("n = 1").groupBy("id").agg(F.count("*").alias("own"))


def link_nodes(docs: DataFrame, found: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Components (node, component), by id, of the ``nodes`` (id, node, rep, n, buckets) that have a link."""
    in_bucket = Window.partitionBy("bucket")
    met = cut(
        nodes.select("id", "n", F.explode("buckets").alias("bucket"))
        .withColumn("size", F.count("*").over(in_bucket))
        .filter("size > 1"),
        "buckets",
    )
    mates = met.groupBy("id").agg(F.sum("size").alias("mates"))
    foremost = in_bucket.orderBy(F.desc("mates"), F.xxhash64("id"), "id")
    shared = cut(
        met.join(mates, "id").select("id", "n", "bucket", F.row_number().over(foremost).alias("nth")), "ranked-buckets"
    )
    ids = shared.select("id").distinct()
    chosen = cut(nodes.select("id", "node", "rep").join(_few(ids), "id", "left_semi"), "shared-nodes")
    texts = docs.select("doc_id", "text").join(_few(chosen.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    # no doc_id leads to the nodes whose documents have none
    sets = full_sets(texts, words).union(full_sets(docs.filter("doc_id is null"), words))
    sets = sets.join(_few(chosen.select("node", "id")), "node").groupBy("id").agg(F.any_value("set").alias("set"))
    sets = cut(sets, "sets")
    # texts of one doc_id belong together, whatever they say
    by_id = found.filter("node is not null").groupBy("doc_id").agg(F.min("node").alias("p"), F.max("node").alias("q"))
    several = found.join(by_id.filter("p <> q").select("doc_id"), "doc_id").select("doc_id", "node").distinct()
    several = several.join(nodes.select("node", "id"), "node").select("doc_id", "id")
    first_id = several.groupBy("doc_id").agg(F.min("id").alias("v"))
    links = several.join(first_id, "doc_id").filter("id <> v").select(F.col("id").alias("u"), "v")
    left, first, last, greatest = shared, 1, 1, 1 - percent / 100 + 1e-9
    while True:
        seen = ["component", "apart", "both", "rest"] if first > 1 else []
        side = lambda t: left.select(  # noqa: E731, B023
            "bucket", *(F.col(c).alias(f"{c}_{t}") for c in ["n", "nth", *seen]), F.col("id").alias(t)  # noqa: B023
        )
        # a set much smaller than the other cannot be similar enough
        possible = 100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")
        possible &= F.col("nth_u") > F.col("nth_v")
        if first > 1:
            possible &= F.coalesce(F.abs(F.col("apart_u") - F.col("apart_v")) <= greatest, F.lit(True))
            inside, beyond = F.when(F.col("both_u") < F.col("both_v"), F.col("both_u")).otherwise(F.col("both_v")), lambda t: F.col(f"rest_{t}") - F.col(f"both_{t}")
            most = F.coalesce(inside + F.least(beyond("u"), beyond("v")), F.least("rest_u", "rest_v"))
            possible &= (100 + percent) * most >= percent * (F.col("n_u") + F.col("n_v"))
            possible &= F.col("component_u") != F.col("component_v")
        centres = side("v").filter(F.col("nth_v").between(first, last))
        pairs = side("u").join(centres.withColumnRenamed("bucket", "at"), (F.col("bucket") == F.col("at")) & possible)
        tested = cut(compared(pairs.select("u", "v").distinct(), sets, percent), "compared")
        # with the stars found so far in place of the links that made them
        reached = cut(connected_components(links.union(tested.filter("linked").select("u", "v"))), "components")
        links = reached.select(F.col("node").alias("u"), F.col("component").alias("v"))
        if first == 1:
            centre = shared.filter("nth = 1").select("bucket", F.col("id").alias("v"))
            known = tested.select(F.col("u").alias("id"), "v", "both", "apart")
            left = shared.filter("nth > 1").join(centre, "bucket").join(known, ["id", "v"], "left")
        component = reached.select(F.col("node").alias("id"), "component")
        beyond = left.drop("component").filter(F.col("nth") > last).join(component, "id", "left")
        left = _undecided(beyond.withColumn("component", F.coalesce("component", "id")))
        if left.isEmpty():
            return reached
        if first == 1:
            held = left.select("id").union(left.select("v")).distinct()
            own = exclusive(sets.join(_few(held), "id", "left_semi"))
            left = left.join(own, "id", "left").withColumn("rest", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
            left = _undecided(left.filter(100 * F.col("rest") >= percent * F.col("n")))
            if left.isEmpty():
                return reached
        first, last = last + 1, last * 8


def _undecided(left: DataFrame) -> DataFrame:
    """The rows in buckets that hold several components."""
    several = left.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"))
    return cut(left.join(several.filter("p <> q").select("bucket"), "bucket", "left_semi"), "beyond")


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The columns of :func:`classes`, and the names of rows whose doc_id is null."""
    found = cut(sketches(docs, words), "sketches")
    nodes = cut(
        found.filter("node is not null")
        .groupBy("node")
        .agg(
            F.min("row").alias("id"),
            F.min("doc_id").alias("rep"),
            F.min("name").alias("least_name"),
            F.any_value("n_shingles").alias("n"),
            F.any_value("buckets").alias("buckets"),
        ),
        "nodes",
    )
    reached = link_nodes(docs, found, nodes, words, percent)
    joined = nodes.select("node", "id", "rep", "least_name").join(reached.withColumnRenamed("node", "id"), "id", "left")
    joined = joined.withColumn("component", F.coalesce("component", "id"))
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("least_name").alias("kept_name"))
    names = joined.join(least, "component").select("node", "component_id", "kept_name")
    alone = F.col("node").isNull()
    by_name = F.col("name").eqNullSafe(F.col("kept_name"))
    by_id = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "name", "n_shingles", "node").join(names, "node", "left").select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(True)).when(F.col("component_id").isNull(), by_name).otherwise(by_id).alias("kept"),
        "name",
    )


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept of every document."""
    return _classes(docs, words, percent).drop("name")


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each class, the one of least doc_id, with its columns; of repeated rows one stays."""
    key, full, nth = unique("key"), unique("full"), unique("nth")
    named = lambda name: F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.hex(name)).alias(key)
    kept = _classes(docs, words, percent).filter("kept")
    # of a doc_id whose texts are words or none, only a text whose class it stands for
    kept = kept.groupBy(named("name")).agg(F.max(F.col("n_shingles") > 0).alias(full))
    # dealt by the key once, for the row number and for the join
    once = Window.partitionBy(key, full).orderBy(F.xxhash64("text"))
    words_in_it = F.coalesce("text", F.lit("")).rlike(WORD).alias(full)
    rows = docs.select("*", named(text_name()), words_in_it)
    rows = rows.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1)
    return rows.join(kept, [key, full], "left_semi").select(*columns_of(docs))
