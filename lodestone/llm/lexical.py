"""Ranked lexical search by sort-based accumulation.

Documents are read once for the query terms they hold; what is kept of a document is its number of terms and its
matched (term, times) pairs.  Counts over all documents give each term's weight.  Blocks of documents are then
scored: the (item, document, impact) triples of all matched terms are laid out in arrays, their packed keys are
radix-sorted, ``reduceat`` adds up each key's impacts, and a heap for each item keeps its best documents.  The heaps
of all tasks meet in a range partitioning by (item, score, document): each part keeps the first documents of the items in it,
so that however many tasks there were, an item's last selection sees a few rows from each part it touches.

All scores are 64-bit integers and ties go to the lower doc_id, so results do not depend on how rows are dealt.

The items' terms are broadcast, at most ``MOST_TERMS`` (item, term) pairs at a time; more items are dealt into rounds
by hash, each of which reads the documents again.

Defined results
* null or empty text: no terms, never ranked, and not counted among the documents;
* an item without terms, or whose terms no document holds, gives no rows; an empty table gives no rows;
* very long texts are read whole; a document has at most as many triples as there are broadcast pairs;
* repeated documents are ranked each; a null doc_id comes last among equal scores;
* repeated items are one item, and the texts of different items with one item_id are added up; a null item_id is an item;
* other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Documents kept for each item.
TOP = 20
#: (item, term) pairs broadcast at once; (item, document, impact) triples sorted at once.
MOST_TERMS, TRIPLES = 1 << 21, 1 << 21
#: What a null doc_id counts as in a heap: after all others.
_LAST = 1 << 63

#: Letters, digits and whatever is not ASCII make terms; other characters part them.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of all items."""
    import pyarrow as pa

    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [Counter(terms_of(t.as_py())) for t in batch.column("text")]
            places = [k for k, c in enumerate(counted) for _ in c]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id").take(pa.array(places, pa.int64())),
                    pa.array([w for c in counted for w in c], pa.binary()),
                    pa.array([n for c in counted for n in c.values()], pa.int64()),
                ],
                names=["item_id", "term", "times"],
            )

    found = items.select("item_id", "text").distinct().mapInArrow(run, f"item_id {kind}, term binary, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def matched_terms(docs: DataFrame, terms) -> DataFrame:
    """doc_id, n (terms of the document), terms (places in the broadcast list) and times, where n is above 0."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        place = {t: k for k, t in enumerate(terms.value)}.get
        for batch in batches:
            sizes, found, times, ends = [], [], [], [0]
            for text in batch.column("text"):
                words = terms_of(text.as_py())
                sizes.append(len(words))
                kinds, counts = np.unique([k for k in map(place, words) if k is not None], return_counts=True)
                found.append(kinds)
                times.append(counts)
                ends.append(ends[-1] + len(kinds))
            lists = [
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x).astype(np.int32) if x else []))
                for x in (found, times)
            ]
            got = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"]
            )
            yield got.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


def term_weights(n_docs: int, holding):
    """floor(1000 ln((2 N + 2) / (2 df + 1))) by term."""
    import numpy as np

    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)


def radix_order(keys, low: int, bits: int):
    """The order of the keys by their bits from ``low`` up to ``bits``, 16 at a time from the least; equal ones stay as they are."""
    import numpy as np

    order = None
    for at in range(low, max(bits, low + 1), 16):
        digit = (keys >> np.uint64(at)).astype(np.uint16)
        by_digit = np.argsort(digit if order is None else digit[order], kind="stable")  # a radix sort for 16 bits
        order = by_digit if order is None else order[by_digit]
    return order


class Accumulator:
    """Scores blocks of documents against all items and keeps each item's best in a heap."""

    def __init__(self, n_items: int, starts, items, times, weights, n_docs: int, n_terms: int, top: int):
        # the items that hold term t, and how often: items[starts[t]:starts[t + 1]], times[...]
        self.starts, self.items, self.times, self.weights = starts, items, times, weights
        self.n_docs, self.n_terms, self.top = n_docs, n_terms, top
        self.item_bits = max(1, (n_items - 1).bit_length())
        self.heaps: dict[int, list] = {}

    def triples(self, term):
        return self.starts[term + 1] - self.starts[term]

    def add(self, doc_ids: list, sizes, ends, term, tf) -> None:
        """Documents with their sizes; term and tf of document k are at ends[k]:ends[k + 1]."""
        import numpy as np

        m = 75 + (25 * sizes * self.n_docs) // self.n_terms
        doc = np.repeat(np.arange(len(sizes)), np.diff(ends))
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        held = self.triples(term)
        total = int(held.sum())
        if not total:
            return
        place = np.arange(total) + np.repeat(self.starts[term] - (np.cumsum(held) - held), held)
        bits = max(1, (len(sizes) - 1).bit_length())
        keys = self.items[place] << np.uint64(bits) | np.repeat(doc, held).astype(np.uint64)
        impacts = np.repeat(impact, held) * self.times[place]
        # triples are laid out by document, so the lower digits are in order and a stable sort of the item's will do
        order = radix_order(keys, bits, bits + self.item_bits)
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1)))
        scores = np.add.reduceat(impacts[order], first)
        item = (keys[first] >> np.uint64(bits)).astype(np.int64)
        doc = (keys[first] & np.uint64((1 << bits) - 1)).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self.select(int(item[a]), scores[a:b], doc[a:b], doc_ids)

    def select(self, item: int, scores, docs, doc_ids: list) -> None:
        import numpy as np

        heap = self.heaps.setdefault(item, [])
        least = heap[0][0] if len(heap) == self.top else 1
        if len(scores) > self.top:
            least = max(least, np.partition(scores, -self.top)[-self.top])
        at = np.flatnonzero(scores >= least)
        for score, k in zip(scores[at].tolist(), docs[at].tolist()):
            d = doc_ids[k]
            entry = (score, -(_LAST if d is None else d))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)

    def best(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in self.heaps.items():
            for score, d in heap:
                yield item, (None if d == -_LAST else -d), score


def task_tops(matched: DataFrame, shared, kind: str, top: int) -> DataFrame:
    """(item_id, doc_id, score): each task's best documents of each item."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        item_ids, *about = shared.value
        accumulator = Accumulator(len(item_ids), *about, top)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            terms, times = batch.column("terms"), batch.column("times")
            ends = terms.offsets.to_numpy().astype(np.int64)
            ends, base = ends - ends[0], int(ends[0])
            term = terms.values.to_numpy()[base : base + int(ends[-1])]
            base = int(times.offsets[0].as_py())
            tf = times.values.to_numpy()[base : base + int(ends[-1])].astype(np.int64)
            upto = np.append(0, np.cumsum(accumulator.triples(term)))[ends]
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + TRIPLES, side="right")) - 1)
                part = slice(int(ends[a]), int(ends[b]))
                accumulator.add(doc_ids[a:b], sizes[a:b], ends[a : b + 1] - ends[a], term[part], tf[part])
                a = b
        rows = list(accumulator.best())
        yield pa.RecordBatch.from_arrays(
            [
                item_ids.take(pa.array([r[0] for r in rows], pa.int64())),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()),
            ],
            names=["item_id", "doc_id", "score"],
        )

    return matched.select("doc_id", "n", "terms", "times").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def ranked(tops: DataFrame, kind: str, top: int) -> DataFrame:
    """item_id, rank, doc_id, score: the best of all tasks' best."""
    import pyarrow as pa

    order = [F.col("item_id"), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        item, taken = None, 0
        for batch in batches:  # sorted
            keep = np.zeros(len(batch), bool)
            for k, x in enumerate(batch.column("item_id").to_pylist()):
                if not taken or x != item:
                    item, taken = x, 0
                keep[k] = taken < top
                taken += 1
            yield batch.filter(pa.array(keep))

    parted = tops.repartitionByRange(*order).sortWithinPartitions(*order)
    parted = parted.mapInArrow(first, f"item_id {kind}, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(*order[1:]))
    return parted.select("item_id", place.alias("rank"), "doc_id", "score").filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` highest-scoring documents of each item."""
    import numpy as np
    import pyarrow.compute as pc

    spark = docs.sparkSession
    kind = dict(items.dtypes)["item_id"]
    pairs = cut(item_terms(items), "item-terms")
    rounds = max(1, -(-pairs.count() // most_terms))
    tops = None
    for k in range(rounds):
        here = pairs if rounds == 1 else pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k)
        table = here.orderBy("term").toArrow()  # most_terms rows or about as many
        if not len(table):
            continue
        coded = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("term", "item_id")]
        (words, term), (item_ids, item) = [(x.dictionary, x.indices.to_numpy()) for x in coded]
        starts = np.searchsorted(term, np.arange(len(words) + 1))
        matched = cut(matched_terms(docs, spark.sparkContext.broadcast(words.to_pylist())), "matched-terms")
        n_docs, n_terms = matched.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        counted = matched.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        holding = np.zeros(len(words), np.int64)
        holding[counted.column("term").to_numpy()] = counted.column("count").to_numpy()
        times = pc.cast(table.column("times"), "int64").to_numpy()
        about = (starts, item.astype(np.uint64), times, term_weights(n_docs, holding), n_docs, max(n_terms, 1))
        best = task_tops(matched, spark.sparkContext.broadcast((item_ids, *about)), kind, top)
        tops = best if tops is None else tops.union(best)
    if tops is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return ranked(tops, kind, top)


def duckdb_sql(top: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    cut_up = lambda t: (
        rf"unnest(regexp_extract_all(translate({t}, '{upper}', '{upper.lower()}'), "
        r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    )
    return f"""
WITH rows_ AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, {cut_up("text")} AS term FROM rows_),
sizes AS (SELECT r, count(*) AS n FROM words GROUP BY r),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM words GROUP BY r, term),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM
  (SELECT item_id, {cut_up("text")} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
m AS (SELECT r, 75 + (25 * n * big_n) // big_l AS m FROM sizes, totals),
scored AS (
  SELECT item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r),
placed AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS place
  FROM scored JOIN rows_ USING (r) WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM placed WHERE place <= {top}"""
