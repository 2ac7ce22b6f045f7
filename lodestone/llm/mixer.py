"""LM scoring by online logistic context mixing, beside a word-count base score.

A text (A-Z lowered, an end symbol after it that is no byte) is coded symbol by symbol as the binary decisions of a
Huffman code that depends on the symbol before.  For each decision several predictors, each a table of counts by the
last 1, 3 and 6 symbols and the node of the code, the longer two hashed, give their log odds.  A weight for each
predictor, chosen by a gate (how much the longest context is known), adds them up.  What the mixer gives is refined:
in cells of like strength, the log odds of what came against what was expected so far correct it.  Weights and
cells start anew in each text, are carried through all of it, and are moved against the errors after each
``STEP`` decisions.  The cost of all decisions is the text's code length, so its log10 probability: over all texts
the probabilities add up to one.

Everything the tables hold is counted over all training documents: words and pairs of symbols in a first
pass, the predictors in a second.  The hashed tables grow with the training text up to ``MOST_SLOTS`` slots each, which
bounds what is broadcast; contexts that share a slot share its counts, and the gate and the weights learn how far to
trust them.  A task sends its counts in blocks that are added up as they stream in.

The base score needs the count of every word.  The commonest words, bounded in number and bytes, are broadcast;
for the others a document's (word, times) pairs are joined with the counts and summed up again.

Defined results
* null or empty text: one token, the end; the score is that of the end symbol alone;
* no training documents: no words are known, tables are empty and every decision starts at even odds;
* very long texts are scored whole, in one run of their own; ties do not matter;
* a null doc_id counts as the text ""; repeated rows are counted and scored each; an empty table gives no rows;
* other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut

#: Documents with this remainder are held out.
FOLDS, HELD_OUT = 7, 2
#: Symbols a context looks back, by predictor; blocks the counts are sent in.
LOOKS, BLOCKS = (1, 3, 6), 256
#: Slots of a hashed table: one for so many training symbols, as a power of two between these.
SYMBOLS_A_SLOT, LEAST_SLOTS, MOST_SLOTS = 64, 1 << 16, 1 << 22
#: Bytes worked on at once; words counted before a worker hands on its counts.
AT_ONCE, COUNTED = 400_000, 1 << 18
#: Words whose counts are broadcast, and the bytes they may have together.
COMMON, COMMON_BYTES = 1 << 19, 1 << 24
#: Decisions between two moves of the weights; step of a move; where weights start, by predictor.
STEP, RATE, START = 128, 0.008, (0.3, 0.5, 0.4)
#: Classes of the gate: counts of the longest context from 0, 1, 3 and 12 on.
GATES = (1, 3, 12)
#: Cells of the refinement, by strength of the mixed odds; what a cell is held to have seen before; its share.
CELLS, BELIEF, SHARE = 24, 4.0, 0.5
#: The end of a text, and what stands before its beginning; symbols there are.
END, SYMBOLS = 256, 257
#: Odds are kept in steps of this size, in a byte.
ODDS_STEP = 1 / 14


def held_out(doc_id) -> bool:
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % FOLDS == HELD_OUT


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only


def gathered_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents; a space and a number stand for a pair of symbols, a line feed for the end.

    No word begins with white space, so these keys are free.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        import numpy as np

        words: Counter = Counter()
        pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)

        def batch_of(found: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if held_out(doc_id):
                    continue
                raw = lowered(text.as_py())
                words.update(raw.split())
                words[b"\n"] += 1
                b = np.full(len(raw) + 2, END, np.int32)
                b[1:-1] = np.frombuffer(raw, np.uint8)
                seen = b[:-1] * SYMBOLS + b[1:]
                if len(seen) < 4096:  # short texts: only the pairs that occur
                    kinds, times = np.unique(seen, return_counts=True)
                    pairs[kinds] += times
                else:
                    pairs += np.bincount(seen, minlength=len(pairs))
                if len(words) >= COUNTED:
                    yield batch_of(words)
                    words.clear()
        seen = np.flatnonzero(pairs)
        yield batch_of(words | {b" %d" % k: int(pairs[k]) for k in seen.tolist()})

    counted = docs.select("doc_id", "text").mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Code:
    """Huffman codes of a symbol given the one before: decisions as runs of (node, bit)."""

    def __init__(self, pairs):
        import heapq

        import numpy as np

        lengths = np.zeros(SYMBOLS * SYMBOLS, np.int32)
        starts = np.zeros(SYMBOLS * SYMBOLS, np.int32)
        nodes: list[int] = []
        bits: list[int] = []
        for before in range(SYMBOLS):
            row = pairs[before * SYMBOLS : (before + 1) * SYMBOLS]
            # every symbol can follow; one tenth of an occurrence each keeps the codes of unseen ones short enough
            heap = [(float(n) + 0.1, c, c) for c, n in enumerate(row.tolist())]
            heapq.heapify(heap)
            up: dict[int, tuple[int, int]] = {}
            fresh = SYMBOLS
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                up[a[2]], up[b[2]] = (fresh, 0), (fresh, 1)
                heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
                fresh += 1
            for c in range(SYMBOLS):
                path, at = [], c
                while at in up:
                    at, bit = up[at]
                    path.append((before * 256 + at - SYMBOLS, bit))
                key = before * SYMBOLS + c
                starts[key], lengths[key] = len(nodes), len(path)
                for node, bit in reversed(path):
                    nodes.append(node)
                    bits.append(bit)
        self.lengths, self.starts = lengths, starts
        self.nodes, self.bits = np.array(nodes, np.uint32), np.array(bits, np.uint8)


#: Nodes of all codes: places in the table of the shortest context.
NODES = SYMBOLS * 256


class Decisions:
    """The decisions of several texts, one text after another, and their places in each table."""

    def __init__(self, code: Code, texts: list[bytes], slots: int):
        import numpy as np

        # each text follows as many end symbols as the longest context looks back
        gap = max(LOOKS)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        begins = np.cumsum(sizes + gap) - sizes
        wide = np.full(int((sizes + gap).sum()), END, np.uint32)
        at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        inner = np.ones(len(at), bool)
        inner[np.cumsum(sizes) - 1] = False
        wide[at[inner]] = np.frombuffer(b"".join(texts), np.uint8)
        key = wide[at - 1] * np.uint32(SYMBOLS) + wide[at]
        length = code.lengths[key]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        self.symbol = np.repeat(np.arange(len(at), dtype=np.int32), length)
        place = np.arange(total, dtype=np.int32) + np.repeat((code.starts[key] - (ends - length)).astype(np.int32), length)
        self.node, self.bit = code.nodes[place], code.bits[place]
        first = np.cumsum(sizes) - sizes  # a text has a symbol at least, its end
        edges = np.append((ends - length)[first], total)
        self.text_start, self.text_size = edges[:-1], np.diff(edges)
        self.shift = np.uint32(32 - (slots.bit_length() - 1))
        self.hashes = []
        for look in LOOKS[1:]:
            h = np.zeros(len(at), np.uint32)
            for k in range(1, look + 1):
                h = (h + wide[at - k] + np.uint32(1)) * np.uint32(0x2C1B3C6D)
                h ^= h >> np.uint32(15)
            self.hashes.append(h)

    def slots(self, which: int):
        """Places of all decisions in a table."""
        import numpy as np

        if which == 0:
            return self.node  # the symbol before and the node: no hash needed
        h = self.hashes[which - 1][self.symbol]
        h ^= self.node * np.uint32(0x9E3779B1)
        h *= np.uint32(0x85EBCA6B)
        h >>= self.shift
        return h


def _groups(batch, keep) -> Iterator[tuple[list, list[bytes]]]:
    """Runs of a batch's documents by length, of ``AT_ONCE`` bytes at most; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
    by_length = np.argsort(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), kind="stable")
    rows, texts, size = [], [], 0
    for k in by_length.tolist():
        if keep(ids[k]):
            raw = lowered(column[k].as_py())
            if texts and size + len(raw) > AT_ONCE:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(k)
            texts.append(raw)
            size += len(raw)
    if texts:
        yield rows, texts


def table_slots(symbols: int) -> int:
    """Slots of a hashed table for so many training symbols."""
    return min(max(1 << (symbols // SYMBOLS_A_SLOT).bit_length(), LEAST_SLOTS), MOST_SLOTS)


def packed_tables(docs: DataFrame, code, slots: int) -> DataFrame:
    """(block, odds): for each block of slots, the odds and the gate's class, counted over all training documents."""
    import pyarrow as pa

    size = NODES + (len(LOOKS) - 1) * slots
    width = -(-size // BLOCKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        table = None
        for batch in batches:
            for _, texts in _groups(batch, lambda d: not held_out(d)):
                if table is None:
                    table = np.zeros(2 * width * BLOCKS, np.uint32)
                found, start = Decisions(code.value, texts, slots), 0
                for k in range(len(LOOKS)):
                    key = (found.slots(k).astype(np.int64) + start) * 2 + found.bit
                    np.add.at(table, key, np.uint32(1))
                    start += slots if k else NODES
        if table is not None:
            pack = zstandard.ZstdCompressor(level=1).compress
            for k in range(BLOCKS):
                zeros, ones = table.reshape(-1, 2)[k * width : (k + 1) * width].T
                where = np.flatnonzero(zeros | ones).astype(np.uint32)
                content = np.concatenate([np.diff(where, prepend=np.uint32(0)), zeros[where], ones[where]])
                if len(where):
                    yield pa.RecordBatch.from_pydict(
                        {"block": pa.array([k], pa.int32()), "counts": pa.array([pack(content.tobytes())], pa.binary())}
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict = {}
        for batch in batches:
            for k, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
                where, zeros, ones = np.frombuffer(unpack(counts.as_py()), np.uint32).reshape(3, -1)
                total = sums.setdefault(k, np.zeros((2, width), np.int64))
                where = np.cumsum(where, dtype=np.int64)
                total[0, where] += zeros
                total[1, where] += ones
        for k, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([k], pa.int32()), "odds": pa.array([packed_odds(*total).tobytes()], pa.binary())}
            )

    counted = docs.select("doc_id", "text").mapInArrow(count, "block int, counts binary")
    return counted.repartition(BLOCKS, "block").mapInArrow(add, "block int, odds binary")


def packed_odds(zeros, ones):
    """Log odds of a one, in steps, and the class of how much was seen: a byte each."""
    import numpy as np

    seen = zeros + ones
    odds = np.log((ones + 0.4) / (zeros + 0.4)) * (seen / (seen + 1.0))
    steps = np.clip(np.rint(odds / ODDS_STEP), -127, 127).astype(np.int64) + 128
    return (steps << 8 | np.searchsorted(GATES, seen, side="right")).astype("<u2")


def finished_tables(blocks: DataFrame, slots: int):
    """The packed odds of all tables, one after another."""
    import numpy as np

    size = NODES + (len(LOOKS) - 1) * slots
    width = -(-size // BLOCKS)
    packed = np.full(width * BLOCKS, 128 << 8, "<u2")
    for r in blocks.toLocalIterator():  # BLOCKS rows, two bytes a slot
        packed[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["odds"], "<u2")
    return packed


def text_bits(code: Code, packed, slots: int, texts: list[bytes]):
    """Code length of each text in bits; a text's does not depend on the others."""
    import numpy as np

    found = Decisions(code, texts, slots)
    # the texts' runs of STEP decisions: first all first runs, then all second ones, ...
    lanes = np.argsort(-found.text_size, kind="stable")
    sizes = found.text_size[lanes]
    runs = -(-sizes // STEP)
    turns = int(runs[0]) if len(runs) else 0
    running = np.searchsorted(-runs, -np.arange(turns), side="left")
    lane_of_run = np.concatenate([np.arange(n) for n in running]) if turns else np.empty(0, np.int64)
    turn_of_run = np.repeat(np.arange(turns), running)
    length = np.minimum(sizes[lane_of_run] - turn_of_run * STEP, STEP)
    edges = np.concatenate([[0], np.cumsum(np.bincount(turn_of_run, length, minlength=turns).astype(np.int64))])
    begin = found.text_start[lanes][lane_of_run] + turn_of_run * STEP
    order = np.arange(edges[-1], dtype=np.int32)
    order += np.repeat((begin - (np.cumsum(length) - length)).astype(np.int32), length)
    lane = np.repeat(lane_of_run, length)
    inputs, start = [], 0
    strengths = ((np.arange(256) - 128) * ODDS_STEP).astype(np.float32)
    for k in range(len(LOOKS)):
        got = packed[start : start + (slots if k else NODES)][found.slots(k)[order]]
        inputs.append(strengths[got >> 8])
        start += slots if k else NODES
    gates = len(GATES) + 1
    row = lane * gates + (got & 255)  # the longest context's class chooses the weights
    y = found.bit[order].astype(np.float32)
    weights = [np.full(len(lanes) * gates, w, np.float32) for w in START]
    # ones and, in the higher digits, hits of a cell; ones expected
    counts, hoped = np.zeros((2, len(lanes) * CELLS))
    correction = np.zeros(len(lanes) * CELLS, np.float32)
    cells, digit = lane * CELLS + CELLS // 2, np.float64(1 << 26)
    z = np.empty(len(order), np.float32)
    limit = np.float32(CELLS // 2 - 0.5)
    for t in range(turns):
        part, alive, upto = slice(edges[t], edges[t + 1]), running[t] * gates, running[t] * CELLS
        rows, came, now = row[part], y[part], [x[part] for x in inputs]
        mixed = weights[0][rows] * now[0]
        for w, x in zip(weights[1:], now[1:]):
            mixed += w[rows] * x
        np.clip(mixed, -limit, limit, out=mixed)
        chance = 1 / (1 + np.exp(-mixed))
        cell = cells[part] + mixed.astype(np.int32)
        z[part] = mixed + correction[cell]
        wrong = (came - chance) * np.float32(RATE)
        for w, x in zip(weights, now):
            w[:alive] += np.bincount(rows, wrong * x, alive)
        counts[:upto] += np.bincount(cell, came + digit, upto)
        hoped[:upto] += np.bincount(cell, chance, upto)
        hits, ones = np.divmod(counts[:upto], digit)
        better = (ones + BELIEF) / (hoped[:upto] + BELIEF)
        worse = (hits - ones + BELIEF) / (hits - hoped[:upto] + BELIEF)
        correction[:upto] = SHARE * np.log(better / worse)
    z *= 1 - 2 * y  # the log odds against what came
    cost = np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))  # ln(1 + e^z) in single precision, added up in double
    by_lane = np.bincount(lane, cost, minlength=len(lanes)) / math.log(2)
    return np.bincount(lanes, by_lane, minlength=len(texts))


def score(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, n_bytes, base_score and score of every document."""
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    counted = cut(gathered_words(docs), "word-counts")
    pairs = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    is_word = ~F.col("word").startswith(F.lit(b" "))
    for r in counted.filter(~is_word).toLocalIterator():  # a row for each pair of symbols at most
        pairs[int(r["word"])] = r["n"]
    code = spark.sparkContext.broadcast(Code(pairs))
    slots = table_slots(int(pairs.sum()))
    packed = finished_tables(cut(packed_tables(docs, code, slots), "predictors"), slots)
    words = counted.filter(is_word)
    tokens, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    left, room, least = common, COMMON_BYTES, 1
    by_count = words.groupBy("n").agg(F.count("*").alias("words"), F.sum(F.octet_length("word")).alias("bytes"))
    for r in by_count.orderBy(F.desc("n")).toLocalIterator():
        left, room = left - r["words"], room - r["bytes"]
        if left < 0 or room < 0:
            least = r["n"] + 1
            break
    known = words.filter(F.col("n") >= least).toArrow()
    end = words.filter(F.col("word") == F.lit(b"\n")).first()
    end_log = math.log10((end["n"] if end else 0) + 1)
    shared = spark.sparkContext.broadcast(
        (known.column("word").combine_chunks(), known.column("n").combine_chunks(), packed)
    )
    has_end = 1 if end else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        from pyspark import TaskContext

        names, numbers, packed = shared.value
        logs = dict(zip(names.to_pylist(), np.log10(numbers.to_numpy() + 1.0).tolist()))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = len(batch)
            bits = np.zeros(n)
            n_tokens, n_known, n_bytes, logsum = [0] * n, [0] * n, [0] * n, [0.0] * n
            rare_words, rare_times = [[]] * n, [[]] * n
            for places, texts in _groups(batch, lambda _: True):
                bits[places] = text_bits(code.value, packed, slots, texts)
                for k, raw in zip(places, texts):
                    tokens_here = raw.split()
                    found = list(map(logs.get, tokens_here))
                    if missing := found.count(None):
                        rare = Counter(w for w, v in zip(tokens_here, found) if v is None)
                        rare_words[k], rare_times[k] = list(rare), list(rare.values())
                        found = [v for v in found if v is not None]
                    n_tokens[k] = len(tokens_here) + 1
                    n_known[k] = len(tokens_here) - missing + has_end
                    n_bytes[k] = len(raw)
                    logsum[k] = math.fsum(found) + end_log
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + n), pa.int64()),
                    batch.column("doc_id"),
                    pa.array([held_out(d) for d in batch.column("doc_id").to_pylist()], pa.bool_()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(n_known, pa.int64()),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(logsum, pa.float64()),
                    pa.array(bits * -math.log10(2)),
                    pa.array(rare_words, pa.list_(pa.binary())),
                    pa.array(rare_times, pa.list_(pa.int64())),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "logs", "score", "rare", "times"],
            )
            row += n

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(
        run,
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, n_bytes long, logs double, "
        "score double, rare array<binary>, times array<long>",
    )
    scored = cut(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r"))
    rare = rare.select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    found = (
        rare.join(words, "word")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("times_known"))
    )
    none = F.lit(0)
    return scored.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("times_known", none)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        "n_bytes",
        (
            F.col("logs")
            + F.coalesce("more", F.lit(0.0))
            - F.col("n_tokens") * math.log10(int(tokens) + int(kinds) + 1)
        ).alias("base_score"),
        "score",
    )
