"""Byte-level BPE: ranked merges folded by higher-order functions over the bytes of distinct words.

The pieces of a text are the matches of the splitting pattern.  They are counted over all documents, and the
commonest, up to a fixed number, are encoded once by the fold and broadcast as a dictionary.  A second pass
replaces them in every text; the pieces of a document that are not in the dictionary go through the same fold
beside it, each distinct one once, so nothing is left out and no text is shuffled.  Only pieces of more than
``HEAPED`` bytes, whose fold would take the square of their length, are merged by the same ranks with a heap.

The rank map is a literal table, a sparse matrix of ranks (left id by right id) with its rows laid over each other,
since a map literal would be searched from its beginning.  Ids are ranks, so the least rank among the neighbouring
pairs is the id they merge into.

Decoding concatenates the binary pieces of the ids.

Defined results
* null or empty text: no ids, the hashes of the empty string; very long texts and pieces are encoded whole;
* repeated rows are encoded each; an empty table gives no rows; special tokens in a text are ordinary text;
* other columns, whatever their names, are passed on by :func:`encode`, but for the names that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate, chain, repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK, ODD_SPACE, cut, let, over_arrays, slices, unique
from lodestone.llm.wordpiece import read_ranks, split_chunk

#: Pieces in the dictionary, and the longest of them in bytes: together they bound what is broadcast.
DICTIONARY, LONGEST = 1 << 20, 32
#: Pieces counted before a worker hands on its counts; chunks a worker remembers, and as many that it used before.
COUNTED, REMEMBERED = 1 << 18, 1 << 17
#: Characters of text cut up at once.
AT_ONCE = 1 << 20
#: Ids spelled and decoded at once.
DIGESTED = 1 << 16
#: Longer pieces are merged with a heap: the fold takes the square of a piece's length.
HEAPED = 512


def chunks(text: str) -> list[str]:
    """A text cut before each run of white space; the splitting pattern joins nothing across these cuts."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or ODD_SPACE.search(text):
        return CHUNK.findall(text)
    # single spaces and line ends: cutting after a mark put before each is faster
    parts = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0") if "\0" not in text else CHUNK.findall(text)
    return parts if parts and parts[0] else parts[1:]


def chunk_keys(text: str) -> list[str]:
    """A key for each of the text's chunks, cheaper to cut than the chunk: it lacks the space that most begin with."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\0" in text or ODD_SPACE.search(text):
        return list(map(_key, chunks(text)))
    keys = text.replace("\n", " \n").split(" ")
    if not keys[0]:
        return keys[1:]
    keys[0] = "\0" + keys[0]
    return keys


def _key(chunk: str) -> str:
    if chunk[0] == " " and chunk[1:2] not in ("\n", "\0"):
        return chunk[1:]
    return chunk if chunk[0] == "\n" else "\0" + chunk


def chunk_of(key: str) -> str:
    """The chunk that a key stands for: one with neither a line end nor a NUL before it lacks its space."""
    return key if key[:1] == "\n" else key[1:] if key[:1] == "\0" else " " + key


class RankMap:
    """The pairs of ids that merge, as a table and as a column expression.

    The rows of the sparse matrix of ranks (left id by right id) are laid over each other, each at the first offset at
    which its entries meet free places: the pair (left, right) stands at the left id's offset plus the right id.
    Within the fold ids are one greater, so that a free place is 0, the shortest literal: two thirds of the table are free.
    """

    #: What stands at a free place: the entry of a left id that cannot be.
    EMPTY = 0
    #: Greater than any id within the fold.
    NONE = 1 << 16

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= self.NONE - 1:
            raise ValueError("ranks above 65534 do not fit the table")
        ranks = {piece: rank + 1 for piece, rank in ranks.items()}
        rows: dict[int, dict[int, int]] = {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    rows.setdefault(left, {})[right] = rank
        room = 2 * self.NONE + 4 * sum(map(len, rows.values()))
        free = (1 << room) - 1  # a bit for each place
        self.offsets, table = [0] * (max(ranks.values()) + 1), {}
        for left in sorted(rows, key=lambda k: (-len(rows[k]), k)):
            fits, here = free, 0
            for right in rows[left]:
                fits &= free >> right
                here |= 1 << right
            offset = (fits & -fits).bit_length() - 1
            free &= ~(here << offset)
            self.offsets[left] = offset
            for right, rank in rows[left].items():
                table[offset + right] = left << 16 | rank
        self.table = [table.get(k, self.EMPTY) for k in range(max(table, default=0) + 1)]
        self.first = [ranks[bytes([b])] for b in range(256)]

    def literals(self) -> tuple[Column, Column, Column]:
        """The table, the offsets and the ids of the 256 bytes, as array literals."""
        listed = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(kind)
        return listed(self.table, "array<bigint>"), listed(self.offsets, "array<int>"), listed(self.first, "array<bigint>")

    def merged(self, table: Column, offsets: Column, left: Column, right: Column) -> Column:
        """The id that two neighbours merge into, or a number of ``NONE`` or more; null where nothing stands."""
        place = (F.get(offsets, left.cast("int")) + right).cast("int")
        # an entry is left id and rank side by side: where the left id agrees, what differs is the rank
        return F.get(table, place).bitwiseXOR(F.shiftleft(left, 16))


def fold_merges(words: Column, ranks: RankMap) -> Column:
    """Ids (one greater while they merge) of each word of an array (of binary): while a pair merges, the leftmost pair of least rank does."""
    table, offsets, first = ranks.literals()
    # each literal stands once in the plan and is bound to a variable
    fold = lambda t, o, f: F.transform(words, lambda w: _fold(w, lambda x, y: ranks.merged(t, o, x, y), f))
    return let(table, lambda t: let(offsets, lambda o: let(first, lambda f: fold(t, o, f))))


def _fold(word: Column, merge, first: Column) -> Column:
    bits = 24  # of a place in a word; rank and place in one number, so the least number is the leftmost least rank

    def step(state: Column, _: Column) -> Column:
        ids = state["ids"]
        rated = F.transform(
            ids,
            lambda x, k: F.shiftleft(merge(x, F.get(ids, k + 1)), bits).bitwiseOR(k.cast("bigint")),
        )
        made = lambda ids, left: F.struct(ids.alias("ids"), F.lit(left).alias("left"))

        def put(least: Column) -> Column:
            place = least.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
            merged = lambda k: F.concat(
                F.slice(ids, F.lit(1), k), F.array(F.shiftright(least, bits)), F.slice(ids, k + 3, F.size(ids))
            )
            return F.when(least < F.lit(RankMap.NONE << bits), made(let(place, merged), True)).otherwise(made(ids, False))

        # the last id has no pair and rates null; once no pair merges, the turns left do nothing
        return F.when(state["left"], let(F.array_min(rated), put)).otherwise(state)

    # one character for each byte
    letters = F.split(F.decode(word, "ISO-8859-1"), "")
    begun = F.struct(F.transform(letters, lambda c: F.get(first, F.ascii(c))).alias("ids"), F.lit(True).alias("left"))
    turns = F.sequence(F.lit(1), F.greatest(F.octet_length(word) - 1, F.lit(1)))
    none = F.array().cast("array<bigint>")
    return F.when(F.octet_length(word) == 0, none).otherwise(F.aggregate(turns, begun, step, lambda s: F.transform(s["ids"], lambda x: x - 1)))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids that the fold gives, in a time that hardly grows faster than the length of the word."""
    import heapq

    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours, by where a part begins
    ends = list(range(1, n + 1))

    def rank(k: int) -> int | None:
        return ranks.get(word[k : ends[after[k]]]) if after[k] < n else None

    heap = [(r, k, ends[after[k]]) for k in range(n) if (r := rank(k)) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, k, end = heapq.heappop(heap)
        if not alive[k] or after[k] >= n or ends[after[k]] != end:
            continue  # one of the two has merged since
        gone = after[k]
        alive[gone], ends[k], after[k] = False, end, after[gone]
        if after[k] < n:
            before[after[k]] = k
        for j in (before[k], k):
            if j >= 0 and (r := rank(j)) is not None:
                heapq.heappush(heap, (r, j, ends[after[j]]))
    return [ranks[word[k : ends[k]]] for k in range(n) if alive[k]]


def count_pieces(docs: DataFrame, pattern: str) -> DataFrame:
    """(piece, n) over all documents: chunks are counted by workers and summed, then each is split once."""
    import pyarrow as pa

    def counted(found: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["piece", "n"]
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                found.update(chunk_keys(text.as_py() or ""))
                if len(found) >= COUNTED:
                    yield counted(found)
                    found.clear()
        yield counted(found)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import defaultdict

        import regex

        split = regex.compile(pattern).findall
        for batch in batches:
            found: defaultdict = defaultdict(int)
            for chunk, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist()):
                for piece in split_chunk(chunk_of(chunk), split):
                    found[piece] += n
            yield counted(found)

    schema = "piece string, n long"
    by_chunk = docs.select("text").mapInArrow(count, schema).groupBy("piece").agg(F.sum("n").alias("n"))
    by_piece = by_chunk.mapInArrow(pieces, schema).groupBy("piece").agg(F.sum("n").alias("n"))
    return by_piece.select(F.col("piece").cast("binary").alias("piece"), "n")


def dictionary(docs: DataFrame, ranks: RankMap, pattern: str, size: int = DICTIONARY):
    """The commonest pieces, ``size`` at most, and their ids as packed numbers: hashes, pieces and ids in the order of the hashes."""
    counted = cut(count_pieces(docs, pattern).filter(F.octet_length("piece") <= LONGEST), "piece-counts")
    left, least = size, 1
    # how many pieces occur how often: as many rows as there are different numbers
    for r in counted.groupBy("n").agg(F.count("*").alias("pieces")).orderBy(F.desc("n")).toLocalIterator():
        left -= r["pieces"]
        if left < 0:
            least = r["n"] + 1
            break
    words = counted.filter(F.col("n") >= least).select("piece", F.xxhash64("piece").alias("hash"), fold_merges(F.array("piece"), ranks)[0].alias("ids"))
    low_first = lambda h: F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2))
    packed = F.unhex(F.array_join(F.transform("ids", lambda i: low_first(F.lpad(F.hex(i), 4, "0"))), ""))
    found = words.select("hash", "piece", packed.alias("ids")).toArrow().sort_by("hash")
    return found["hash"].to_numpy(), found["piece"].combine_chunks(), found["ids"].combine_chunks()


class Pieces:
    """The dictionary in few bytes: pieces in the order of their hashes, many found at once."""

    def __init__(self, hashes, pieces, ids):
        self.hashes, self.pieces, self.ids = hashes, pieces, ids

    def get(self, wanted: list[bytes]) -> list[bytes | None]:
        """Packed ids of each piece, or None."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        if not len(self.hashes) or not wanted:
            return [None] * len(wanted)
        # Spark's xxhash64 of a binary
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, wanted, repeat(42)), np.uint64, len(wanted)).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = pc.equal(self.pieces.take(at), pa.array(wanted, pa.binary()))
        ids = self.ids.take(at)
        ends, packed = np.frombuffer(ids.buffers()[1], np.int32)[: len(ids) + 1].tolist(), ids.buffers()[2].to_pybytes()
        return [packed[a:b] if s else None for s, a, b in zip(same.to_pylist(), ends, ends[1:])]


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for cycles within: what is made there holds none, and the many small lists would set it off again and again."""
    import gc

    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_KEPT: dict = {}


def _once(name: str, make):
    """What ``make`` gives, made once by a worker and kept until another query's is asked for."""
    if _KEPT.get("name") != name:
        _KEPT.clear()
        _KEPT.update(name=name, value=make())
    return _KEPT["value"]


#: What the dictionary gives: packed ids, where the pieces it lacks go, which of ``rare`` each is, and ``rare``.
LOOKED = "found binary, places array<int>, which array<int>, rare array<binary>"


def _look_up(shared, ranks, pattern: str):
    """A function from a column of texts to the columns of ``LOOKED``."""
    import uuid

    import pyarrow as pa

    name = uuid.uuid4().hex

    def run(batch) -> list:
        import numpy as np
        import regex

        split = regex.compile(pattern).findall
        # chunks that come again after they had gone are steady, and stay for long
        pieces, known, before, steady = _once(name, lambda: (Pieces(*shared.value), {}, {}, {}))

        def learn(fresh: list[str]) -> dict[str, list]:
            """Adds the chunks to ``known``; of those with a piece to fold, gives the parts: packed ids, or the piece's bytes."""
            parts = [split_chunk(chunk_of(c), split) for c in fresh]
            wanted = list(dict.fromkeys(chain.from_iterable(parts)))
            raw = list(map(str.encode, wanted))
            found = pieces.get(raw)
            for k, (ids, b) in enumerate(zip(found, raw)):
                if ids is None and len(b) > HEAPED:
                    found[k] = np.array(heap_merges(b, ranks.value), "<u2").tobytes()
            got, spelled, holed = dict(zip(wanted, found)), dict(zip(wanted, raw)), {}
            for c, x in zip(fresh, parts):
                ids = list(map(got.__getitem__, x))
                if None in ids:
                    holed[c] = [(i, spelled[p]) for i, p in zip(ids, x)]
                else:
                    known[c] = ids[0] if len(ids) == 1 else b"".join(ids)
            return holed

        def rows_of(texts: list[str]) -> Iterator[tuple]:
            cut_up = [chunk_keys(t) for t in texts]
            if len(known) >= REMEMBERED:  # what has not been asked for since the last time goes
                before.clear()
                before.update(known)
                known.clear()
                if len(steady) >= REMEMBERED // 2:
                    steady.clear()
                known.update(steady)
            got = [list(map(known.get, x)) for x in cut_up]
            lacking, fresh = [], set()
            for x, found in zip(cut_up, got):
                k, at = -1, []
                for _ in range(found.count(None)):
                    k = found.index(None, k + 1)
                    at.append(k)
                    fresh.add(x[k])
                lacking.append(at)
            again = {c: before[c] for c in fresh if c in before}
            known.update(again)
            steady.update(again)
            holed = learn(list(fresh.difference(again)))
            for x, found, at in zip(cut_up, got, lacking):
                places, which, rare, holes = [], [], {}, []
                for k in at:
                    ids = known.get(x[k])
                    if ids is None:
                        ids = b""
                        for packed, raw in holed[x[k]]:
                            if packed is None:
                                holes.append((k, len(ids)))
                                which.append(rare.setdefault(raw, len(rare)))
                            else:
                                ids += packed
                    found[k] = ids
                if holes:
                    ends = list(accumulate(map(len, found)))
                    places = [(ends[k] - len(found[k]) + at) // 2 for k, at in holes]
                yield b"".join(found), places, which, list(rare)

        rows, texts, size = [], [], 0
        with uncollected():
            for t in batch:
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= AT_ONCE:
                    rows += rows_of(texts)
                    texts, size = [], 0
            rows += rows_of(texts)
        found, places, which, rare = zip(*rows) if rows else ((), (), (), ())
        return [
            pa.array(found, pa.binary()),
            pa.array(places, pa.list_(pa.int32())),
            pa.array(which, pa.list_(pa.int32())),
            pa.array(rare, pa.list_(pa.binary())),
        ]

    return run


def _put_in(found, places, which, folded) -> list[bytes]:
    """Packed ids of each text of a batch: the folded ids at their places among the ones found."""
    import numpy as np

    flat = folded.values  # a list of ids for each rare piece
    edges, ids = flat.offsets.to_numpy(), flat.values.to_numpy().astype("<u2")
    out = []
    for k, begin in enumerate(folded.offsets.to_numpy()[:-1].tolist()):
        packed = found[k].as_py()
        if chosen := which[k].as_py():
            parts, at = [], 0
            for place, w in zip(places[k].as_py(), chosen):
                parts += (packed[2 * at : 2 * place], ids[edges[begin + w] : edges[begin + w + 1]].tobytes())
                at = place
            packed = b"".join([*parts, packed[2 * at :]])
        out.append(packed)
    return out


#: Columns that digests adds.
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digester(ranks: dict[bytes, int]):
    """Packed ids of many texts to the number of each one's, the hash of the ids and the hash of what they decode to."""
    from hashlib import sha256

    import numpy as np
    import pyarrow as pa

    size = max(ranks.values()) + 1
    pieces = [b""] * size
    for piece, i in ranks.items():
        pieces[i] = piece
    # ids as they stand after another, and the pieces that they decode to
    sides = pa.array([b" %d" % i for i in range(size)], pa.binary()), pa.array(pieces, pa.binary())

    def digest(texts: list) -> list[tuple[int, str, str]]:
        ids = [np.frombuffer(t, "<u2") for t in texts]
        hashes = [(sha256(), sha256()) for _ in ids]

        def add(runs: list[tuple[int, int, int]]) -> None:
            flat = pa.array(np.concatenate([ids[k][a:b] for k, a, b in runs]))
            edges = np.cumsum([0, *(b - a for _, a, b in runs)])
            for side, table in enumerate(sides):
                taken = table.take(flat)
                ends = np.frombuffer(taken.buffers()[1], np.int32)[edges].tolist()
                data = memoryview(taken.buffers()[2])
                for (k, a, _), x, y in zip(runs, ends, ends[1:]):
                    hashes[k][side].update(data[x + (side == 0 and a == 0) : y])  # nothing stands before the first id

        runs, held = [], 0
        for k, x in enumerate(ids):
            for a in range(0, len(x), DIGESTED):
                runs.append((k, a, min(a + DIGESTED, len(x))))
                held += runs[-1][2] - a
                if held >= DIGESTED:
                    add(runs)
                    runs, held = [], 0
        if runs:
            add(runs)
        return [(len(x), a.hexdigest(), b.hexdigest()) for x, (a, b) in zip(ids, hashes)]

    return digest


def _digest_arrays(rows: list[tuple]):
    import pyarrow as pa

    counts, ids_hash, text_hash = zip(*rows) if rows else ((), (), ())
    return [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]


def encode(
    docs: DataFrame,
    rank_file: str,
    pattern: str,
    size: int = DICTIONARY,
    with_digests: bool = False,
    passed: list[str] | None = None,
) -> DataFrame:
    """The columns ``passed`` (all) of ``docs`` and ``ids``, those of the text as packed little-endian 16-bit numbers.

    ``with_digests`` adds the columns of :func:`digests`.
    """
    import pyarrow as pa

    context = docs.sparkSession.sparkContext
    vocabulary = read_ranks(rank_file)
    ranks, shared_ranks = RankMap(vocabulary), context.broadcast(vocabulary)
    look_up = _look_up(context.broadcast(dictionary(docs, ranks, pattern, size)), shared_ranks, pattern)
    added = ["ids", *(["n_tokens", "ids_sha256", "decoded_sha256"] if with_digests else [])]
    own = {f"own{k}": c for k, c in enumerate(docs.columns if passed is None else passed) if c not in added}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _digester(shared_ranks.value) if with_digests else None
        for batch in slices(batches):
            packed = _put_in(*map(batch.column, ("found", "places", "which", "folded")))
            columns = [pa.array(packed, pa.binary())]
            if digest:
                columns += _digest_arrays(digest(packed))
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), *columns], names=[*own, *added])

    kept = [F.col("`" + c.replace("`", "``") + "`").alias(k) for k, c in own.items()]
    rows = docs.select(*kept, F.col("text").alias("whole_text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = look_up(batch.column("whole_text"))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, own), *columns], names=[*own, "found", "places", "which", "rare"]
            )

    looked = rows.mapInArrow(look, kinds + LOOKED)
    folded = fold_merges(F.col("rare"), ranks).alias("folded")
    done = looked.select(*own, "found", "places", "which", folded).mapInArrow(run, kinds + "ids binary" + (", " + DIGESTS if with_digests else ""))
    return done.select(*(F.col(k).alias(c) for k, c in own.items()), *added)


def digests(encoded: DataFrame, rank_file: str, *passed: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 from the ids: decoding concatenates their pieces.

    Of the other columns those named in ``passed`` stay.
    """
    import pyarrow as pa

    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_file))

    def run(batches):
        digest = _digester(shared.value)
        for batch in batches:
            rows = digest([packed.as_buffer() for packed in batch])
            yield pa.StructArray.from_arrays(_digest_arrays(rows), names=["n_tokens", "ids_sha256", "decoded_sha256"])

    kept, found = ["doc_id", *passed], unique("digests")
    return encoded.select(*kept, over_arrays(run, DIGESTS, F.col("ids")).alias(found)).select(*kept, f"{found}.*")


def decode(ids: bytes, ranks: dict[bytes, int]) -> bytes:
    """The bytes that packed ids stand for."""
    import numpy as np

    pieces = {i: p for p, i in ranks.items()}
    return b"".join(pieces[i] for i in np.frombuffer(ids, "<u2").tolist())
