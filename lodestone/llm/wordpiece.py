"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie.  Where a node has no child for the next byte, the automaton pops the pieces
that greedy longest-match-first would have taken from what it has read, adds their precomputed number and
follows the failure link to the node of what remains.  Each byte is read once, no piece is built, and the
time is linear in the text whatever the words.

Words are maximal runs of anything but the six ASCII white-space characters; each is counted with the
vocabulary's word prefix before it.  A word with a byte that the vocabulary cannot spell counts as one
unknown token.

Defined results
* null or empty text: no words, no tokens; very long words take linear time and no more memory;
* repeated rows are counted each; an empty table gives no rows;
* other columns are not read; the result has the counts beside doc_id.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

#: Words remembered by a worker, then forgotten and started anew: bounds its memory.
REMEMBERED = 1 << 18
#: Marks that stand alone after a word.
_MARKS = frozenset(".,;:!?")
#: Longer words are not remembered.
REMEMBERED_BYTES = 64


class Automaton:
    """Trie with failure links and numbers of popped pieces."""

    def __init__(self, vocabulary: Iterable[bytes]):
        child: dict[int, int] = {}
        parents: list[tuple[int, int]] = [(0, 0)]
        final: list[bool] = [False]
        for piece in vocabulary:
            node = 0
            for b in piece:
                key = node << 8 | b
                nxt = child.get(key)
                if nxt is None:
                    nxt = child[key] = len(parents)
                    parents.append((node, b))
                    final.append(False)
                node = nxt
            final[node] = node != 0
        n = len(parents)
        below: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            below[parents[node][0]].append(node)
        fail, pops = [-1] * n, [0] * n
        queue = deque(below[0])
        while queue:  # breadth first: links lead to shorter strings
            node = queue.popleft()
            queue.extend(below[node])
            if final[node]:
                fail[node], pops[node] = 0, 1
                continue
            up, b = parents[node]
            link, popped = fail[up], pops[up]
            while link >= 0 and (link << 8 | b) not in child:
                popped += pops[link]
                link = fail[link]
            if link >= 0:
                fail[node], pops[node] = child[link << 8 | b], popped
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        """Pieces of greedy longest-match-first; 1 for a word that cannot be spelled."""
        child, fail, pops = self.child, self.fail, self.pops
        node = n = 0
        for b in word:
            nxt = child.get(node << 8 | b)
            while nxt is None:
                link = fail[node]
                if link < 0:
                    return 1
                n += pops[node]
                node = link
                nxt = child.get(node << 8 | b)
            node = nxt
        while node:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def split_chunk(chunk: str, find) -> tuple | list:
    """Pieces of a run of white space and the text after it, as the splitting pattern ``find`` has them.

    Words, and words with one mark after them, are told without the pattern.
    """
    first = chunk[0]
    body = chunk[1:] if first == " " or first == "\n" else chunk
    if body.isalpha():
        return ("\n", body) if first == "\n" else (chunk,)
    if first != "\n" and body[-1:] in _MARKS and body[:-1].isalpha():
        return chunk[:-1], chunk[-1]
    return find(chunk)


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a rank file: base64 piece, space, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def count_tokens(docs: DataFrame, vocabulary: Iterable[bytes], word_prefix: bytes = b" ") -> DataFrame:
    """doc_id, n_words and n_tokens of every document; one pass, no shuffle.

    The vocabulary is broadcast: its size is the file's and does not grow with the documents.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(list(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        known: dict[bytes, int] = {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = automaton.count(word_prefix + w)
                        if len(w) <= REMEMBERED_BYTES:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[w] = n
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
