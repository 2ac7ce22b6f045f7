"""Keys of chunks, and digests of many texts at once."""

import random
from hashlib import sha256

import numpy as np

from lodestone.llm import bytebpe


def test_keys_stand_for_the_chunks():
    r = random.Random(1)
    texts = ["".join(r.choice("ab. \n\0\t\x1c ") for _ in range(r.randint(0, 7))) for _ in range(20000)]
    for text in ["", " ", "\n", "a", " a", "\na", "a\nb c ", *texts]:
        assert [bytebpe.chunk_of(k) for k in bytebpe.chunk_keys(text)] == bytebpe.chunks(text), repr(text)


def test_digests_of_many_texts(monkeypatch):
    monkeypatch.setattr(bytebpe, "DIGESTED", 5)
    pieces = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 300}
    back = {i: p for p, i in pieces.items()}
    lists = [[], [97], [256, 300, 32], list(range(23)), [], [300] * 5, [7] * 6]
    found = bytebpe._digester(pieces)([np.array(x, "<u2").tobytes() for x in lists])
    plain = [
        (len(x), sha256(" ".join(map(str, x)).encode()).hexdigest(), sha256(b"".join(back[i] for i in x)).hexdigest())
        for x in lists
    ]
    assert found == plain
    assert bytebpe._digester(pieces)([]) == []
