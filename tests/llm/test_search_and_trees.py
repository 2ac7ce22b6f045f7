"""Merkle manifest and ranked search against plain versions: nulls, empty and long texts, ties, repeated rows, clashes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string, `a.b` string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sample():
    draw = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "été", "x_y", "the", "of", "über", "中文", "😀", "it's", "2024", "ALPHA"]
    make = lambda n: " ".join(draw.choice(words) for _ in range(n))
    texts = [None, "", "\n\n", "one\ntwo", make(5), make(40), make(40) + "\n" + make(3), make(6000), "the the", "alpha\nbeta"]
    rows = []
    for k in range(75):
        t = texts[k] if k < len(texts) else make(draw.randint(1, 30)) + ("\n" if k % 3 else "")
        source = (None, "a", "b", "ß", "a", "a")[k % 6] if k % 25 else "lone"
        rows.append((k, t, "en" if k % 4 else None, source, len(t or "") if k % 5 else None, "clash", "clash", "clash"))
    rows += [rows[20], rows[20], (20, "another", None, "a", 1, "", "", ""), (None, "no id\n", None, "b", None, "", "", "")]
    rows += [(None, "no id\n", None, "b", None, "", "", ""), (900, "the the", None, "only", 7, "", "", "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text):
    spelled = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(spelled, (row[0], row[3], row[2], row[4], text))))


def manifest_by_hand(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    for t in trees.values():
        t.sort(key=lambda x: x[:3])

    def climb(nodes):
        """The root, and for each node its (before, after) by level."""
        ways = [[] for _ in nodes]
        spots = list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(spots):
                first = p - p % 3
                ways[k].append((nodes[first:p], nodes[p + 1 : first + 3]))
            nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
            spots = [p // 3 for p in spots]
        return nodes[0], ways

    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: climb([x[2] for x in trees[s]]) for s in names}
    root, top = climb([made[s][0] for s in names])
    out = []
    for s, above in zip(names, top):
        for (_, _, h, r), way in zip(trees[s], made[s][1]):
            altered = h
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0:
                altered = leaf(r, None if r[1] is None else r[1].replace("\n", ""))
            at = altered
            for before, after in way + above:
                at = sha("".join([*before, at, *after]))
            proof = sha("".join(x for b, a in way + above for x in [*b, *a]))
            out.append((r[0], h, made[s][0], root, proof, at, at == root))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) if i == 0 else (False, x) for i, x in enumerate(r)])


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(docs, levels, monkeypatch):
    from lodestone.llm import merkle

    monkeypatch.setattr(merkle.prove, "__defaults__", (None, None, 3, levels))
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    assert in_order(got) == in_order(manifest_by_hand(sample()))
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_little(spark, docs):
    from lodestone.llm.merkle import fold, manifest, prove

    assert manifest(docs.limit(0)).isEmpty()
    lone = docs.filter("doc_id = 900")
    (r,) = manifest(lone).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == sha("")
    kept = prove(docs, passed={"a.b": F.col("`a.b`"), "tree": F.col("tree")})
    assert kept.columns == ["a.b", "tree", "leaf", "left", "right", "subroot", "root"]
    assert kept.filter(fold(F.col("leaf"), F.col("left"), F.col("right")) != F.col("root")).isEmpty()


def ranking_by_hand(rows, items, top):
    words = [TERM.findall((r[1] or "").translate(LOWER)) for r in rows]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    tf = [Counter(w) for w in words]
    df = Counter(t for c in tf for t in c)
    asked = defaultdict(Counter)
    for item, text in set(items):
        asked[item].update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for r, w, c in zip(rows, words, tf):
            m = 75 + (25 * len(w) * n_docs) // n_terms
            s = 0
            for t, times in terms.items():
                if c[t]:
                    s += times * floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, r[0] is None, r[0]))
        for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1):
            out.append((item, k, d, -s))
    return sorted(out, key=str)


ITEMS = [
    (1, "the ALPHA the"), (2, "über 中文 nowhere"), (3, None), (4, ""), (5, "no id"), (1, "the ALPHA the"), (1, "gamma"), (None, "été 😀 it's"),
    (6, "unknown words only"), (7, "one two another x y of beta 2024"),
]


@pytest.mark.parametrize("most_terms,triples", [(1 << 21, 1 << 21), (9, 64)])
def test_search(spark, docs, monkeypatch, most_terms, triples):
    from lodestone.llm import lexical

    monkeypatch.setattr(lexical, "TRIPLES", triples)
    items = spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id long, text string, score string")
    for top in (3, 20, 500):
        got = lexical.search(docs.repartition(5), items, top, most_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == ranking_by_hand(sample(), ITEMS, top)
    assert lexical.search(docs.limit(0), items).isEmpty()
    assert lexical.search(docs, items.limit(0)).isEmpty()
    assert lexical.search(docs.filter("doc_id < 3"), items).isEmpty()


def test_radix_order_is_stable():
    import numpy as np

    from lodestone.llm.lexical import radix_order

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 40, 5000).astype(np.uint64) >> np.uint64(rng.integers(0, 30))
    keys[::7] = keys[0]
    assert radix_order(keys, 0, 40).tolist() == np.argsort(keys, kind="stable").tolist()
