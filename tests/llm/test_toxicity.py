"""The toxicity grammar against plain versions, its learning, and its verdicts on held-out labels."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic string, score string, `a.b` string"
SF = "/root/testdata/sf0.01"


def grammar(**weights):
    from lodestone.llm.toxicity import Grammar

    return Grammar({k.replace("_", "$"): float(v) for k, v in weights.items()})


def said(text, **weights):
    from lodestone.llm.toxicity import KINDS

    n, found = grammar(**weights).read(text)
    return n, [(text[a:b], KINDS[k], w) for a, b, k, w in found]


def test_clauses_by_kind():
    w = {"fool_": 2, "drat": 3, "dratful_": 0}
    assert said("", **w) == (0, []) and said("a quiet text. nothing", **w) == (4, [])
    assert said("Fool!", **w) == (1, [("Fool", "insult", 2.0)])
    assert said("You FOOL and dratx; fools, dratful", **w) == (6, [("FOOL and dratx", "targeted", 5.0)])
    assert said("fool, that is what you are", **w)[1] == [("fool", "targeted", 2.0)]
    assert said("he is not a fool. fool", **w)[1] == [("fool", "negated", 2.0), ("fool", "insult", 2.0)]
    assert said("not one of the many here is a fool", **w)[1] == [("fool", "insult", 2.0)]  # out of the negation's reach
    assert said('she said fool\n"fool" fool', **w)[1] == [
        ("fool", "reported", 2.0), ('fool" fool', "insult", 2.0), ('fool" fool', "reported", 2.0),
    ]
    assert said("I will hurt you", **w)[1] == [("hurt", "threat", 3.0)]
    assert said("you will hurt, fool", **w)[1] == [("hurt, fool", "targeted", 2.0)]
    assert said("hurt you, it will", **w)[1] == []
    assert said("İ fool***", **w) == (2, [("fool", "insult", 2.0)])  # a letter that lowers to two
    long = "word " * 50_000 + "fool"
    assert said(long, **w) == (50_001, [("fool", "insult", 2.0)])


def test_composition_reads_as_its_parts_do():
    from lodestone.llm.toxicity import Transducer, grammar

    made = grammar()
    draw = random.Random(5)
    mark = frozenset
    parts = Transducer({(0, 1): (0, mark("i"))}).compose(Transducer({(0, 3): (1, None), (1, 1): (0, mark("n"))}, last={1: mark("z")}))
    for _ in range(200):
        a, b, both = 0, 0, parts.start
        for s in [draw.randrange(8) for _ in range(12)]:
            both, out = parts.step(both, s)
            want = {"i"} if s == 1 else set()
            if b == 1 and s == 1:
                want, b = want | {"n"}, 0
            elif b == 0 and s == 3:
                b = 1
            assert out == want and both == (a, b)
        assert parts.last.get(both, mark()) == (mark("z") if b else mark())
    assert len({s for s, _ in made.arcs}) <= 1 * 4 * 2 * 4 * 3


def test_vocabulary_counts_groups_once(spark):
    from lodestone.llm.toxicity import beginnings, vocabulary

    rows = [("one two three Four", 1)] * 40 + [("one two three four", 0), ("five one", 1), (None, 0), ("", 0), ("fourth five fives", 0)]
    got = {r["word"]: (r["toxic"], r["clean"]) for r in vocabulary(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    assert got == {
        "": (2, 3), "one": (2, 1), "two": (1, 1), "three": (1, 1), "four": (1, 1), "five": (1, 1), "fourth": (0, 1), "fives": (0, 1),
    }
    words = spark.createDataFrame([(k, *v) for k, v in got.items() if k], "word string, toxic long, clean long")
    parts = {r["part"]: (r["toxic"], r["clean"]) for r in beginnings(words).collect()}
    want: dict = {}
    for word, (t, c) in got.items():
        for part in {word[:n] for n in range(4, min(len(word), 10) + 1)} | {word + "$"} if word else ():
            a, b = want.get(part, (0, 0))
            want[part] = (a + t, b + c)
    assert parts == want


def test_weights_of_stems_and_exceptions():
    from lodestone.llm.toxicity import Grammar, weigh

    nodes = {"drat": (60, 20, True), "drata": (20, 0, True), "drat$": (0, 20, False), "dry$": (0, 9, False), "fool$": (30, 0, True)}
    weights = weigh(nodes, 0.1, 3)
    assert set(weights) == {"drat", "drata", "drat$", "fool$"}
    read = Grammar(weights)
    assert read.weight("dratax") > read.weight("dratx") > 1 and read.weight("drat") == 0 and read.weight("fool") > 1
    assert read.weight("fools") == 0 and read.weight("dry") == 0


def made_up(n, seed=1):
    """Documents of which every fourth is toxic: a stem with many endings, and one word."""
    draw = random.Random(seed)
    syllables = ["ba", "ce", "di", "fo", "gu", "ha", "je", "ki", "lo", "mu"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 3)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(draw.randint(5, 60))]
        toxic = k % 4 == 0
        for _ in range(draw.randint(2, 4) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(["zorrag" + word(), "blixt"]))
        rows.append((k, " ".join(words) + ".", "en", "s", 1, "clash", "clash", "clash", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    from lodestone.llm.toxicity import score

    rows = made_up(800)
    rows += [(None, "blixt blixt blixt", None, None, None, "", "", "", None), (9000, None, None, None, None, "", "", "", 0)]
    rows += [(9001, "", None, None, None, "", "", "", None), rows[4], (9002, "zorragnew zorragother blixt", None, None, 1, "", "", "", None)]
    docs = spark.createDataFrame([r[:8] for r in rows], SCHEMA)
    labels = [(r[0], 1, r[8]) for r in rows if r[0] is None or r[0] < 600 or r[0] == 9000]
    labels += [(4, 0, 0), (5, 0, None), (77777, 0, 1)]
    schema = "doc_id long, quality int, toxic int"
    return rows, docs, labels, schema, score(docs, spark.createDataFrame(labels, schema)).collect()


def test_scores(scored):
    rows, _, _, _, got = scored
    assert len(got) == len(rows)
    truth = {r[0]: r[8] for r in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        if r["doc_id"] is not None and r["doc_id"] < 9000:
            assert r["predicted"] == truth[r["doc_id"]]
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["predicted"] == 1 and by_id[9002]["predicted"] == 1
    assert by_id[9000]["score"] == by_id[9001]["score"] < 0.5 and by_id[9000]["clauses"] == []


def test_held_out_labels_do_not_matter(spark, scored):
    from lodestone.llm.toxicity import score

    rows, docs, labels, schema, got = scored
    other = [(d, q, 1 if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in labels]
    again = score(docs.withColumn("lang", F.lit("xx")).repartition(3), spark.createDataFrame(other, schema)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    assert [r["score"] for r in sorted(again, key=key)] == pytest.approx([r["score"] for r in sorted(got, key=key)], abs=1e-6)


def test_without_labels_or_rows(spark, scored):
    from lodestone.llm.toxicity import score

    _, docs, labels, schema, _ = scored
    none = spark.createDataFrame([], schema)
    assert {(r["score"], r["predicted"]) for r in score(docs, none).collect()} == {(0.25, 0)}
    one_kind = spark.createDataFrame([(k, 1, 0) for k in range(100)], schema)
    got = {(r["score"], r["predicted"]) for r in score(docs, one_kind).collect()}
    assert len(got) == 1 and all(s < 0.05 and p == 0 for s, p in got)
    assert score(docs.limit(0), spark.createDataFrame(labels, schema)).isEmpty()


def test_held_out_accuracy(spark):
    import __spark_entry__ as entry

    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in entry.queries()["op12_score_toxicity"](spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.95 * len(got) > 50
    assert all(r["predicted"] == 0 for r in got if not labels[r["doc_id"]])
