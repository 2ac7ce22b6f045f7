"""Callers' columns of any name pass through every stage; long pieces and many matches are whole."""

import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
NAMES = ["_row", "_key", "_base", "_more", "found", "base", "training_position", "_nth", "a.b", "n_words", "ids"]


def test_stages_keep_columns_of_any_name(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    rows = [
        (k, " ".join(word() for _ in range(90)) + (" password=abcdefgh1234" if k % 3 == 0 else ""), f"s{k % 2}", 9, *(f"{n}{k}" for n in NAMES))
        for k in range(12)
    ]
    rows += [(12, None, None, None, *([None] * len(NAMES))), (13, "", "s0", 0, *([None] * len(NAMES)))]
    schema = "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, frame, "")
            assert out.columns == docs.columns, name
            for r in out.collect():
                assert list(r)[4:] == [None if r["doc_id"] > 11 else f"{n}{r['doc_id']}" for n in NAMES]


def test_byte_bpe_passes_clashing_columns(spark):
    import public_tokenizers
    import tiktoken

    from lodestone.llm.bytebpe import encode
    from lodestone.llm.wordpiece import read_ranks

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    long = "".join(random.Random(1).choice("ACGT") for _ in range(100_000))
    rows = [(1, long, "x"), (2, "a b" + long[:700], "y"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    got = {r["doc_id"]: r for r in encode(docs, path, public_tokenizers.PATTERN, 10).collect()}
    ranks = read_ranks(path)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got[2]["a.b"] == "y" and got[3]["ids"] == b""
    for k, text, _ in rows[:2]:
        assert np.frombuffer(got[k]["ids"], "<u2").tolist() == encoding.encode_ordinary(text)
