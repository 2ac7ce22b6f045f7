"""The pipeline against its stages put together plainly."""

import hashlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from lodestone.llm import mixing, neardup, quality, secrets
    from lodestone.llm.wordpiece import read_ranks

    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = documents, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < 4:
            assert docs.columns == documents.columns
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(seen[0]) == ids(quality.judge(documents).filter("kept"))
    assert ids(seen[1]) == ids(neardup.classes(seen[0]).filter("kept"))
    assert ids(seen[2]) == ids(seen[1])
    assert secrets.scan(seen[2]).filter("size(base) > 0").isEmpty()
    plan = mixing.plan_mix(seen[2]).collect()
    assert ids(seen[3]) == sorted(r["doc_id"] for r in plan for _ in r["positions"])
    text = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    import public_tokenizers

    pieces = {i: p for p, i in read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).items()}
    for r in seen[4].collect():
        tokens = np.frombuffer(r["ids"], "<u2").tolist()
        assert r["n_tokens"] == len(tokens)
        assert b"".join(pieces[i] for i in tokens).decode() == text[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()
    whole = corpus_pipeline.run(spark, SF)
    assert ids(whole) == ids(seen[4])
