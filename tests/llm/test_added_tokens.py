"""Token files against the library's own encoding, added tokens and all."""


def test_query_gives_added_tokens_their_ids(spark, tmp_path):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm.queries import op9_write_token_files

    text = "a <|endoftext|> b"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = op9_write_token_files(spark, str(tmp_path)).first()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [*library.encode(text, add_special_tokens=False).ids, 2]
    assert (row["n_tokens"], row["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_added_tokens():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm.tokenfiles import Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        content = f.read()
    library, own = Tokenizer.from_str(content), Encoder(content, added=True)
    texts = [
        "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n\n", "<|endoftext|", "中文 <|endoftext|>é it's",
        "plain text, no token", "",
    ]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), own.kind).tolist() == want, text
    assert library.token_to_id("<|endoftext|>") in np.frombuffer(own.encode(texts[0]), own.kind)
