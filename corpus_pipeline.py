"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, byte-level BPE.

``STAGES`` lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns of ``documents``, and whatever other
columns there are, whatever their names.  Null and empty texts are rejected by the quality rules; an empty table gives
no rows; repeated rows are near duplicates of each other; long texts go through every stage whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bytebpe, mixing, neardup, quality, secrets
from lodestone.llm.common import columns_of, cut, table, unique


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five words a shingle, similarity 0.8 or more."""
    return neardup.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes a mark; n_chars follows the text."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order; documents that it leaves out go."""
    return mixing.mix(docs, position=unique("position")).select(*columns_of(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text (packed, 16 bits each) and the digests of the ids and of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bytebpe.encode(docs, ranks, public_tokenizers.PATTERN, with_digests=True, passed=["doc_id"])


STAGES = [
    ("quality rules", keep_good),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Estimated rules, sketches and ranked merges are not SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage-" + name.replace(" ", "-"))
    return docs
