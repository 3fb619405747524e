"""A training corpus from raw documents: quality filter, near-duplicates, repeated passages,
source mix, tokens.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next stage's docs. All but the last
return the columns of ``documents``; the last returns a row of token ids per document of the
mix. ``sf_dir`` is read for the quality labels only.

Defined results: an empty table of documents gives an empty result in every stage; nulls,
blank texts, repeated rows and clashing extra columns are handled as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohort.llm import bpe, mil_quality, mixing, repeats, simhash
from kohort.llm.common import table
from kohort.session import checkpoint_dir

#: cached pre-tokens of the last stage: its workers live on beside the JVM of the other stages
CACHE_ENTRIES = 100_000
#: SQL can express neither the learnt model nor the tokens; tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return mil_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that occur more than once."""
    return repeats.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them, a row for each pass over their source."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digests of ids and decoded bytes."""
    import public_tokenizers
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, CACHE_ENTRIES)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mix", mix), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each result but the last is a Parquet table in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    out = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{out}/{i}-{name}")
            docs = spark.read.parquet(f"{out}/{i}-{name}")
    return docs
