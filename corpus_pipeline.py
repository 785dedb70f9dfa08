"""The corpus pipeline: from ``documents`` to token digests, each stage over all that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it
again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormledger.llm.bpe_codec import encode_documents
from stormledger.llm.common import fresh_dir, read_table, table
from stormledger.llm.decontaminate import contaminated
from stormledger.llm.near_copies import without_near_copies
from stormledger.llm.secrets import redact
from stormledger.llm.toxicity import fit, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose text the grammar, learned from ``labels``, rejects.

    Each row is judged by its own text: null and empty texts stay, repeated rows and rows with null or repeated ids fare alike.
    Without labelled rows of both kinds nothing is rejected; an empty table stays empty; further columns are kept.
    """
    return without_toxic(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more over shingles of five words; they meet by blocks and Hamming distances of
    seeded SimHash fingerprints. Rows are told apart by their own identity: of repeated rows one stays, rows with a null id come last in
    their group, and a text that nothing resembles stays whatever its id. Null texts are empty, texts without words are copies.
    """
    return without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of ``benchmark``.

    Each row is judged by its own text, whatever its id (null or repeated): texts are told apart by a 64-bit hash, so equal ones
    fare alike. Null and empty texts hold nothing. With an empty benchmark all rows stay; further columns are kept.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = contaminated(docs.select(key.alias("key"), "text"), read_table(spark, sf_dir, "benchmark"), id_col="key")
    name = "held_" + max(docs.columns, key=len)  # no column of docs is called so
    found = table(found.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(found, key == F.col(name), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live-looking credentials are masked in their texts, and ``n_chars`` (where there is one) follows.

    Each row is masked by its own text's spans, whatever its id. Null texts stay null with null ``n_chars``; an empty table stays empty.
    """
    masked = redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of all documents, one row for each row, ids as they are; null texts are empty."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: No stage but the secret scan can be said in SQL; the stages are tested one by one in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
