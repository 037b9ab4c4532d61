"""The corpus pipeline: documents through five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet to the shared folder
and reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvagrid.llm import bpe, exact_dedup, language_id, minhash, mixing
from silvagrid.llm.common import saved, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters) go; lang becomes the predicted language of the others."""
    model = language_id.fit(docs.where(~language_id.held_out()).select("text", "lang"))
    with small_batches(spark):  # holds for plans made in here, so the rows are written in here
        out = saved(language_id.identify(docs.select(*COLUMNS), model, keep=COLUMNS).where("lang_pred <> 'und'"))
    return out.select(*(F.col("lang_pred").alias(c) if c == "lang" else F.col(f"row.{c}").alias(c) for c in COLUMNS))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, one with the largest doc_id (null is the smallest)."""
    return exact_dedup.one_of_each(docs, COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (five words, 0.8); null is the smallest."""
    docs, key = docs.select(*COLUMNS), "doc_id"
    if not docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        # doc_id doesn't tell the rows apart: a key in its order does
        docs, key = saved(docs.orderBy(*COLUMNS).withColumn("row_key", F.monotonically_increasing_id())), "row_key"
    gone = minhash.near_duplicates(docs, doc_id=key).where("NOT kept").select(F.col("doc_id").alias(key))
    return docs.join(gone, key, "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of each source up to its target; a document taken in a second epoch gives a second row."""
    return mixing.mix_documents(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and the digests of the ids and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.encoded_digests(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], ids=True)
    return out.select("row.*", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The near-dedup and the encoding can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
