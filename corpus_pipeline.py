"""A corpus pipeline in five stages: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`, and extra columns of `docs` with them, whatever their
names. An empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import gam, minhash, mixing, packing, pii
from confluo.llm.queries import WORDS, tokenizer
from confluo.llm.shared import free_name, small_batches, stash, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject: those of a score of 0.5 or more.

    Null and empty texts are judged as texts without words. Rows without an id are judged as others, but teach nothing.
    Repeated rows stay or go together. Without labels of both kinds all have one score and stay or go together."""
    small_batches(spark)
    return gam.keep_good(docs, gam.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id; of repeated rows of it, one.

    Documents without an id are named by a hash of their text, beyond all ids, and so give way to those that have one.
    Different texts under one id both stay. Texts that are null or without words are alike to nothing; of repeated rows
    of one id, one stays."""
    small_batches(spark)
    key, name = free_name(docs, "_key"), free_name(docs, "_text")
    named = docs.withColumn(key, F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))))
    kept = minhash.near_duplicates(named, id_col=key).filter("kept").select(key).distinct()
    once = named.join(kept, key, "left_semi").withColumn(name, F.xxhash64("text")).dropDuplicates([key, name])
    return once.drop(key, name).select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced by its kind; n_chars follows. No row goes; null texts stay null, with 0 characters."""
    small_batches(spark)
    size = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return pii.redact(docs).withColumn("n_chars", size).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; one that is taken in part comes whole.

    A null source is a source of its own. Repeated rows, and rows that share an id or have none, are decided one by one.
    A document without words comes as often as its source is repeated whole."""
    small_batches(spark)
    return mixing.repeat(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences. A null or empty text is a piece of its end alone; repeated rows have
    pieces and places of their own."""
    small_batches(spark)
    return packing.pack(docs, tokenizer(WORDS), capacity=4096, end_id=1)


STAGES = [("quality", quality), ("near-duplicates", near_duplicates), ("personal-data", personal_data), ("mixing", mixed), ("packing", packed)]

#: A learned model and tokenizers take part, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
