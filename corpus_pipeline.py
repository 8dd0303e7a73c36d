"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding. Each stage reads what the last one wrote.

Every stage carries all columns of its input under their own names, whatever these are, takes whole texts of any length, and
gives no rows for an empty table. Rows that repeat, and ids or texts that are null, are handled as each stage says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import fm_index, language_id, mixing, near_copies, shards, simhash
from docloom.llm.common import scratch, table

#: A document needs this much confidence in its language to stay.
MIN_CONFIDENCE = 0.5


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with MIN_CONFIDENCE; a missing lang is filled in.

    Texts that are null or have no letters go. Repeated rows are judged each, and so are rows without an id.
    """
    model = language_id.train(language_id.learnt_rows(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")))
    found = language_id.identify(docs.select("text", F.struct(*docs.columns).alias("record")), model)
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_CONFIDENCE))
    return kept.select(*(F.coalesce("record.lang", "lang_pred").alias("lang") if c == "lang" else F.col("record")[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with similar five-word shingles (Jaccard 0.8): the one with the smallest doc_id.

    SimHash fingerprints link the closest copies, exact prefix filtering the rest (near_copies). Texts without words, null ones
    among them, are copies of each other. Of repeated rows one stays; a null doc_id comes after all others.
    """
    return simhash.keep_one(docs, near_copies.groups)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that benchmark windows hit; n_chars follows the text.

    A null text has no words: it stays null and keeps its n_chars. Repeated rows are cut alike. An empty benchmark cuts nothing.
    """
    clean = fm_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return clean.select(*(F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents that meets the mixture's source, language and topic weights.

    A null source or lang is a value of its own. Null texts have no tokens and share their cell's probability. The draw goes by
    doc_id: repeated rows stay or go together, and so do all rows without an id that have one probability.
    """
    return mixing.sample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in shuffled order over 40 shards, with shard, slot and grown_shard.

    Null texts are empty records. Repeated rows are records of their own; rows of one id, null among them, share a shard.
    Columns of docs with those three names are replaced.
    """
    return shards.shuffle_into_shards(docs)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language ID, fingerprints and the index have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch(spark)}/docloom-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{root}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
