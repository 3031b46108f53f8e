"""A cleaning pipeline over ``documents``: every stage is one operator of ``quarry.llm``, applied to what its
predecessor kept; all stages but the last return the columns of ``documents``.

Rows without an id can't be told apart and go in the first stage; of rows with equal ids (and so of repeated
rows) one stays after near-dedup.  An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.llm import language_id, packing, simhash, superkmer_dedup, weak_quality
from quarry.session import ship
from quarry.storage import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select(COLUMNS).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language (no text or no letter) and ambiguous ones."""
    ship(spark)
    model = language_id.fit(docs)
    return _kept(docs, language_id.predict(docs, model).filter("lang_pred <> 'und' and not ambiguous"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality or with toxic language."""
    model = weak_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, weak_quality.predict(docs, model).filter("keep"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the least id stays."""
    kept = _kept(docs, simhash.near_groups(docs).filter("doc_id = component_id"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return kept.withColumn("_nth", nth).filter("_nth = 1").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 35 words and more that repeat; a document of which nothing is left goes."""
    kept = superkmer_dedup.remove_repeats(docs, texts=True).filter("kept <> ''").select("doc_id", F.col("kept").alias("text"))
    return kept.join(docs.select("doc_id", "lang", "source"), "doc_id").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: Models that are trained on the way have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
