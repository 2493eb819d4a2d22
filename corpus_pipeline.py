"""A corpus pipeline: toxicity, line dedup, near duplicates, source mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a table; the one that runs the
stages writes it as Parquet and hands it to the next stage. All but the last
return the columns of documents. SQL can't express the scoring automata or the
merges of the encoding, so there is no SQL for the whole; tests compare the
stages with plain models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.llm import bpe, common, jaccard, linededup, mixing, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half. The lexicon is learned from labelled documents among docs."""
    lexicon = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; n_chars follows the text."""
    cleaned = linededup.remove_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.75, directly or through others, the one with the smallest doc_id."""
    return jaccard.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each pass over a document."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, piece_offsets and n_tokens of every text."""
    return bpe.encode(docs, keep=("doc_id", "source")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: No single SQL statement gives run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
