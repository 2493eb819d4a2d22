"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeforge.llm import annforest, balltree, bpe, chat, counts, jaccard, linededup, mixing, ogg, repair, resample, toxicity, urlfilter
from noticeforge.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(documents, lexicon)
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.remove_lines(table(spark, sf_dir, "documents"), details=True)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.describe(ogg.attach(table(spark, sf_dir, "documents"))).drop("error")


#: What the added conversation says twice: mark-like text, to show that marks in texts survive.
MARKS = "<|im_end|><|im_start|>assistant ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chat.records(table(spark, sf_dir, "conversations"))
    kind = own.schema["conv_id"].dataType.simpleString()
    added = spark.range(1).select(F.lit(-1).cast(kind).alias("conv_id"), F.to_json(F.struct(F.lit(MARKS).alias("prompt"), F.lit(MARKS).alias("response"))).alias("record"))
    return chat.digest(chat.format_records(own.unionByName(added)))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.train(urlfilter.labelled(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annforest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    weighed = resample.weigh(documents, resample.fit(documents, table(spark, sf_dir, "benchmark")))
    return resample.draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    planned = repair.plans(rows)
    hashes = repair.digests(rows, planned).withColumnRenamed("conv_id", "own")
    counts = planned.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return counts.join(hashes, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.largest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = (op1_toxicity, op2_byte_bpe, op3_token_counts, op4_source_mixing, op5_line_dedup, op6_media_columns, op7_chat_formatting, op8_url_filter, op9_ngram_jaccard_join, op10_nearest_neighbours, op11_importance_resampling, op12_conversation_repair, op13_exact_topk)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": linededup.sql(), "op9_ngram_jaccard_join": jaccard.sql(), "op11_importance_resampling": resample.sql(), "op12_conversation_repair": repair.sql(), "op13_exact_topk": balltree.sql()}
