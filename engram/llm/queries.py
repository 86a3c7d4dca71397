"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_repair, decontam, exact_dedup, filter_audit, kd_shard, license_scan, line_dedup, packing, preference, quality_mil, simhash, suffix_dedup, toxicity
from .common import table


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.build_index(docs)).drop("places")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("th", "n_chunks")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), capacity=2048)


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    learn = table(spark, sf_dir, "labels").filter(toxicity.remainder("doc_id", 5) != 0)
    return toxicity.train(docs, learn.select("doc_id", F.col("toxic").alias("label")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", F.coalesce(toxicity.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_restored")


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = table(spark, sf_dir, "labels").filter(toxicity.remainder("doc_id", 3) != 1)
    net = quality_mil.train(docs, learn.select("doc_id", F.col("quality").alias("label")))
    scored = quality_mil.score(docs, net)
    return scored.select("doc_id", F.coalesce(toxicity.remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages", "top_passage")


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no rejected answers; each conversation is chosen over itself with the last answer cut off at half."""
    chosen = table(spark, sf_dir, "conversations")
    return preference.preference_segments(chosen, preference.cut_answers(chosen))


def op8_kd_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = kd_shard.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("th")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids", "spans", "th")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs, 10), digest=True)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    audits, _ = chat_repair.repair(chat_repair.damaged(conversations))
    return chat_repair.with_all(audits, conversations)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_license_scan, op3_exact_dedup, op4_best_fit_packing, op5_toxicity, op6_quality_mil, op7_preference_format, op8_kd_shard, op9_simhash, op10_decontamination, op11_line_dedup, op12_filter_audit, op13_chat_repair, pipeline)
}
