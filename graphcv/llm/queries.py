"""Queries over the driver's tables, one an operator, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcv.llm import chat_rotation, decontamination, html_wrapper, impact_index, jaccard_join, kneser_ney, line_dedup, rindex_dedup, sentencepiece_bpe, simhash, source_audit, source_mix, toxicity
from graphcv.llm.shared import documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("h")


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_rindex_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rindex_dedup.remove_repeats(documents(spark, sf_dir), text=False)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(documents(spark, sf_dir), k=3, percent=90)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(documents(spark, sf_dir)).select("doc_id", "n_removed", "text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trained = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), trained)
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate_dialogues(table(spark, sf_dir, "conversations"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op12_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.rank_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(documents(spark, sf_dir))


def queries():
    return {
        "op1_html_wrapper": op1_html_wrapper,
        "op2_simhash": op2_simhash,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_decontamination": op4_decontamination,
        "op5_kneser_ney": op5_kneser_ney,
        "op6_rindex_dedup": op6_rindex_dedup,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_line_dedup": op8_line_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_chat_rotation": op10_chat_rotation,
        "op11_source_mix": op11_source_mix,
        "op12_impact_index": op12_impact_index,
        "op13_source_audit": op13_source_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": line_dedup.ORACLE, "op10_chat_rotation": chat_rotation.ORACLE, "op11_source_mix": source_mix.ORACLE, "op12_impact_index": impact_index.ORACLE, "op13_source_audit": source_audit.ORACLE}
