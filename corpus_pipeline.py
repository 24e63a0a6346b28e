"""A training corpus from raw documents: toxicity, line dedup, near duplicates, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcv.llm import decontamination, jaccard_join, line_dedup, sentencepiece_bpe, toxicity
from graphcv.llm.queries import table
from graphcv.llm.shared import documents, written


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; the machine is fitted on the labels of `documents`."""
    trained = toxicity.train_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select(F.struct("*").alias("row"), "text"), trained)
    return scored.where("score < 0.5").select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of ten sites or more; n_chars follows the text. No document goes."""
    cut = line_dedup.remove_boilerplate(docs)
    kind = dict(docs.dtypes)["n_chars"]
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least id.

    Texts without words are not duplicates of each other; different texts that share an id are different documents.
    """
    return jaccard_join.keep_one_of_group(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    return sentencepiece_bpe.encode_documents(docs)


STAGES = [
    ("toxicity", keep_civil),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding", encode),
]

#: SQL expresses neither the fitted machine nor the encoder; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again but the last."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
