"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, PII masking, packing.

Every stage takes all rows that its predecessor kept and returns the columns of documents, but for the last, which
returns the packed pieces. run() writes each stage's rows once to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import language_id, line_dedup, packing, pii, simhash
from casewright.llm.queries import TOKENIZER, tokenizer_file
from casewright.llm.shared import crc_bucket, stage_step

#: A document whose languages all stay below this mean probability has no language that the network knows.
LEAST_SCORE = 0.3


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text that a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a known language; the network learns from the rows that the language query learns from.

    Where no row has a language label there is nothing to know: only texts without a letter go.
    """
    model = language_id.learn(docs.filter(crc_bucket(F.col("doc_id"), 4) != 2))
    if model[1] is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    told = language_id.identify(docs, model, pred="_cw_pred", score="_cw_score")
    return told.filter((F.col("_cw_pred") != language_id.UNKNOWN) & (F.col("_cw_score") >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are near an earlier line."""
    return _counted(line_dedup.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with five-word shingle similarity (Jaccard) of 0.8 or more."""
    return simhash.keep_dissimilar(docs, width=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in the place of each personal span."""
    return _counted(pii.redact(docs, pii.learn(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row a piece, with its ids."""
    return packing.pack_documents(docs, tokenizer_file(TOKENIZER), end=1, window=2048)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash", near_duplicates), ("pii", personal_data), ("packing", pack)]

#: Learned models and tokenizers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_step(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
