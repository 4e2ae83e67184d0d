"""A corpus pipeline of five training-data operators; part of the llm subpackage.

Each stage takes all that its predecessor kept, written as Parquet and read
again. Language ID drops texts without a language, line dedup cuts later copies
of repeated runs and drops texts that have no line left, the Jaccard join keeps
the document with the least id of every group of near copies, decontamination
drops documents with benchmark windows, and encoding turns texts into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontam, jaccard, langid, linededup, pieces
from tidewater.llm.common import materialize, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from rows of the training folds; rows with lang_pred 'und' go: null texts and texts without a letter.

    Rows without doc_id are judged like others; repeated rows all stay or all go.
    """
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "text")  # whatever the columns are called; the row itself stays in the JVM
    found = langid.identify(whole, docs.where(langid.fold_of("doc_id") != 1), keep=["_row"])
    return found.where("lang_pred != 'und'").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated runs of lines; a row whose text the cuts empty goes, n_chars is counted anew.

    Null and empty texts have no lines and stay as they are; repeated rows are told apart by the operator's order.
    """
    found = linededup.dedup_lines(docs).where("not emptied")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays.

    Rows without doc_id or without words link with nothing and stay; rows that
    repeat one doc_id are one document and stay or go together.
    """
    others = materialize(jaccard.jaccard_components(docs).where("component_id != doc_id").select("doc_id").distinct(), "near-copies")
    kept = docs.select(F.struct("*").alias("_row"), "doc_id").join(others, "doc_id", "left_anti")
    return kept.select("_row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go, each judged by its own text; null and empty texts stay."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every row; null and empty texts have no ids."""
    return pieces.tokens(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Language ID, the Jaccard components and encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
