"""From raw documents to training token files, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept;
``run`` writes each result as Parquet and reads it again as the next stage's documents. All
stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import decontaminate, pfair, probminhash, quality, token_files
from ledgerspark.llm.pieces_bpe import tokenizer_path
from ledgerspark.llm.registry import BATCH_ROWS, table
from ledgerspark.session import fresh_path, materialize

TOKENIZER = "word_bpe_49k.json"


def _set(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    _set(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id."""
    _set(spark)
    return probminhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    _set(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents in the order of the mix: the order of the rows in the files written
    from the result."""
    _set(spark)
    return pfair.mix_documents(docs)


def _stored_order(docs: DataFrame) -> list[Column] | None:
    """The order of the rows in the files they were read from; None if they come from elsewhere."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return None
    return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the mix, and what is read back from them: ``doc_id``, ``start``,
    ``n_tokens``, ``ids_crc32``."""
    _set(spark)
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, path, tokenizer_path(TOKENIZER), order=_stored_order(docs))
    return token_files.read_tokens(spark, path)


STAGES = [
    ("quality_classifier", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", remove_benchmark),
    ("source_mix", mix_sources),
    ("token_output", token_output),
]

# Classifier, signatures and tokenizer are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
