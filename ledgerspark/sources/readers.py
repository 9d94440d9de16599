"""Readers. Schemas are declared; nothing is inferred by an extra pass."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordered import HOT_ROWS, ordered_scan

CARD_SCHEMA = T.StructType(
    [
        T.StructField("User", T.LongType()),
        T.StructField("Card", T.IntegerType()),
        T.StructField("Year", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Day", T.IntegerType()),
        T.StructField("Time", T.StringType()),
        T.StructField("Amount", T.StringType()),
        T.StructField("Use Chip", T.StringType()),
        T.StructField("Merchant Name", T.StringType()),
        T.StructField("Merchant City", T.StringType()),
        T.StructField("Merchant State", T.StringType()),
        T.StructField("Zip", T.StringType()),
        T.StructField("MCC", T.IntegerType()),
        T.StructField("Is Fraud?", T.StringType()),
    ]
)

RECORD_COLUMNS = ["cert_sm3", "cert_type", "label", "trans", "start", "prev_ts"]
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("cert_sm3", T.StringType()),
        T.StructField("cert_type", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("trans", T.ArrayType(T.ArrayType(T.StringType()))),
        # A long history may come as several records: the place of the record's first
        # transaction in it and the time of the one before; absent in a whole history.
        T.StructField("start", T.LongType()),
        T.StructField("prev_ts", T.DoubleType()),
        T.StructField("_bad", T.StringType()),
    ]
)


OPTIONAL_CARD_COLUMNS = [T.StructField("row_id", T.LongType())]


def read_card_csv(spark: SparkSession, path, schema: T.StructType = CARD_SCHEMA, **options) -> DataFrame:
    """Card rows with a header line, whose names decide, not their places. Columns beyond the
    schema are kept as text (``row_id`` as a number). A missing path, a missing column, files with
    differing headers or a malformed row raise."""
    head = spark.read.text(path).first()
    if head is None:
        raise FileNotFoundError(f"no header line under {path}")
    separator = options.get("sep", ",")
    names = [n.strip() for n in next(csv.reader([head["value"]], delimiter=separator))]
    known = {f.name: f for f in [*schema, *OPTIONAL_CARD_COLUMNS]}
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"columns {missing} are missing under {path}")
    there = T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names])
    # Every file's header is held against the schema.
    return spark.read.csv(path, schema=there, header=True, enforceSchema=False, mode="FAILFAST", multiLine=False, **options)


def with_row_key(df: DataFrame, name: str = "row_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add a key made of the row's content and its number among equal rows, so that reading
    the same rows again, however cut or ordered, gives the same keys."""
    content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    keyed = df.withColumn("_content", content).withColumn("_any", F.monotonically_increasing_id())
    # Equal rows are interchangeable, so any order among them will do.
    numbered = ordered_scan(keyed, ["_content"], [F.col("_any")], position="_copy", hot_rows=hot_rows)
    return numbered.withColumn(name, F.concat_ws("-", "_content", F.col("_copy").cast("string"))).drop("_content", "_any", "_copy")


def read_parquet(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def _parsed(lines: DataFrame) -> DataFrame:
    body = F.trim("value")
    return lines.where(body != "").select(
        F.col("_file"),
        F.col("value"),
        F.from_json(body, RECORD_SCHEMA, {"columnNameOfCorruptRecord": "_bad"}).alias("_r"),
    )


def _record_lines(spark: SparkSession, path, pattern: str) -> DataFrame:
    df = spark.read.text(path, pathGlobFilter=pattern)
    if df.isEmpty():
        raise FileNotFoundError(f"no {pattern} files under {path}")
    return df.select("value", F.col("_metadata.file_path").alias("_file"))


def parse_records(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Text lines (``value``, ``_file``) to records; a bad line raises with its file."""
    p = _parsed(lines)
    bad = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    if not strict:
        return p.where(~bad).select(*[f"_r.{c}" for c in RECORD_COLUMNS])
    # The line itself is a customer's history and stays out of messages and logs.
    message = F.concat(F.lit("Invalid JSON at "), F.col("_file"), F.lit(", line of md5 "), F.md5("value"))
    checked = F.when(bad, F.raise_error(message).cast(RECORD_SCHEMA)).otherwise(F.col("_r"))
    return p.select(checked.alias("_r")).select(*[f"_r.{c}" for c in RECORD_COLUMNS])


def read_records(spark: SparkSession, path, strict: bool = True, pattern: str = "*.jsonl") -> DataFrame:
    """Nested user records of one file or of all ``*.jsonl`` directly in a folder."""
    return parse_records(_record_lines(spark, path, pattern), strict)


def rejected_lines(spark: SparkSession, path, pattern: str = "*.jsonl") -> DataFrame:
    """Lines ``read_records`` refuses, with their file."""
    p = _parsed(_record_lines(spark, path, pattern))
    return p.where(F.col("_r").isNull() | F.col("_r._bad").isNotNull()).select("_file", "value")


def read_corpus(spark: SparkSession, path) -> DataFrame:
    """Sequences of a text corpus, one per line, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where(F.col("text") != "")


def read_embeddings(spark: SparkSession, path, split: str | None = None) -> DataFrame:
    """Vectors with label and row id; asking for one split reads only its folder."""
    df = spark.read.parquet(path)
    return df.where(F.col("split") == split) if split else df
