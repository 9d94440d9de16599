"""The same rows from a folder that keeps receiving record files.

The gap to the previous transaction is read from the neighbouring array entry, or from the
record's ``prev_ts`` where a history comes in parts, without state between batches; records that do
not say where their history stands are continued from keyed state (``continued``). The vocabulary
is frozen: it comes from a fitted ``Tokens``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expand import expand_records
from ..operators.tokens import Tokens
from ..plans.card import KEYS as CARD_KEYS
from ..plans.card import clean_card
from ..plans.ndjson import clean_ndjson
from ..sources.readers import parse_records
from .gaps import carry_gaps


def stream_records(
    spark: SparkSession, path: str, strict: bool = True, files_per_batch: int = 1000, pattern: str = "*.jsonl"
) -> DataFrame:
    lines = (
        spark.readStream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
        .text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    )
    return parse_records(lines, strict)


def record_rows(records: DataFrame) -> DataFrame:
    """Cleaned transaction rows with ``time_delta_s``, row by row: works on streams and on
    tables, without a shuffle."""
    return clean_ndjson(expand_records(records, gaps=True))


def continued_rows(records: DataFrame, expire_seconds: float | None = None) -> DataFrame:
    """The same of a stream whose records give pieces of histories without saying which: gaps and
    ``seq_order`` go on from the user's newest row in any earlier file. Adds ``late``."""
    rows = clean_ndjson(expand_records(records))
    return carry_gaps(rows, ["user_id"], "unix_ts", ["seq_order", "merch_name", "amount"], position="seq_order", expire_seconds=expire_seconds)


def stream_tokens(spark: SparkSession, path: str, tokens: Tokens, continued: bool = False, expire_seconds: float | None = None, **kw) -> DataFrame:
    """Streaming token text per transaction of every record that arrives; ``continued`` as for
    :func:`continued_rows`."""
    records = stream_records(spark, path, **kw)
    rows = continued_rows(records, expire_seconds) if continued else record_rows(records)
    return tokens.with_text(rows, keep=["user_id", "seq_order"])


def stream_card_gaps(rows: DataFrame, expire_seconds: float | None = None) -> DataFrame:
    """Cleaned rows of a stream of card transactions with the gap to the card's previous one and
    the row's place in its history (``pos``), as ``preprocess_card`` gives them for a table."""
    return carry_gaps(clean_card(rows), CARD_KEYS, "time_s", ["row_id"], expire_seconds=expire_seconds)
