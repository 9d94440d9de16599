"""The nested-record route: sixteen tokens per transaction, vocabulary learned on train."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.constants import AMOUNT_THRESHOLDS, CARD_LEVELS, CONN_MODES
from ..operators.history import with_gap
from ..operators.ordered import HOT_ROWS
from ..operators.steps import BinStep, FixedStep, HashStep, MapStep, ThresholdStep, TimeDeltaStep
from ..operators.tokens import Tokens

KEYS = ["user_id"]
HASHED = ["issuer_addr", "acq_addr", "issuer_bank", "acq_bank"]


def ndjson_steps(
    buckets: int = 4000, name_buckets: int | None = None, amount: str = "quantile", amount_bins: int = 20,
    thresholds: list[float] | None = None, time_delta: bool = True, time_bins: int = 32, hash: str = "xxhash64",
) -> Tokens:
    if amount not in ("fixed", "quantile", "uniform", "kmeans"):
        raise ValueError(f"unknown amount strategy {amount!r}")
    first = (
        ThresholdStep("amount", "AMT", thresholds=tuple(thresholds or AMOUNT_THRESHOLDS))
        if amount == "fixed"
        else BinStep("amount", "AMT", bins=amount_bins, strategy=amount)
    )
    hashed = lambda column, prefix: HashStep(column, prefix, buckets=buckets, hash=hash)
    steps = [
        first,
        HashStep("merch_name", "MERCH_NAME", buckets=name_buckets or buckets, hash=hash),
        MapStep("merch_type", "MCC"),
        MapStep("card_level", "CARDLVL", values=tuple(CARD_LEVELS)),
        MapStep("txn_code", "TRXCODE"),
        MapStep("channel", "CHANNEL"),
        MapStep("pos_input", "POSINPUT"),
        MapStep("resp_code", "RESPCODE"),
        MapStep("conn_mode", "CONNMODE", values=tuple(CONN_MODES)),
        hashed("issuer_addr", "FAKA_ADDR"),
        hashed("acq_addr", "SHOUDAN_ADDR"),
        hashed("issuer_bank", "FAKA_BANK"),
        hashed("acq_bank", "SHOUDAN_BANK"),
        FixedStep("period", "PERIOD", lo=0, hi=3),
        FixedStep("dow", "DOW", lo=0, hi=6),
    ]
    if time_delta:
        steps.append(TimeDeltaStep("time_delta_s", "TDIF", bins=time_bins))
    return Tokens(tuple(steps))


def clean_ndjson(df: DataFrame) -> DataFrame:
    """Row-wise part of the preparation; text columns are strings already."""
    cols = {
        "amount": clean.amount_number(F.col("amount"), ","),
        "merch_name": clean.merchant_cjk(F.col("merch_name")),
    }
    cols |= {c: clean.institution(F.col(c)) for c in HASHED}
    return df.withColumns(cols)


def engineer_features(df: DataFrame) -> DataFrame:
    """Raw features of the model comparison: the amount as a number, the rest as they are."""
    return df.withColumn("amount", clean.amount_number(F.col("amount"), ","))


def history_order(df: DataFrame | None = None):
    """Arrival order; time and content settle equal places of a user with several records,
    and a stored ``row_id`` tells exact copies apart, so that any number of them can be cut
    into parts."""
    extra = [F.col("row_id")] if df is not None and "row_id" in df.columns else []
    return [F.col("seq_order"), F.col("unix_ts"), F.col("merch_name"), F.col("amount"), *extra]


def preprocess_ndjson(
    df: DataFrame, keys: list[str] = KEYS, zero_delta: bool = False, position: str | None = "pos", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Cleaned rows with the gap to the user's previous transaction. ``zero_delta`` sets
    every gap to 0, as when transactions are encoded one at a time."""
    c = clean_ndjson(df)
    if zero_delta:
        return c.withColumn("time_delta_s", F.lit(0.0))
    return with_gap(c, list(keys), history_order(c), "unix_ts", position=position, hot_rows=hot_rows)
