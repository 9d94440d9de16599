"""The card route: flat rows, twelve tokens per transaction, fixed vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.constants import ALL_STATES, AMOUNT_THRESHOLDS, CHIP_MAPPING, INDUSTRY_RANGES, KNOWN_MCCS
from ..operators.history import nulls_last, with_gap
from ..operators.ordered import HOT_ROWS
from ..operators.steps import BinStep, FixedStep, HashStep, MapStep, ThresholdStep, TimeDeltaStep
from ..operators.tokens import Tokens

KEYS = ["user", "card"]


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().replace(" ", "_").lower() for c in df.columns])


def engineer_features(df: DataFrame) -> DataFrame:
    """``Hour``, numeric ``Amount`` and the 0/1 ``_target``."""
    return df.withColumns(
        {
            "Hour": F.split_part("Time", F.lit(":"), F.lit(1)).cast("int"),
            "Amount": clean.amount_feature(F.col("Amount")),
            "_target": clean.target(F.col("`Is Fraud?`")),
        }
    )


def card_steps(
    merchant_buckets: int = 2000, amount: str = "fixed", amount_bins: int = 10, time_delta: bool = False, time_bins: int = 32
) -> Tokens:
    if amount == "fixed":
        first = ThresholdStep("amt_num", "AMT", thresholds=tuple(AMOUNT_THRESHOLDS))
    else:
        first = BinStep("amt_num", "AMT", bins=amount_bins, strategy=amount)
    steps = [
        first,
        HashStep("merch_hash", "MERCH", buckets=merchant_buckets, hashed=True),
        MapStep("mcc_int", "CAT", ranges=tuple((lo, hi, label) for lo, hi, label, _ in INDUSTRY_RANGES), default="GENERAL"),
        MapStep("mcc_str", "MCC", values=tuple(str(m) for m in KNOWN_MCCS), default="-1"),
        FixedStep("hour", "HOUR", lo=0, hi=23, pad=2),
        FixedStep("dow", "DOW", lo=0, hi=6),
        FixedStep("month", "MONTH", lo=1, hi=12, pad=2),
        FixedStep("card", "CARD", lo=0, hi=9),
        MapStep("chip_upper", "CHIP", mapping=tuple(CHIP_MAPPING.items()), default="UNK"),
        FixedStep("zip3", "ZIP3", lo=0, hi=999, pad=3),
        MapStep("state_clean", "STATE", values=tuple(ALL_STATES), default="XX"),
        FixedStep("cust", "CUST", lo=0, hi=2999),
    ]
    if time_delta:
        steps.append(TimeDeltaStep("time_delta_s", "TDIF", bins=time_bins))
    return Tokens(tuple(steps))


def fitted_card_steps(**kw) -> Tokens:
    """The fixed vocabulary; needs no data unless amounts are binned."""
    return card_steps(**kw).fit()


def clean_card(
    df: DataFrame, merchant_buckets: int = 2000, hash: str = "xxhash64", row_id: str = "row_id",
    keep: list[str] = (), strip: str = "$,",
) -> DataFrame:
    """Row-wise part of the preparation: numbers and short codes instead of raw text, so
    that whatever is shuffled later is narrow. ``strip="$"`` leaves commas in amounts (and
    such amounts become null)."""
    d = normalize_columns(df)
    ts = clean.timestamp_from_parts(F.col("year"), F.col("month"), F.col("day"), F.col("time"))
    # Named first because they are used more than once below.
    d = d.withColumns({"time_full": ts, "merch_clean": clean.merchant(F.col("merchant_name"))})
    kept = [c for c in ([row_id] if row_id in d.columns else []) + list(keep)]
    return d.select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("user"),
        clean.clip(F.col("card").cast("int"), 0, 9).alias("card"),
        clean.amount_number(F.col("amount"), strip).alias("amt_num"),
        clean.hash_bucket(F.col("merch_clean"), merchant_buckets, hash).alias("merch_hash"),
        clean.mcc_int(F.col("mcc")).alias("mcc_int"),
        clean.mcc_int(F.col("mcc")).cast("string").alias("mcc_str"),
        clean.hour_of(F.col("time_full")).alias("hour"),
        clean.weekday_of(F.col("time_full")).alias("dow"),
        clean.month_of(F.col("time_full")).alias("month"),
        F.upper(F.col("use_chip").cast("string")).alias("chip_upper"),
        clean.zip3(F.col("zip")).alias("zip3"),
        clean.state(F.col("merchant_state")).alias("state_clean"),
        clean.clip(F.col("user").cast("int"), 0, 2999).alias("cust"),
        F.unix_timestamp("time_full").alias("time_s"),
    )


def history_order(row_id: str = "row_id"):
    return [*nulls_last("time_s"), F.col(row_id)]


def preprocess_card(
    df: DataFrame, merchant_buckets: int = 2000, hash: str = "xxhash64", row_id: str = "row_id",
    keep: list[str] = (), keys: list[str] = KEYS, position: str | None = "pos", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Cleaned rows with the gap to the previous transaction of the card and the row's
    position in the card's history; both come out of one scan."""
    c = clean_card(df, merchant_buckets, hash, row_id, keep)
    return with_gap(c, list(keys), history_order(row_id), "time_s", position=position, hot_rows=hot_rows)
