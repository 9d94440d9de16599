"""Transactions to text sequences and back to training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BOS, CARD_CHUNK, CARD_COLUMNS, EOS, PAD, SEP, SPECIAL_TOKENS, USER_COLUMNS
from .history import chunk_of
from .ordered import HOT_ROWS, ordered_scan
from .tokens import Tokens


def group_columns(df: DataFrame) -> list[str]:
    """Columns that identify a history: first user column and first card column present."""
    found = [next((c for c in names if c in df.columns), None) for names in (USER_COLUMNS, CARD_COLUMNS)]
    return [c for c in found if c] or df.columns[:1]


def to_sequences(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    chunk_size: int = CARD_CHUNK,
    text: str = "txn_text",
    label: str | None = None,
    hot_rows: int = HOT_ROWS,
    position: str | None = None,
) -> DataFrame:
    """(groups, chunk_id, n_txns, label, text): one row per sequence.

    Text and metadata come from the same aggregate. The aggregate's key starts with the
    window's key, so both share one shuffle; no group is longer than ``chunk_size``.
    ``position`` names a position column that an earlier scan already added.
    """
    rows = df.where(F.col(text).isNotNull())
    if position is None:
        rows, position = ordered_scan(rows, groups, order, position="_pos", hot_rows=hot_rows), "_pos"
    rows = rows.withColumn("chunk_id", chunk_of(F.col(position), chunk_size))
    bos, eos, sep = SPECIAL_TOKENS[BOS], SPECIAL_TOKENS[EOS], SPECIAL_TOKENS[SEP]
    joined = F.expr(f"listagg({text}, ' {sep} ') WITHIN GROUP (ORDER BY {position})")
    aggs = [
        F.count(F.lit(1)).alias("n_txns"),
        F.concat(F.lit(bos + " "), joined, F.lit(" " + eos)).alias("text"),
    ]
    if label:
        aggs.append(F.max(label).cast("int").alias("label"))
    return rows.groupBy(*groups, "chunk_id").agg(*aggs)


def with_line_numbers(seqs: DataFrame, groups: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """0-based line numbers in the order of groups and chunks, per split where there is one."""
    keys = [g for g in groups if g == "split"]
    order = [*[F.col(g) for g in groups if g not in keys], F.col("chunk_id")]
    return ordered_scan(seqs, keys, order, position="line_idx", hot_rows=hot_rows)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def corpus_stats(seqs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Sequences, tokens, transactions and bytes (with line ends) per group."""
    t = F.col(text)
    seps = F.regexp_count(t, F.lit(SPECIAL_TOKENS[SEP]))
    return seqs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.sum(word_count(t).cast("bigint")).alias("n_tokens"),
        F.sum((seps + 1).cast("bigint")).alias("n_txns"),
        F.sum((F.octet_length(t) + 1).cast("bigint")).alias("n_bytes"),
    )


def token_efficiency(rows: DataFrame, tokens_per_txn: int, raw_text: Column, context_window: int = 4096) -> DataFrame:
    """Tokens per transaction against the word count of the raw row text, with the number
    of transactions that fit the context window either way."""
    other = rows.agg(F.avg(word_count(raw_text).cast("double")).alias("raw_tokens_per_txn"))
    return other.select(
        F.lit(tokens_per_txn).cast("bigint").alias("tokens_per_txn"),
        "raw_tokens_per_txn",
        F.lit(context_window // (tokens_per_txn + 1)).cast("bigint").alias("txns_per_window"),
        F.floor(F.lit(context_window) / (F.col("raw_tokens_per_txn") + 1)).cast("bigint").alias("raw_txns_per_window"),
        (F.col("raw_tokens_per_txn") / tokens_per_txn).alias("ratio"),
    )


def clm_examples(df: DataFrame, ids: str = "token_ids", length: int = 4096, mask_pad: bool = True) -> DataFrame:
    """Fixed-length ``input_ids`` and ``labels``. Padding is -100 in the labels;
    ``mask_pad=False`` keeps pad ids there."""
    cut = F.slice(ids, 1, length)
    fill = F.lit(length) - F.size(cut)
    labels = F.concat(cut, F.array_repeat(F.lit(-100), fill))
    if not mask_pad:
        labels = F.concat(cut, F.array_repeat(F.lit(PAD), fill))
    return df.withColumns({"input_ids": F.concat(cut, F.array_repeat(F.lit(PAD), fill)), "labels": labels}).drop(ids)


def clm_dataset(corpus: DataFrame, tokens: Tokens, length: int = 4096, mask_pad: bool = True, text: str = "text") -> DataFrame:
    """Corpus lines to training examples, row by row without a shuffle."""
    return clm_examples(tokens.encode_text(corpus, text, name="token_ids"), "token_ids", length, mask_pad)


def sft_samples(
    rows: DataFrame,
    tokens: Tokens,
    user: str = "user_id",
    order: str = "seq_order",
    seconds: str = "unix_ts",
    amount: str = "amount",
    label: str = "label",
    max_txn_len: int = 32,
    window: int = 512,
    min_length: int = 1,
) -> DataFrame:
    """One row per user: ids, masks, times and hour gaps of the latest ``window``
    transactions, true length, label and last amount.

    Only the latest rows reach the shuffle, so no user row exceeds ``window`` entries.
    """
    from .history import last_n

    keys = [F.col(order), F.col(seconds)]
    n_all = rows.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_length)
    latest = last_n(rows, [user], keys, window)
    if min_length > 1:
        latest = latest.join(n_all.select(user), user, "left_semi")
    enc = tokens.encode_txn(latest, max_txn_len)
    packed = F.struct(
        *[k.alias(f"k{i}") for i, k in enumerate(keys)],
        F.col("input_ids").alias("ids"), F.col("attention_mask").alias("mask"),
        F.col(seconds).cast("bigint").alias("ts"), F.col(amount).cast("double").alias("amount"),
    )
    per_user = enc.groupBy(user).agg(
        F.array_sort(F.collect_list(packed)).alias("h"), F.coalesce(F.max(label), F.lit(0)).cast("int").alias("label")
    )
    ts = F.transform("h", lambda x: x["ts"])
    gaps = F.transform(
        ts,
        lambda t, i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(
            F.least(
                F.greatest(F.floor((t - F.get(ts, i - 1)) / F.lit(3600)).cast("bigint"), F.lit(0).cast("bigint")),
                F.lit(2**31 - 1).cast("bigint"),
            )
        ),
    )
    return per_user.select(
        user,
        F.transform("h", lambda x: x["ids"]).alias("input_ids"),
        F.transform("h", lambda x: x["mask"]).alias("attention_mask"),
        ts.alias("his_time_stap"),
        gaps.alias("delta_time_stap"),
        F.size("h").alias("lens_in"),
        "label",
        F.coalesce(F.element_at("h", -1)["amount"], F.lit(0.0)).alias("amount"),
    )


def pad_history(samples: DataFrame, length: int = 512, txn_len: int = 32) -> DataFrame:
    """Samples made rectangular: ``length`` steps each, a step mask, zeros behind the end."""
    fill = F.greatest(F.lit(length) - F.size("input_ids"), F.lit(0))
    zeros = F.array_repeat(F.array_repeat(F.lit(PAD), txn_len), fill)
    cut = lambda c: F.slice(c, 1, length)
    n = F.least(F.size("input_ids"), F.lit(length))
    zero_long = F.array_repeat(F.lit(0).cast("bigint"), fill)
    return samples.select(
        *[c for c in samples.columns if c in ("user_id", "label", "amount")],
        F.concat(cut("input_ids"), zeros).alias("input_ids"),
        F.concat(cut("attention_mask"), F.array_repeat(F.array_repeat(F.lit(0), txn_len), fill)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)).alias("step_mask"),
        F.concat(cut("his_time_stap"), zero_long).alias("his_time_stap"),
        F.concat(cut("delta_time_stap"), zero_long).alias("delta_time_stap"),
        n.alias("lens_in"),
    )
