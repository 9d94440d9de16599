"""End-to-end jobs. Each reads its input once per driver decision (cutoffs, fitted
vocabulary) and keeps everything else in one plan over all splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CARD_CHUNK, CARD_FEATURES, NDJSON_CHUNK, NDJSON_FEATURES
from ..operators import corpus, sampling
from ..operators.align import align, extract_label
from ..operators.expand import expand_records
from ..operators.ml import three_model_comparison
from ..operators.history import last_n, with_gap
from ..operators.ordered import HOT_ROWS, NO_HOT_KEYS
from ..operators.split import temporal_split_date, temporal_split_quantile
from ..operators.tokens import Tokens
from ..operators.vectors import embed_sequences, embedding_metadata, one_hot_states
from ..sources import readers, writers
from . import card, ndjson

ROUTES = {"card": card, "ndjson": ndjson}


def route(name: str):
    """Module of a route; unknown names raise."""
    if name not in ROUTES:
        raise ValueError(f"unknown route {name!r}; known: {sorted(ROUTES)}")
    return ROUTES[name]


def card_corpus(
    df: DataFrame, chunk_size: int = CARD_CHUNK, merchant_buckets: int = 2000, hash: str = "xxhash64",
    split: bool = True, hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, Tokens]:
    """Card rows to sequences per (split, user, card), all splits in one plan."""
    keys = ["split", *card.KEYS] if split else card.KEYS
    if split and "split" not in df.columns:
        df, _ = temporal_split_date(df)
    pre = card.preprocess_card(
        df, merchant_buckets, hash, keep=["split"] if split else [], keys=keys, hot_rows=hot_rows
    )
    tokens = card.fitted_card_steps(merchant_buckets=merchant_buckets)
    rows = tokens.with_text(pre, keep=[*keys, "pos"])
    return corpus.to_sequences(rows, keys, [], chunk_size, position="pos"), tokens


def ndjson_corpus(
    txns: DataFrame, chunk_size: int = NDJSON_CHUNK, train_ratio: float = 0.8, val_ratio: float = 0.1,
    hash: str = "xxhash64", tokens: Tokens | None = None, buckets: int = 4000, name_buckets: int | None = None,
    amount: str = "quantile", amount_bins: int = 20, hot_rows: int = HOT_ROWS,
) -> tuple[DataFrame, Tokens]:
    """Expanded transactions to sequences per (split, user) with label and counts. The
    vocabulary is fitted on the training split only, or passed in. ``txns`` is read once per
    driver decision, so pass a stored table rather than unparsed JSON."""
    txns, _ = temporal_split_quantile(txns, "unix_ts", train_ratio, val_ratio, hot_rows=hot_rows)
    keys = ["split", "user_id"]
    pre = ndjson.preprocess_ndjson(txns, keys, hot_rows=hot_rows)
    if tokens is None:
        steps = ndjson.ndjson_steps(buckets, name_buckets, amount, amount_bins, hash=hash)
        # Nothing that is learned needs the history scan, so fitting reads cleaned rows.
        fit_rows = ndjson.clean_ndjson(txns.where(F.col("split") == "train")).withColumn("time_delta_s", F.lit(0.0))
        tokens = steps.fit(fit_rows, hot_rows)
    rows = tokens.with_text(pre, keep=[*keys, "pos", "label"])
    return corpus.to_sequences(rows, keys, [], chunk_size, label="label", position="pos"), tokens


def ndjson_samples(
    txns: DataFrame, tokens: Tokens, window: int = 512, max_txn_len: int = 32, min_length: int = 1, zero_delta: bool = False
) -> DataFrame:
    """Expanded transactions to one training sample per user.

    The gap of the oldest row kept needs one row more, so ``window + 1`` rows per user are
    kept before the shuffle; gaps, the final cut and the packing then share that shuffle,
    and no task holds more than ``window + 1`` rows of a user from each of its inputs.
    """
    if min_length > 1:
        enough = txns.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_length)
        txns = txns.join(enough.select("user_id"), "user_id", "left_semi")
    latest = last_n(ndjson.clean_ndjson(txns), ["user_id"], ndjson.history_order(), window + 1)
    if zero_delta:
        rows = latest.withColumn("time_delta_s", F.lit(0.0))
    else:
        rows = with_gap(latest, ["user_id"], ndjson.history_order(), "unix_ts", hot=NO_HOT_KEYS)
    return corpus.sft_samples(rows, tokens, max_txn_len=max_txn_len, window=window)


def run_card_job(spark: SparkSession, csv_path, out: str, force: bool = False, **kw) -> dict[str, DataFrame]:
    """CSV to split table, corpus table, text lines and corpus statistics under ``out``."""

    def split_rows():
        raw = readers.read_card_csv(spark, csv_path)
        return temporal_split_date(raw if "row_id" in raw.columns else readers.with_row_key(raw))[0]

    splits = writers.stage(spark, f"{out}/splits", split_rows, force, ["split"])
    numbered = lambda: corpus.with_line_numbers(card_corpus(splits, **kw)[0], ["split", *card.KEYS])
    seqs = writers.stage(spark, f"{out}/sequences", numbered, force, ["split"])
    if force or not writers.exists(spark, f"{out}/corpus"):
        writers.write_corpus(seqs, f"{out}/corpus")
    return {"splits": splits, "sequences": seqs, "stats": corpus.corpus_stats(seqs, ["split"])}


def run_ndjson_job(spark: SparkSession, path, out: str, force: bool = False, **kw) -> dict:
    """Nested records to a transaction table (the only pass over the JSON), corpus, sidecar,
    saved vocabulary and statistics under ``out``."""
    # The key follows from the row's content, so another build gives the same samples.
    txns = writers.stage(
        spark, f"{out}/transactions",
        lambda: readers.with_row_key(expand_records(readers.read_records(spark, path))), force,
    )
    vocab = f"{out}/vocab"
    known = Tokens.load(spark, vocab) if writers.exists(spark, vocab) and not force else None

    def sequences():
        seqs, fitted = ndjson_corpus(txns, tokens=known, **kw)
        if known is None:
            fitted.save(spark, vocab)
        return corpus.with_line_numbers(seqs, ["split", "user_id"])

    seqs = writers.stage(spark, f"{out}/sequences", sequences, force, ["split"])
    if force or not writers.exists(spark, f"{out}/sidecar"):
        writers.write_sidecar(seqs.select("split", "line_idx", "user_id", "chunk_id", "n_txns", "label"), f"{out}/sidecar")
    if force or not writers.exists(spark, f"{out}/corpus"):
        writers.write_corpus(seqs, f"{out}/corpus")
    return {"transactions": txns, "sequences": seqs, "tokens": Tokens.load(spark, vocab), "stats": corpus.corpus_stats(seqs, ["split"])}


def embed_rows(
    df: DataFrame, tokens: Tokens, keep: list[str], load_model=None, pooling: str = "last_token", max_length: int = 128,
    batch_size: int = 1024,
) -> DataFrame:
    """Prepared rows to one vector per row."""
    enc = tokens.encode(df, max_length, keep=keep)
    return embed_sequences(enc, load_model or one_hot_states(64), pooling=pooling, batch_size=batch_size)


def embed_splits(
    df: DataFrame, route_name: str = "card", tokens: Tokens | None = None, load_model=None, balanced_total: int = 1_000_000,
    pooling: str = "last_token", max_length: int = 128, seed: int = 42, hash: str = "xxhash64",
) -> DataFrame:
    """Vectors, labels and row keys of all splits in one job: a balanced sample of train
    and all of val and test. ``df`` has ``row_id`` and ``split``; the nested-record route
    takes its fitted tokens."""
    r = route(route_name)
    label = extract_label(df, "label" if route_name == "ndjson" else None)
    rows = df.withColumn("_y", label if label is not None else F.lit(None).cast("int"))
    if label is not None:
        # The sample is exact, so it is drawn before any row is prepared.
        train = sampling.balanced_sample(rows.where(F.col("split") == "train"), "_y", ["row_id"], balanced_total, 0.1, seed)
        rows = train.unionByName(rows.where(F.col("split") != "train"))
    keep = ["row_id", "split", "_y"]
    if route_name == "card":
        tokens = tokens or r.fitted_card_steps()
        if any(s.column == "time_delta_s" for s in tokens.steps):
            pre = r.preprocess_card(rows, hash=hash, keep=["split", "_y"], keys=["split", *r.KEYS], position=None)
        else:
            pre = r.clean_card(rows, hash=hash, keep=["split", "_y"])
    else:
        if tokens is None:
            raise ValueError("the ndjson route needs its fitted tokens")
        pre = r.preprocess_ndjson(rows, ["split", *r.KEYS], position=None)
    out = embed_rows(pre, tokens, keep, load_model, pooling, max_length)
    return out.withColumnRenamed("_y", "label")


def compare_models(
    raw: DataFrame, vectors: DataFrame, features: list[str] | None = None, k: int = 64, settings=None, route_name: str = "card"
) -> DataFrame:
    """Align raw rows with vectors by (split, row_id) and run the three models, on the raw
    features of the route."""
    features = features or {"card": CARD_FEATURES, "ndjson": NDJSON_FEATURES}[route_name]
    named = route(route_name).engineer_features(raw).select("split", "row_id", *[F.col(f"`{f}`") for f in features])
    return three_model_comparison(align(named, vectors), features, "embedding", "label", k, settings)


def run_report_job(
    spark: SparkSession, splits: DataFrame, out: str, route_name: str = "card", tokens: Tokens | None = None, load_model=None,
    features: list[str] | None = None, k: int = 64, settings=None, force: bool = False, **kw,
) -> dict[str, DataFrame]:
    """Split rows (``row_id``, ``split``) to vectors with their metadata, and the comparison of the
    three models as a table of metrics, under ``out``. Finished stages are read, not run again."""
    path = f"{out}/vectors"
    if force or not writers.exists(spark, path):
        vectors = embed_splits(splits, route_name, tokens, load_model, **kw)
        writers.write_embeddings(vectors, path)
    vectors = readers.read_embeddings(spark, path)
    meta = writers.stage(spark, f"{out}/vectors_metadata", lambda: embedding_metadata(vectors, label="label"), force)
    report = writers.stage(spark, f"{out}/metrics", lambda: compare_models(splits, vectors, features, k, settings, route_name), force)
    return {"vectors": vectors, "metadata": meta, "metrics": report}
