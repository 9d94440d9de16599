"""Vectors of sequences: scoring, pooling and simple array features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import PAD


def frequency_encode(x: Column, levels: int = 8, padding: float = 0.0) -> Column:
    """``sin`` then ``cos`` of ``2^k * pi * x``; all zero where ``x`` is the padding value."""
    v = x.cast("double")
    ks = F.lit([float(2**k) for k in range(levels)])
    wave = F.concat(
        F.transform(ks, lambda k: F.sin(k * F.lit(np.pi) * v)), F.transform(ks, lambda k: F.cos(k * F.lit(np.pi) * v))
    )
    return F.when(v == padding, F.array_repeat(F.lit(0.0), 2 * levels)).otherwise(wave)


def pool(df: DataFrame, keys: list[str], vector: str, order: list[Column], dim: int, how: str = "last", eps: float = 0.0) -> DataFrame:
    """One vector per key from the vectors of its rows: ``last``, ``first`` or ``mean``.

    Every form is a plain aggregate with partial results on the map side: the mean keeps
    ``dim`` running sums per key instead of exploding the vectors.
    """
    if how == "last":
        return df.groupBy(*keys).agg(F.max_by(vector, F.struct(*order)).alias("pooled"))
    if how == "first":
        return df.groupBy(*keys).agg(F.min_by(vector, F.struct(*order)).alias("pooled"))
    if how == "mean":
        sums = [F.sum(F.get(vector, i).cast("double")).alias(f"_s{i}") for i in range(dim)]
        g = df.groupBy(*keys).agg(F.count(vector).alias("_n"), *sums)
        n = F.greatest(F.col("_n"), F.lit(1)).cast("double") + F.lit(float(eps))
        return g.select(*keys, F.array(*[F.col(f"_s{i}") / n for i in range(dim)]).alias("pooled"))
    raise ValueError(f"unknown pooling {how!r}")


def user_pool(df: DataFrame, keys: list[str], vector: str, order: list[Column], dim: int, how: str = "cls") -> DataFrame:
    """Last step, or the mean with the small constant of the classifier head."""
    if how not in ("cls", "pool"):
        raise ValueError(f"unknown mode {how!r}")
    return pool(df, keys, vector, order, dim, "last" if how == "cls" else "mean", 0.0 if how == "cls" else 1e-7)


def pool_states(hidden: np.ndarray, mask: np.ndarray, how: str = "last_token") -> np.ndarray:
    """Pool ``[rows, steps, dim]`` states: the last unmasked step, the first, or the masked mean."""
    if how == "last_token":
        last = np.maximum(mask.sum(axis=1) - 1, 0)
        return hidden[np.arange(len(hidden)), last]
    if how == "first":
        return hidden[:, 0]
    if how == "mean":
        m = mask[:, :, None].astype(hidden.dtype)
        return (hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)
    raise ValueError(f"unknown pooling {how!r}")


def one_hot_states(dim: int) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Model factory used where no trained model is given: a token's state is a unit
    vector at ``id mod dim``."""

    def load():
        eye = np.eye(dim, dtype=np.float32)
        return lambda ids: eye[ids % dim]

    return load


def embed_sequences(
    df: DataFrame, load_model: Callable, ids: str = "input_ids", pooling: str = "last_token",
    batch_size: int = 1024, name: str = "embedding",
) -> DataFrame:
    """Add a vector per row by a batch model.

    ``load_model()`` runs once per task and returns ``ids[rows, steps] -> states[rows, steps,
    dim]``. The id arrays are padded to one length. Rows stream through as Arrow batches of at
    most ``batch_size``, ids and vectors without per-row objects; nothing is shuffled.
    """
    keep = [f for f in df.schema.fields if f.name != ids]
    schema = T.StructType([*keep, T.StructField(name, T.ArrayType(T.FloatType()))])
    names = [f.name for f in keep]

    def run(batches):
        model = load_model()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                part = whole.slice(at, batch_size)
                n = part.num_rows
                x = part.column(ids).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
                vec = pool_states(model(x), (x != PAD).astype(np.int64), pooling).astype(np.float32)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * vec.shape[1])
                out = pa.ListArray.from_arrays(ends, pa.array(vec.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], out], names=[*names, name])

    return df.mapInArrow(run, schema)


def embedding_metadata(df: DataFrame, name: str = "embedding", label: str | None = None) -> DataFrame:
    """Rows, positives and vector length per split."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.max(F.size(name)).alias("dim")]
    if label:
        aggs.append(F.sum(F.col(label).cast("bigint")).alias("n_pos"))
    return df.groupBy("split").agg(*aggs)
