"""Gaps and places of histories that arrive in pieces, by keyed state across micro-batches.

What a key needs from its past is one small row: its newest time and how many rows it has had.
The rows of a micro-batch are put in order of time and continue from it. A history may so be spread
over any number of files, and a query that starts again from its checkpoint goes on where it stopped.

Keys are dealt to buckets by their hash, and a bucket's small rows are one state, packed into arrays: a
micro-batch so pays for the buckets it touches and for its rows, not for a Python group per key. State
lives in Spark's state store, whose changes go to the checkpoint folder; for very many keys choose the RocksDB
provider, which keeps them on disk. The rows of one bucket in one micro-batch are sorted in one task; what a
trigger may read (``maxFilesPerTrigger`` and the like) bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKETS = 1024  # groups and states that keys are dealt to; fixed for the life of a checkpoint


def _stored(state: GroupState) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a bucket with newest time (NaN: none), rows so far and time of expiry."""
    if not state.exists:
        return [], np.empty(0), np.empty(0, "int64"), np.empty(0, "int64")
    names, newest, n, until = state.get
    return names.split("\n"), np.frombuffer(newest), np.frombuffer(n, "int64"), np.frombuffer(until, "int64")


def _continue(ties: int, expire_ms: int | None):
    """The function that continues the rows of a bucket's keys from its state."""

    def run(bucket, rows, state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, more = "at", [f"t{i}" for i in range(ties)]
        now = pd.concat(list(rows), ignore_index=True)
        clock = None if expire_ms is None else state.getCurrentProcessingTimeMs()
        names, newest, n, until = _stored(state)
        # A bucket with new rows does not time out in their micro-batch, so the age of its keys is looked at here.
        if clock is not None:
            alive = until > clock
            names, newest, n, until = [k for k, a in zip(names, alive) if a], newest[alive], n[alive], until[alive]
        code, known = pd.factorize(np.concatenate([np.array(names, object), now["key"].to_numpy(object)]))
        new = len(known) - len(names)
        newest, n, until = (np.concatenate([x, np.full(new, v, x.dtype)]) for x, v in ((newest, np.nan), (n, 0), (until, 0)))
        now["who"] = code[len(names):]
        now = now.sort_values(["who", at, *more], kind="stable", na_position="last", ignore_index=True)
        who, times = now["who"].to_numpy(), now[at].to_numpy(float)
        first = np.concatenate([[True], who[1:] != who[:-1]])
        # The newest time before each row: times of a key rise, and unknown ones stand at the end.
        before = np.fmax(newest[who], np.where(first, np.nan, np.concatenate([[np.nan], times[:-1]])))
        gap = np.maximum(np.nan_to_num(times - before), 0.0)
        at_first = np.flatnonzero(first)
        count = np.diff(np.append(at_first, len(now)))
        place = n[who] + np.arange(len(now)) - np.repeat(at_first, count)
        late = times < newest[who]
        seen = who[at_first]
        newest[seen] = np.fmax(newest[seen], np.fmax.reduceat(times, at_first))
        n[seen] += count
        if clock is not None:
            until[seen] = clock + expire_ms
        state.update(("\n".join(known), newest.tobytes(), n.tobytes(), until.tobytes()))
        if clock is not None:
            state.setTimeoutDuration(expire_ms)
        yield now[[c for c in now.columns if c.startswith("c")]].assign(place=place, gap=gap, late=late)

    return run


def _packed(c: Column, kind: T.DataType) -> Column:
    """The value as text, as pandas keeps no difference between a missing and an undefined number
    and none between a large whole number and its neighbours."""
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _unpacked(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.from_json(c, kind)
    return F.unbase64(c) if isinstance(kind, T.BinaryType) else c.cast(kind)


def carry_gaps(
    rows: DataFrame, keys: list[str], seconds: str, ties: list[str] = (), name: str = "time_delta_s", position: str = "pos", late: str = "late",
    expire_seconds: float | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """A stream of rows with, per key, the seconds since the newest earlier row (``name``), the 0-based
    place (``position``) and whether the row came ``late``.

    Rows of a micro-batch are ordered by ``seconds`` and ``ties`` (numbers or texts), unknown times
    last. The first row of a key and rows without a time have gap 0. A late row is older than
    the newest of an earlier micro-batch: it is kept, with gap 0 and the next place, and the row
    after it counts from the newest time all the same. While files arrive in order of time, gaps and
    places are those of one scan over the whole history. A key that had no row for ``expire_seconds``
    of running time is forgotten and starts anew. Columns of the new names are replaced; a null key
    is a key; arrays, maps and structs pass through as JSON. ``buckets`` must stay the same for one checkpoint.
    """
    kinds = {f.name: f.dataType for f in rows.schema if f.name not in (name, position, late)}
    numeric = lambda c: isinstance(rows.schema[c].dataType, T.NumericType)
    tie = [(F.col(f"`{c}`").cast("double") if numeric(c) else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(f"t{i}") for i, c in enumerate(ties)]
    # As JSON, so that a null is none of the texts and no key holds a line break.
    key = F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in keys]))
    slim = rows.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), key.alias("key"), F.col(f"`{seconds}`").cast("double").alias("at"), *tie,
        *[_packed(F.col(f"`{c}`"), t).alias(f"c{i}") for i, (c, t) in enumerate(kinds.items())],
    )
    expire_ms = None if expire_seconds is None else max(1, int(expire_seconds * 1000))
    if expire_ms is not None:
        # Forgotten keys leave the state in the next micro-batch with rows; without this a drained
        # query with timeouts would run empty micro-batches for ever.
        rows.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    fields = [*[f"c{i} string" for i in range(len(kinds))], "place long", "gap double", "late boolean"]
    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    done = slim.groupBy("bucket").applyInPandasWithState(
        _continue(len(ties), expire_ms), ", ".join(fields), "names string, newest binary, n binary, until binary", "append", timeout
    )
    back = [_unpacked(F.col(f"c{i}"), t).alias(c) for i, (c, t) in enumerate(kinds.items())]
    return done.select(*back, F.col("place").alias(position), F.col("gap").alias(name), F.col("late").alias(late))
