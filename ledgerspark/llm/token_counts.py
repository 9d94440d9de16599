"""Prefix token counts: the exact number of tokens of every prefix of a text, stored once.

``prefix_counts`` runs the prefix programme (``prefix_program``) over each text and keeps the
prefixes at which the count changes, as lengths in bytes and tokens, and for every number of
tokens the longest prefix within it. Counts may fall: a letter can close a word that is one
token. Truncation and budget questions are then look-ups in these arrays, by bisection and by
place; nothing is encoded again. A prefix ends between characters: a cut inside a character, or
inside characters that the tokenizer's normalization joins, is the cut before them. White space
at the end of a prefix adds no token.

The programme knows tokenizers that cut at white space and then by ``pieces_bpe.PIECE``. For any
other file only prefixes that end a run between white space are stored, counted by the library.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces_bpe import Encoder, encoder
from .prefix_program import prefixes
from .texts import strings


def _ends_and_counts(enc: Encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    if enc.by_run:
        return prefixes(enc).char_counts(text)
    done = enc.library.encode(text, add_special_tokens=False)
    total = len(done.ids)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Only white space is a safe place to cut whatever the tokenizer; runs are told apart by it.
    ends = np.array([e for _, e in done.offsets], np.int64)
    chars = np.array([c.isspace() for c in text] + [True], bool)
    cut = np.append(np.flatnonzero((ends[1:] > ends[:-1]) & chars[np.minimum(ends[:-1], len(text))]), total - 1)
    size = np.cumsum([0, *[len(c.encode("utf-8", "surrogatepass")) for c in text]])
    return size[ends[cut]], cut + 1


def _changes(ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.diff(counts, prepend=0) != 0
    return ends[new], counts[new]


def prefix_table(enc: Encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte lengths, rising, of the prefixes at which the count changes, and their counts."""
    return _changes(*_ends_and_counts(enc, text))


def budget_table(ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bytes of the longest prefix of at most 0, 1, .. tokens, up to the whole text's."""
    least = np.minimum.accumulate(counts[::-1])[::-1]  # of this prefix and all longer ones
    total = int(counts[-1]) if len(counts) else 0
    k = np.searchsorted(least, np.arange(total + 1), "right")
    return np.append(0, ends)[k]


def prefix_counts(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens``, ``prefix_bytes``, ``prefix_tokens``, ``budget_bytes``.

    One row per row of ``docs``; other columns are not read. A null text counts as empty:
    no bytes, no tokens, empty arrays (``budget_bytes``: one 0). Repeated ids stay repeated. No tokens are added at
    begin or end; strings of special tokens are read as the library does by default.
    """
    id_type = docs.schema[id].dataType

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for lo, hi, part in strings(batch.column(1)):
                counted = [_ends_and_counts(enc, t) for t in part]
                changes = [_changes(*c) for c in counted]
                budgets = [budget_table(*c) for c in counted]

                def lists(arrays):
                    at = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                    return pa.ListArray.from_arrays(at, np.concatenate(arrays).astype(np.int32))

                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array([len(t.encode()) for t in part], pa.int64()),
                        pa.array([len(b) - 1 for b in budgets], pa.int64()),
                        lists([e for e, _ in changes]), lists([c for _, c in changes]), lists(budgets),
                    ],
                    [id, "n_bytes", "n_tokens", "prefix_bytes", "prefix_tokens", "budget_bytes"],
                )

    schema = f"`{id}` {id_type.simpleString()}, n_bytes long, n_tokens long, prefix_bytes array<int>, prefix_tokens array<int>, budget_bytes array<int>"
    return docs.select(id, text).mapInArrow(run, schema)


def _stored_until(values: str, limit: Column) -> Column:
    """How many of the rising ``values`` are at most ``limit``: a bisection by halved steps."""
    step = lambda n, k: n + F.pow(F.lit(2), k).cast("int")
    taken = lambda n, k: (step(n, k) <= F.size(values)) & (F.try_element_at(values, step(n, k)) <= limit)
    return F.reduce(F.sequence(F.lit(30), F.lit(0)), F.lit(0), lambda n, k: F.when(taken(n, k), step(n, k)).otherwise(n))


def tokens_within(limit: Column | int) -> Column:
    """Tokens of the prefix of ``limit`` bytes."""
    n = _stored_until("prefix_bytes", F.lit(limit))
    return F.coalesce(F.try_element_at("prefix_tokens", F.nullif(n, F.lit(0))), F.lit(0)).cast("long")


def longest_within(budget: Column | int) -> Column:
    """Bytes of the longest prefix of at most ``budget`` tokens that does not end with white space."""
    place = F.least(F.lit(budget), F.col("n_tokens")).cast("int") + 1
    return F.coalesce(F.when(place > 0, F.try_element_at("budget_bytes", place)), F.lit(0)).cast("long")


def count_at(enc: Encoder, text: str, prefix_bytes, prefix_tokens, cut: int) -> int:
    """Exact tokens of the first ``cut`` bytes: a stored count. Only for a tokenizer that the
    programme does not know are the tokens of the run that is cut added."""
    k = int(np.searchsorted(prefix_bytes, cut, "right"))
    start, base = (int(prefix_bytes[k - 1]), int(prefix_tokens[k - 1])) if k else (0, 0)
    if enc.by_run:
        return base
    rest = text.encode("utf-8", "surrogatepass")[start:cut].decode(errors="ignore")
    return base + len(enc.encode(rest)) // 4
