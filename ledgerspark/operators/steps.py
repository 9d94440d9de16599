"""Token steps: how one input column becomes one token.

A step turns a column into a local index with native expressions only. Tokens that
follow a rule (``PREFIX_<number>``) are formatted from the index, labels come from a
sorted list, so ids are ``offset + index`` and encoding never joins a vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean

LITERAL_LABELS = 512      # learned labels up to here are literals of the plan
COLLECT_LABELS = 100_000  # and up to here are read by the driver; beyond, they stay a table


@dataclass(frozen=True)
class Step:
    """Base: ``column`` in, tokens ``prefix_*`` out. Subclasses give the index."""

    column: str
    prefix: str

    learned = None  # what ``fit`` has to learn: None, "edges" or "labels"

    @property
    def name(self) -> str:
        return f"{self.column}__{self.prefix}"

    @property
    def size(self) -> int:
        raise NotImplementedError

    def index(self) -> Column:
        raise NotImplementedError

    def token(self) -> Column:
        raise NotImplementedError

    def token_at(self, idx: Column) -> Column:
        """Token of a local index."""
        raise NotImplementedError

    def index_of(self, suffix: Column) -> Column:
        """Local index of the text behind ``prefix_``; null when it is no token."""
        raise NotImplementedError

    def vocab(self, spark: SparkSession) -> DataFrame:
        """(local_idx, token) rows of this step."""
        i = F.col("id").cast("int")
        return spark.range(self.size).select(i.alias("local_idx"), self.token_at(i).alias("token"))


@dataclass(frozen=True)
class NumberedStep(Step):
    """Tokens ``PREFIX_<number>`` for a run of integers."""

    @property
    def low(self) -> int:
        return 0

    @property
    def width(self) -> int:
        return 0

    def token(self) -> Column:
        return self.token_at(self.index())

    def token_at(self, idx: Column) -> Column:
        return clean.format_token(self.prefix, idx + F.lit(self.low), self.width)

    def index_of(self, suffix: Column) -> Column:
        n = suffix.try_cast("int")
        same = F.when(F.length(n.cast("string")) < self.width, F.lpad(n.cast("string"), max(self.width, 1), "0")).otherwise(
            n.cast("string")
        ) == suffix
        return F.when(same & n.between(self.low, self.low + self.size - 1), n - F.lit(self.low))


@dataclass(frozen=True)
class FixedStep(NumberedStep):
    """A bounded integer; null becomes the lower bound, the rest is clipped."""

    lo: int = 0
    hi: int = 23
    pad: int = 0

    @property
    def low(self) -> int:
        return self.lo

    @property
    def width(self) -> int:
        return self.pad

    @property
    def size(self) -> int:
        return self.hi - self.lo + 1

    def index(self) -> Column:
        v = F.coalesce(F.col(self.column).cast("int"), F.lit(self.lo))
        return clean.clip(v, self.lo, self.hi) - F.lit(self.lo)


@dataclass(frozen=True)
class ThresholdStep(NumberedStep):
    """How many thresholds a number reaches."""

    thresholds: tuple = ()

    @property
    def size(self) -> int:
        return len(self.thresholds) + 1

    def index(self) -> Column:
        return clean.amount_bucket(F.col(self.column), self.thresholds)


@dataclass(frozen=True)
class HashStep(NumberedStep):
    """Bucket of a value with too many categories to list."""

    buckets: int = 2048
    hash: str = "xxhash64"
    hashed: bool = False  # the column already holds buckets

    @property
    def size(self) -> int:
        return self.buckets

    def index(self) -> Column:
        c = F.col(self.column)
        if self.hashed:
            return F.pmod(F.coalesce(c, F.lit(0)), F.lit(self.buckets)).cast("int")
        return clean.hash_bucket(c, self.buckets, self.hash)


@dataclass(frozen=True)
class BinStep(NumberedStep):
    """Bins of a number with edges learned from the training rows."""

    bins: int = 10
    strategy: str = "quantile"
    edges: tuple | None = None

    learned = "edges"

    def __post_init__(self):
        if self.strategy not in ("quantile", "uniform", "kmeans"):
            raise ValueError(f"unknown strategy {self.strategy!r}")

    @property
    def size(self) -> int:
        return self.bins

    def index(self) -> Column:
        if self.edges is None:
            raise ValueError(f"step {self.name} is not fitted")
        return clean.digitize(F.col(self.column), list(self.edges), self.bins)


@dataclass(frozen=True)
class TimeDeltaStep(NumberedStep):
    """Logarithmic bins of a gap in seconds."""

    bins: int = 32
    max_years: float = 10.0

    @property
    def size(self) -> int:
        return self.bins

    def index(self) -> Column:
        return clean.log_time_bucket(F.col(self.column), self.bins, self.max_years)


@dataclass(frozen=True)
class MapStep(Step):
    """Category to label: a mapping, a list of values, integer ranges, or learned values.

    Labels are sorted, the default comes last unless it is a value itself.
    """

    mapping: tuple | None = None   # (value, label) pairs
    values: tuple | None = None
    ranges: tuple | None = None    # (low, high, label)
    default: str = "UNK"
    fitted: tuple | None = None    # learned labels, in order
    table: DataFrame | None = field(default=None, compare=False)  # learned labels, too many to list
    table_size: int = 0
    default_at: int = 0  # index of the default among the labels of the table

    @property
    def learned(self):
        return "labels" if not (self.mapping or self.values or self.ranges) else None

    def labels(self) -> list[str]:
        if self.ranges:
            found = sorted({r[2] for r in self.ranges})
        elif self.mapping:
            found = sorted({label for _, label in self.mapping})
        elif self.values:
            found = sorted(str(v) for v in set(self.values))
        else:
            if self.fitted is None:
                raise ValueError(f"step {self.name} is not fitted")
            found = list(self.fitted)
        return list(dict.fromkeys([*found, self.default]))

    @property
    def size(self) -> int:
        return self.table_size if self.table is not None else len(self.labels())

    def with_labels(self, labels: list[str]) -> "MapStep":
        return replace(self, fitted=tuple(sorted(labels)))

    @property
    def joined(self) -> bool:
        """Whether the index comes from a join instead of literals."""
        return self.table is not None or len(self.labels()) > LITERAL_LABELS

    def label(self) -> Column:
        c = F.col(self.column)
        if self.ranges:
            out = F.lit(self.default)
            for lo, hi, label in self.ranges:
                out = F.when(c.between(lo, hi), F.lit(label)).otherwise(out)
            return out
        if self.mapping:
            out = F.lit(self.default)
            for value, label in self.mapping:
                out = F.when(c == value, F.lit(label)).otherwise(out)
            return out
        if self.joined:
            return F.coalesce(F.col(f"_label_{self.name}"), F.lit(self.default))
        known = [v for v in self.labels()]
        return F.when(c.cast("string").isin(*known), c.cast("string")).otherwise(F.lit(self.default))

    def index(self) -> Column:
        if self.joined:
            return F.coalesce(F.col(f"_index_{self.name}"), F.lit(self._default_index())).cast("int")
        return (F.array_position(F.lit(self.labels()), self.label()) - 1).cast("int")

    def _default_index(self) -> int:
        return self.default_at if self.table is not None else self.labels().index(self.default)

    def token(self) -> Column:
        return F.concat(F.lit(self.prefix + "_"), self.label())

    def token_at(self, idx: Column) -> Column:
        return F.concat(F.lit(self.prefix + "_"), F.try_element_at(F.lit(self.labels()), idx + 1))

    def index_of(self, suffix: Column) -> Column:
        p = F.array_position(F.lit(self.labels()), suffix)
        return F.when(p > 0, p - 1).cast("int")

    def label_table(self, spark: SparkSession) -> DataFrame:
        """(local_idx, label) of a learned step."""
        if self.table is not None:
            return self.table
        return spark.createDataFrame([(i, v) for i, v in enumerate(self.labels())], "local_idx int, label string")

    def vocab(self, spark: SparkSession) -> DataFrame:
        if self.table is None:
            rows = [(i, f"{self.prefix}_{v}") for i, v in enumerate(self.labels())]
            return spark.createDataFrame(rows, "local_idx int, token string")
        return self.table.select("local_idx", F.concat(F.lit(self.prefix + "_"), "label").alias("token"))

    def attach(self, df: DataFrame) -> DataFrame:
        """Join index and label. Broadcast only while the label list is within the checked
        bound; a larger table is joined by shuffle, where skewed values are split at run time."""
        t = self.label_table(df.sparkSession).select(
            F.col("label").alias(f"_label_{self.name}"), F.col("local_idx").alias(f"_index_{self.name}")
        )
        if self.size <= COLLECT_LABELS:
            t = F.broadcast(t)
        return df.join(t, F.col(self.column).cast("string") == F.col(f"_label_{self.name}"), "left")


def steps_named(steps: list[Step]) -> dict[str, Step]:
    out = {}
    for s in steps:
        if s.name in out:
            raise ValueError(f"two steps named {s.name}")
        out[s.name] = s
    return out
