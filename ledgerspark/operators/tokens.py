"""Fit a list of steps, then turn rows into tokens, ids and padded arrays."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import BOS, EOS, PAD, SPECIAL_TOKENS, UNK
from ..session import materialize
from . import steps as S
from .clusters import kmeans_edges
from .ordered import HOT_ROWS, ordered_scan, quantiles


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / n for i in range(n + 1)]


def fit_edges(df: DataFrame, column: str, bins: int, strategy: str = "quantile", hot_rows: int = HOT_ROWS) -> list[float]:
    """Bin edges of a numeric column, smallest and largest value included."""
    if strategy == "quantile":
        return quantiles(df, column, [i / bins for i in range(bins + 1)], hot_rows)
    x = F.col(column).cast("double")
    if strategy == "uniform":
        r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        return linspace(r["lo"], r["hi"], bins)
    if strategy == "kmeans":
        return kmeans_edges(df, column, bins)[0]
    raise ValueError(f"unknown strategy {strategy!r}")


def distinct_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, label): distinct non-null values of several columns in one pass."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("label")) for c in columns])
    )
    return df.select(pairs.alias("p")).select("p.column", "p.label").where(F.col("label").isNotNull()).distinct()


def fit_categories(df: DataFrame, columns: list[str], default: str | None = "UNK", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(column, label, local_idx): labels in text order, the default last unless it occurs."""
    found = distinct_labels(df, columns)
    ranked = ordered_scan(found, ["column"], [F.col("label")], position="local_idx", hot_rows=hot_rows)
    ranked = ranked.withColumn("local_idx", F.col("local_idx").cast("int"))
    if default is None:
        return ranked
    sizes = found.groupBy("column").agg(
        F.count(F.lit(1)).cast("int").alias("local_idx"), F.max(F.col("label") == default).alias("has")
    )
    missing = sizes.where(~F.col("has")).select("column", F.lit(default).alias("label"), "local_idx")
    return ranked.unionByName(missing)


@dataclass(frozen=True)
class Tokens:
    """An ordered list of steps. ``fit`` returns a fitted copy; the rest needs one."""

    steps: tuple
    fitted: bool = False

    def add_step(self, step: S.Step) -> "Tokens":
        return Tokens((*self.steps, step))

    # -- fitting -------------------------------------------------------------
    def fit(self, df: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> "Tokens":
        """Learn edges and labels from ``df``; without ``df`` only fixed steps are allowed.

        All learned label steps share one pass.
        """
        S.steps_named(self.steps)
        if df is not None:
            missing = sorted({s.column for s in self.steps} - set(df.columns))
            if missing:
                raise ValueError(f"columns {missing} not found")
        open_steps = [s for s in self.steps if s.learned]
        if open_steps and df is None:
            raise ValueError(f"step {open_steps[0].name} has to be fitted on data")
        known: dict[str, S.Step] = {}
        for s in open_steps:
            if s.learned == "edges":
                edges = fit_edges(df, s.column, s.bins, s.strategy, hot_rows)
                known[s.name] = replace(s, edges=tuple(float(e) for e in edges))
        known |= self._fit_labels(df, [s for s in open_steps if s.learned == "labels"], hot_rows)
        return Tokens(tuple(known.get(s.name, s) for s in self.steps), True)

    @staticmethod
    def _fit_labels(df, steps, hot_rows) -> dict:
        if not steps:
            return {}
        found = materialize(distinct_labels(df, [s.column for s in steps]), "labels")
        sizes = {r["column"]: r["n"] for r in found.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        small = [s for s in steps if sizes.get(s.column, 0) <= S.COLLECT_LABELS // len(steps)]
        labels: dict[str, list[str]] = {s.column: [] for s in small}
        if small:
            # Bounded: at most COLLECT_LABELS labels in all.
            for r in found.where(F.col("column").isin(*labels)).collect():
                labels[r["column"]].append(r["label"])
        out = {s.name: s.with_labels(labels[s.column]) for s in small}
        for s in steps:
            if s.name not in out:
                t = fit_categories(df, [s.column], s.default, hot_rows).select("local_idx", "label")
                t = materialize(t, "labels")
                facts = t.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("label") == s.default, F.col("local_idx"))).alias("d")).first()
                out[s.name] = replace(s, table=t, table_size=facts["n"], default_at=facts["d"])
        return out

    def _need_fit(self) -> None:
        if not self.fitted:
            raise ValueError("call fit() first")

    # -- vocabulary ------------------------------------------------------------
    @property
    def offsets(self) -> dict[str, int]:
        self._need_fit()
        at, out = len(SPECIAL_TOKENS), {}
        for s in self.steps:
            out[s.name] = at
            at += s.size
        return out

    @property
    def vocab_size(self) -> int:
        self._need_fit()
        return len(SPECIAL_TOKENS) + sum(s.size for s in self.steps)

    def vocab(self, spark: SparkSession) -> DataFrame:
        """(step, local_idx, token, global_id), the special tokens first."""
        self._need_fit()
        out = spark.createDataFrame(
            [("special", i, t, i) for i, t in enumerate(SPECIAL_TOKENS)],
            "step string, local_idx int, token string, global_id int",
        )
        for s in self.steps:
            rows = s.vocab(spark).select(
                F.lit(s.name).alias("step"), "local_idx", "token",
                (F.col("local_idx") + F.lit(self.offsets[s.name])).cast("int").alias("global_id"),
            )
            out = out.unionByName(rows)
        return out

    # -- rows --------------------------------------------------------------------
    def _attached(self, df: DataFrame) -> DataFrame:
        self._need_fit()
        for s in self.steps:
            if isinstance(s, S.MapStep) and s.learned and s.joined:
                df = s.attach(df)
        return df

    def _hidden(self) -> list[str]:
        return [f"_{k}_{s.name}" for s in self.steps for k in ("label", "index")]

    def token_columns(self) -> list[str]:
        return [f"tok_{s.prefix}" for s in self.steps]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Add one token column per step. Without learned lists too long for literals this
        is a single projection."""
        df2 = self._attached(df)
        kept = df.columns if keep is None else keep
        return df2.select(
            *[F.col(f"`{c}`") for c in kept], *[s.token().alias(f"tok_{s.prefix}") for s in self.steps]
        )

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def with_text(self, df: DataFrame, keep: list[str] | None = None, name: str = "txn_text") -> DataFrame:
        """Add the row's tokens joined by blanks; a missing token reads ``<unk>``."""
        df2 = self._attached(df)
        kept = df.columns if keep is None else keep
        parts = [F.coalesce(s.token(), F.lit(SPECIAL_TOKENS[UNK])) for s in self.steps]
        return df2.select(*[F.col(f"`{c}`") for c in kept], F.concat_ws(" ", *parts).alias(name))

    def ids(self) -> list[Column]:
        off = self.offsets
        return [F.coalesce(s.index() + F.lit(off[s.name]), F.lit(UNK)).cast("int") for s in self.steps]

    def encode(
        self, df: DataFrame, max_length: int = 4096, add_special: bool = True,
        keep: list[str] | None = None, name: str = "input_ids",
    ) -> DataFrame:
        """``<bos> ids <eos>`` padded to ``max_length``; ids that do not fit are dropped."""
        df2 = self._attached(df)
        kept = df.columns if keep is None else keep
        ids = self.ids()
        parts = [F.lit(BOS), *ids, F.lit(EOS)] if add_special else ids
        parts = parts[:max_length]
        arr = F.array(*parts)
        if len(parts) < max_length:
            arr = F.concat(arr, F.array_repeat(F.lit(PAD), max_length - len(parts)))
        return df2.select(*[F.col(f"`{c}`") for c in kept], arr.alias(name))

    def encode_txn(
        self, df: DataFrame, max_len: int = 32, keep: list[str] | None = None,
        name: str = "input_ids", mask: str = "attention_mask",
    ) -> DataFrame:
        """Ids of one transaction for the history model: when cut, the last id is ``<eos>``."""
        df2 = self._attached(df)
        kept = df.columns if keep is None else keep
        parts = [F.lit(BOS), *self.ids(), F.lit(EOS)]
        if len(parts) > max_len:
            parts = [*parts[: max_len - 1], F.lit(EOS)]
        arr = F.array(*parts)
        if len(parts) < max_len:
            arr = F.concat(arr, F.array_repeat(F.lit(PAD), max_len - len(parts)))
        # Ids are never <pad>, so the mask follows from the length alone.
        ones = F.concat(F.array_repeat(F.lit(1), len(parts)), F.array_repeat(F.lit(0), max_len - len(parts)))
        return df2.select(*[F.col(f"`{c}`") for c in kept], arr.alias(name), ones.alias(mask))

    # -- free text -----------------------------------------------------------------
    def _listed(self) -> list[S.Step]:
        return [s for s in self.steps if getattr(s, "table", None) is None]

    def _tabled(self, spark: SparkSession) -> DataFrame:
        """(token, global_id) of the steps whose labels stay a table."""
        out = None
        for s in self.steps:
            if getattr(s, "table", None) is not None:
                rows = s.vocab(spark).select("token", (F.col("local_idx") + F.lit(self.offsets[s.name])).alias("global_id"))
                out = rows if out is None else out.unionByName(rows)
        return out

    def id_of_token(self, token: Column) -> Column:
        """Id of a token text by rule: prefix, then number or label; ``<unk>`` if unknown. A
        column cannot look into a label table: with one, use ``with_ids`` or ``encode_text``."""
        if len(self._listed()) < len(self.steps):
            raise ValueError("some labels are kept in a table: use with_ids")
        return F.coalesce(self._id_by_rule(token), F.lit(UNK))

    def _id_by_rule(self, token: Column) -> Column:
        """Null where no rule knows the token."""
        off = self.offsets
        out = F.lit(None).cast("int")
        # Prefixes may extend one another (MERCH, MERCH_NAME): the longest is tried first.
        for s in sorted(self._listed(), key=lambda s: len(s.prefix)):
            suffix = F.substring(token, F.lit(len(s.prefix) + 2), F.length(token))
            hit = F.when(F.startswith(token, F.lit(s.prefix + "_")), s.index_of(suffix) + F.lit(off[s.name]))
            out = F.coalesce(hit.cast("int"), out)
        special = F.array_position(F.lit(SPECIAL_TOKENS), token)
        return F.when(special > 0, (special - 1).cast("int")).otherwise(out)

    def with_ids(self, df: DataFrame, token: str, name: str = "id") -> DataFrame:
        """Add the id of the token text in ``token``, however the labels are kept."""
        by_rule, table = self._id_by_rule(F.col(token)), self._tabled(df.sparkSession)
        if table is None:
            return df.withColumn(name, F.coalesce(by_rule, F.lit(UNK)))
        # A token that a rule knows takes no part in the join, so it makes no hot key.
        open_ = F.when(by_rule.isNull() & self._may_be_tabled(F.col(token)), F.col(token))
        t = table.select(F.col("token").alias("_on"), F.col("global_id").alias("_id"))
        out = df.withColumn("_open", open_).join(t, F.col("_open") == F.col("_on"), "left")
        return out.withColumn(name, F.coalesce(by_rule, F.col("_id"), F.lit(UNK)).cast("int")).drop("_open", "_on", "_id")

    def _may_be_tabled(self, token: Column) -> Column:
        out = F.lit(False)
        for s in self.steps:
            if getattr(s, "table", None) is not None:
                out = out | F.startswith(token, F.lit(s.prefix + "_"))
        return out

    def _in_table(self, i: Column) -> Column:
        out = F.lit(False)
        for s in self.steps:
            if getattr(s, "table", None) is not None:
                out = out | i.between(self.offsets[s.name], self.offsets[s.name] + s.size - 1)
        return out

    def token_of_id(self, i: Column) -> Column:
        """Token of an id, null if there is none or its label is kept in a table."""
        off = self.offsets
        out = F.when(i.between(0, len(SPECIAL_TOKENS) - 1), F.try_element_at(F.lit(SPECIAL_TOKENS), i + 1))
        for s in self._listed():
            lo = off[s.name]
            out = out.when(i.between(lo, lo + s.size - 1), s.token_at(i - F.lit(lo)))
        return out

    @staticmethod
    def _by_join(df, items: Column, wanted, by_rule, table: DataFrame, on: str, value: str, keys, name: str) -> DataFrame:
        """``items`` mapped entry by entry: by rule, or by a shuffled join with a label table
        too long to list. Only a row's different entries that no rule knows are sent to the
        join; what it finds comes back as a map of the row. ``keys`` identify a row; without
        them the rows are stored with a key of their own first."""
        columns = df.columns
        if not keys:
            df, keys = materialize(df.withColumn("_key", F.monotonically_increasing_id()), "lines"), ["_key"]
        w = df.select(*keys, F.explode(F.array_distinct(F.filter(items, wanted))).alias("_x"))
        found = w.join(table.select(F.col(on).alias("_on"), F.col(value).alias("_value")), F.col("_x") == F.col("_on"))
        maps = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_x", "_value"))).alias("_map"))
        maps = maps.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_map")
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        out = df.join(maps, same, "left")
        look = lambda x: F.when(F.col("_map").isNotNull(), F.try_element_at(F.col("_map"), x))
        out = out.withColumn(name, F.transform(items, lambda x: F.coalesce(by_rule(x), look(x))))
        return out.select(*[F.col(f"`{c}`") for c in columns if c != name], name)

    def encode_text(
        self, df: DataFrame, text: str = "text", max_length: int | None = None, name: str = "input_ids", keys: list[str] = ()
    ) -> DataFrame:
        """Ids of a token text, cut and padded to ``max_length`` if one is given. Works
        inside the row: nothing is exploded or shuffled, unless a step has more labels than
        can be listed; ``keys`` that identify the rows then save storing them."""
        self._need_fit()
        words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
        if max_length:
            words = F.slice(words, 1, max_length)
        table = self._tabled(df.sparkSession)
        if table is None:
            out = df.withColumn(name, F.transform(words, self.id_of_token))
        else:
            wanted = lambda x: self._may_be_tabled(x) & self._id_by_rule(x).isNull()
            out = self._by_join(df, words, wanted, self._id_by_rule, table, "token", "global_id", list(keys), name)
            out = out.withColumn(name, F.transform(name, lambda i: F.coalesce(i, F.lit(UNK)).cast("int")))
        if max_length:
            out = out.withColumn(name, F.concat(name, F.array_repeat(F.lit(PAD), F.lit(max_length) - F.size(name))))
        return out

    def decode_ids(self, df: DataFrame, ids: str = "input_ids", name: str = "text", keys: list[str] = ()) -> DataFrame:
        """Tokens of an id array; padding and unknown ids are left out."""
        table = self._tabled(df.sparkSession)
        if table is None:
            out = df.withColumn(name, F.transform(ids, self.token_of_id))
        else:
            out = self._by_join(df, F.col(ids), self._in_table, self.token_of_id, table, "global_id", "token", list(keys), name)
        kept = F.filter(name, lambda t: t.isNotNull() & (t != SPECIAL_TOKENS[PAD]))
        return out.withColumn(name, F.array_join(kept, " "))

    # -- saving ------------------------------------------------------------------------
    def save(self, spark: SparkSession, path: str, mode: str = "overwrite") -> None:
        """Parameters with learned edges and labels as one small table; label tables too
        long for the driver are written next to it."""
        self._need_fit()
        rows = []
        for i, s in enumerate(self.steps):
            d = {k: v for k, v in s.__dict__.items() if k != "table"}
            rows.append((i, type(s).__name__, json.dumps(d, ensure_ascii=False)))
            if isinstance(s, S.MapStep) and s.table is not None:
                s.table.write.mode(mode).parquet(f"{path.rstrip('/')}_labels/{i}")
        df = spark.createDataFrame(rows, "pos int, kind string, params string")
        df.coalesce(1).write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, classes: tuple[type, ...] = ()) -> "Tokens":
        """``classes`` names step classes of the caller's own; a stored kind is one of them or
        of the library's, and one that is neither raises."""
        own = {c.__name__: c for c in classes}
        steps = []
        for r in spark.read.parquet(path).orderBy("pos").collect():  # one row per step
            d = json.loads(r["params"])
            as_tuple = lambda v: tuple(as_tuple(x) for x in v) if isinstance(v, list) else v
            d = {k: as_tuple(v) for k, v in d.items()}
            if d.get("table_size"):
                d["table"] = spark.read.parquet(f"{path.rstrip('/')}_labels/{r['pos']}")
            kind = own.get(r["kind"]) or getattr(S, r["kind"], None)
            if kind is None:
                raise ValueError(f"no step class {r['kind']}: name it in classes")
            steps.append(kind(**d))
        return Tokens(tuple(steps), True)
