"""Summaries of a folder that keeps receiving files: every file is read once.

The store holds one row per file (path, size, time of change) with its counts and sketches. A
refresh lists the folder, reads only files the store does not know in their present form, and
adds their rows. Rows of files that have gone or changed stay in the store and are left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sketches import K, LG_K, merge_summaries, part_summaries
from .writers import exists

FILE = ["file_path", "file_size", "file_time"]


def _identity() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    ]


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path`` to read a file by, and what tells its present form apart. No content is read. Spark
    does not list files without a byte, nor names that begin with ``_`` or ``.``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", *_identity())


class FileSummaries:
    """``read(paths)`` gives the rows of files as a plain projection or filter of a file reader, so
    that Spark still knows each row's file. A file without rows has a stored row of its own too."""

    def __init__(
        self, spark: SparkSession, folder: str, store: str, read: Callable[[list[str]], DataFrame], pattern: str = "*",
        quantiles: list[str] = (), distinct: list[str] = (), positive: Column | None = None, k: int = K, lg_k: int = LG_K,
    ):
        self.spark, self.folder, self.store, self.read, self.pattern, self.k = spark, folder, store, read, pattern, k
        self._summary = lambda df: part_summaries(df, FILE, quantiles, distinct, positive, k, lg_k)

    def _stored(self) -> DataFrame | None:
        return self.spark.read.parquet(self.store) if exists(self.spark, self.store) else None

    def refresh(self) -> list[str]:
        """Read the new and changed files; their paths. The list is no longer than what Spark's
        own reader keeps of the files it is given."""
        listed = list_files(self.spark, self.folder, self.pattern)
        known = self._stored()
        new = listed if known is None else listed.join(known.select(*FILE), FILE, "left_anti")
        # A reader takes these marks in a path for a pattern.
        paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r["path"]) for r in new.select("path").collect()]
        if not paths:
            return []
        found = self._summary(self.read(paths).select("*", *_identity()))
        empty = new.select(*FILE).join(found.select(*FILE), FILE, "left_anti").withColumn("n_rows", F.lit(0).cast("bigint"))
        found.unionByName(empty, allowMissingColumns=True).write.mode("append").parquet(self.store)
        return paths

    def parts(self) -> DataFrame:
        """The stored rows of the files that are there now, each file once."""
        known = self._stored()
        if known is None:
            raise FileNotFoundError(f"no summaries at {self.store}: call refresh() first")
        now = list_files(self.spark, self.folder, self.pattern).select(*FILE)
        # Two refreshes at one time may both have read a file.
        return known.join(now, FILE, "left_semi").dropDuplicates(FILE)

    def total(self) -> DataFrame:
        """One row over all present files; ``n_files`` counts them."""
        parts = self.parts()
        return merge_summaries(parts.withColumn("n_files", F.lit(1).cast("bigint")).drop(*FILE), k=self.k)
