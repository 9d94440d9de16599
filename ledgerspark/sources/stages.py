"""Stages that are rebuilt exactly when what they are made of has changed.

A stage's digest covers its name, its parameters, its input files and the digests of the stages
above it, so a change anywhere reaches all stages below and no other. The output lies in a folder
named by the digest: a finished folder is right by its name, a half-written one has no
``_SUCCESS`` and is built again, and going back to earlier parameters finds the earlier output.
Older outputs stay until someone deletes them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .incremental import list_files
from .writers import exists


def files_digest(spark: SparkSession, path: str, content: bool = False) -> str:
    """A digest of all files below ``path``, in any order: path, size and time of change, or path
    and bytes with ``content`` (files of up to 2 GB each, read by the executors; touching a file
    changes nothing then). Sums of 60-bit digest parts combine in each task, so no list is gathered."""
    if content:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        mark = F.concat_ws("\n", "path", F.sha2("content", 256))
    else:
        files = list_files(spark, path)
        mark = F.concat_ws("\n", "file_path", "file_size", F.unix_micros("file_time"))
    key = F.sha2(mark, 256)
    word = lambda i: F.sum(F.conv(F.substring(key, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"w{i}")
    return ":".join(str(x) for x in files.agg(F.count(F.lit(1)).alias("n"), *[word(i) for i in range(4)]).first())


@dataclass
class Stage:
    """``build(spark, parents, inputs)`` gets the parents' tables and the input paths. Raise ``version``
    when the code of ``build`` changes what it gives; parameters must be JSON values."""

    name: str
    build: Callable[[SparkSession, list[DataFrame], list[str]], DataFrame]
    inputs: list[str] = field(default_factory=list)
    parents: list[Stage] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    version: int = 1
    partition_by: list[str] = field(default_factory=list)
    content: bool = False


def stage_digest(spark: SparkSession, stage: Stage, seen: dict[int, str] | None = None) -> str:
    """Digest of a stage and all above it; a stage that several share is looked at once."""
    seen = {} if seen is None else seen
    if id(stage) not in seen:
        made_of = {
            "name": stage.name, "version": stage.version, "params": stage.params, "partition_by": stage.partition_by,
            "inputs": [[p, files_digest(spark, p, stage.content)] for p in stage.inputs],
            "parents": [stage_digest(spark, p, seen) for p in stage.parents],
        }
        seen[id(stage)] = hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()
    return seen[id(stage)]


def run_stages(spark: SparkSession, target: Stage, root: str, force: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The table of ``target`` and the names of the stages that were built, parents first. A stage
    that is up to date is not planned, nor is anything above it that only it needs. ``force``
    names stages to build in any case, with all stages below them."""
    digests: dict[int, str] = {}
    stage_digest(spark, target, digests)
    built: list[str] = []
    done: dict[int, DataFrame] = {}
    due: dict[int, bool] = {}

    def forced(stage: Stage) -> bool:
        if id(stage) not in due:
            due[id(stage)] = stage.name in force or any([forced(p) for p in stage.parents])
        return due[id(stage)]

    def table(stage: Stage) -> DataFrame:
        if id(stage) not in done:
            path = f"{root.rstrip('/')}/{stage.name}/{digests[id(stage)]}"
            if forced(stage) or not exists(spark, path):
                out = stage.build(spark, [table(p) for p in stage.parents], stage.inputs).write.mode("overwrite")
                (out.partitionBy(*stage.partition_by) if stage.partition_by else out).parquet(path)
                built.append(stage.name)
            done[id(stage)] = spark.read.parquet(path)
        return done[id(stage)]

    return table(target), built
