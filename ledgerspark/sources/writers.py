"""Writers. Each output is one table, partitioned by ``split`` where there are splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)


def _in_line_order(df: DataFrame):
    """Rows dealt out and sorted so that a folder's files, taken in the order of their names,
    hold line 0, 1, .. of each split."""
    by = [c for c in ("split", "line_idx") if c in df.columns]
    out = df.repartitionByRange(*by).sortWithinPartitions(*by) if "line_idx" in by else df
    return lambda o: o.write.partitionBy("split") if "split" in by else o.write, out


def write_corpus(df: DataFrame, path: str, text: str = "text", mode: str = "overwrite") -> None:
    """Sequences as text lines, each split in a folder of its own; with ``line_idx``, line i of
    a split is the one numbered i."""
    writer, out = _in_line_order(df)
    kept = [F.col("split")] if "split" in df.columns else []
    writer(out.select(*kept, F.col(text).alias("value"))).mode(mode).text(path)


def write_sidecar(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metadata of the sequences as JSON lines, null fields kept, in the lines of the corpus."""
    writer, out = _in_line_order(df)
    writer(out).mode(mode).option("ignoreNullFields", "false").json(path)


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite", metadata: DataFrame | None = None) -> None:
    df.write.mode(mode).partitionBy("split").parquet(path)
    if metadata is not None:
        metadata.write.mode(mode).json(path.rstrip("/") + "_metadata")


def write_predictions(df: DataFrame, path: str, metrics: DataFrame | None = None, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)
    if metrics is not None:
        metrics.write.mode(mode).json(path.rstrip("/") + "_metrics")


def exists(spark: SparkSession, path: str) -> bool:
    """True when a finished table lies at ``path``; a half-written one does not count."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, build, force: bool = False, partition_by: list[str] | None = None) -> DataFrame:
    """Read the table at ``path``, building it first if it is missing or ``force`` is set.
    A skipped stage does not even plan its input."""
    if force or not exists(spark, path):
        w = build().write.mode("overwrite")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.parquet(path)


def write_shards(df: DataFrame, path: str, shards: int, key: str, seed: int = 42, mode: str = "overwrite") -> DataFrame:
    """Training shards: every row in exactly one, by a hash of ``key`` spread over a
    fixed number of files, rows in a seeded order inside each file."""
    out = assign_shards(df, shards, key)
    order = F.xxhash64(F.lit(seed), F.col("shard"), *[F.col(f"`{c}`") for c in df.columns])
    files = max(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The second key spreads one shard over several tasks; a hot user spreads with it.
    spread = F.pmod(order, F.lit(max(1, files // shards)))
    (
        out.withColumn("_order", order)
        .repartition(files, F.col("shard"), spread)
        .sortWithinPartitions("shard", "_order")
        .drop("_order")
        .write.mode(mode)
        .partitionBy("shard")
        .parquet(path)
    )
    return df.sparkSession.read.parquet(path)


def assign_shards(df: DataFrame, shards: int, key: str) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
