"""Session plumbing shared by all operators: durable intermediate tables, size checks, hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes below which a measured side may be broadcast.
BROADCAST_BYTES = 32 << 20
#: A key counts as hot when it holds more rows than a shuffle partition should, or 1/HOT_SHARE of all where there are
#: fewer partitions than that; so there are no more hot keys than partitions, or than HOT_SHARE.
HOT_SHARE = 200
#: Facts that a single task can take whatever their keys.
PLAIN_ROWS = 200_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A session that names none gets a folder of its own if it is local; on a cluster
    that is an error, since executors would write where nobody else reads."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = context.getCheckpointDir()
    if not own:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        own = context.getCheckpointDir()
    return own


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_written: dict[str, list[str]] = {}


def clean_up(spark: SparkSession) -> int:
    """Delete the tables that this session's operators have written, once their results are no longer needed; how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete_path(spark, path)
    return len(paths)


class Stored:
    """A DataFrame written as parquet to the shared folder: lineage ends here and a lost executor costs nothing."""

    def __init__(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()):
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        _written.setdefault(self.spark.sparkContext.applicationId, []).append(self.path)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def bytes(self) -> int:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def small_enough(rows: int, row_bytes: int) -> bool:
    """Whether a counted side fits the broadcast bound, taking four times its packed size in memory."""
    return rows * row_bytes * 4 <= BROADCAST_BYTES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hot_rows_from(df: DataFrame, total: int) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1000, total // max(HOT_SHARE, partitions))


def hot_keys(df: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """Keys with more rows than hot_rows_from(): no more than shuffle partitions (or HOT_SHARE) by construction."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows_from(df, total)).select(*keys)


def lookup(facts: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner", counts: str | None = None) -> DataFrame:
    """Join facts to a table with one row per key. Facts under hot keys never move: their part of the
    table is broadcast (as few rows as hot_keys says); the rest is a plain shuffle join.
    counts: a column of small that already has each key's number of facts. Up to PLAIN_ROWS facts, which one
    task can take, are simply joined."""
    if total <= PLAIN_ROWS:
        return facts.join(small, key, how)
    hot = small.filter(F.col(counts) > hot_rows_from(facts, total)).select(key) if counts else hot_keys(facts.filter(F.col(key).isNotNull()), [key], total)
    hot_rows = small.join(F.broadcast(hot), key, "left_semi")
    marked = facts.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    cold = marked.filter(F.col("_hot").isNull()).drop("_hot").join(small, key, how)
    warm = marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot_rows), key, how)
    return cold.unionByName(warm)
