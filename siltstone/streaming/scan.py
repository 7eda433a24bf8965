"""The row-wise operators over streams of strings.

Normalization and rule scanning keep no state, so they run on a stream as they do on a table. First hits
per artifact and rule need a watermark: a hit is passed on once, repeats within the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.text import normalized
from siltstone.operators import rules


def hits(strings: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Every rule hit on the normalized text of a stream or table of strings."""
    done = strings.withColumn("_n", normalized(F.col("raw_string"), pairs)).withColumn("normalized", F.col("_n.normalized")).drop("_n")
    return rules.scan(done, "normalized")


def first_hits(found: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """One hit per artifact, branch, rule and identifier within the watermark."""
    return found.withWatermark(time, delay).dropDuplicatesWithinWatermark(["artifact_sha256", "branch", "rule", "identifier"])


def hit_counts(found: DataFrame, time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Hits by window and rule; later ones than the watermark allows are left out."""
    return found.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), "rule").agg(F.count("*").alias("hits"))


def write(found: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to parquet; once: all that is there now, then stop."""
    writer = found.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
