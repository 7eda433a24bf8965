"""First rows of groups, ids in order of appearance, and keep-first merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts a group is dealt to before its first rows are sought.
PARTS = 32


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """The first `most` rows of every group with their place (place) and whether the group has more (truncated).

    Every part of a group keeps its own first rows, so a group brings at most PARTS * (most + 1) rows together.
    order must be total within a group; nulls come first.
    """
    own = Window.partitionBy(*group, "_part").orderBy(*order)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(PARTS)))
    few = dealt.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= most + 1).drop("_part", "_n")
    placed = few.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return placed.withColumn("truncated", F.max("place").over(Window.partitionBy(*group)) > most).filter(F.col("place") <= most)


def first_texts(df: DataFrame, group: str, text: str, order: Sequence[str], most: int) -> DataFrame:
    """(group, order, place, truncated) of the first `most` distinct texts of every group, each at its first place. Empty
    and null texts are none. Texts are told apart by their SHA-256."""
    filled = df.filter(F.col(text) != "").select(group, F.sha2(text, 256).alias("_t"), *order)
    texts = filled.groupBy(group, "_t").agg(F.min(F.struct(*order)).alias("_at")).select(group, "_at.*")
    return first_per_group(texts, [group], order, most)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], keep: Sequence[str]) -> DataFrame:
    """One row per key: the columns `keep` of its first row in order. Combines before the shuffle."""
    first = F.min(F.struct(*[F.col(c) if isinstance(c, str) else c for c in order], F.struct(*keep).alias("_kept"))).alias("_first")
    return df.groupBy(*key).agg(first).select(*key, "_first._kept.*")


def numbered(prefix: str, place: Column, width: int = 4) -> Column:
    """PREFIX-0001."""
    return F.format_string(f"{prefix}-%0{width}d", place.cast("long"))
