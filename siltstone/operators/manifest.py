"""Checks of a paired-sample manifest: members, invariants, leaks between splits, repeated ids, census."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import lookup

# Fixed values: (origin, role) to (group, injection, behavior).
GROUPS = {("benign", "clean"): (1, False, "BENIGN"), ("benign", "injected"): (2, True, "BENIGN"), ("malware", "clean"): (3, False, "MALICIOUS"), ("malware", "injected"): (4, True, "MALICIOUS")}
LEAST_JACCARD = 0.95


def members(manifest: DataFrame) -> DataFrame:
    """Two rows per pair: pair_id, origin, role, split, and the member's fields."""
    sides = [manifest.select("pair_id", "origin", F.lit(role).alias("role"), F.col("split").alias("pair_split"), f"{role}.*") for role in ("clean", "injected")]
    return sides[0].unionByName(sides[1])


def member_violations(manifest: DataFrame) -> DataFrame:
    """(pair_id, role, reason) of members that contradict the group table; rows of another origin are named too."""
    spark = manifest.sparkSession
    table = spark.createDataFrame([(*k, *v) for k, v in GROUPS.items()], "origin string, role string, want_group int, want_injection boolean, want_behavior string")
    rows = members(manifest).join(F.broadcast(table), ["origin", "role"], "left")  # four rows
    reasons = F.array_compact(F.array(
        F.when(F.col("want_group").isNull(), "origin"),
        F.when(~F.col("group_no").eqNullSafe(F.col("want_group")) & F.col("want_group").isNotNull(), "group_no"),
        F.when(~F.col("gt_injection").eqNullSafe(F.col("want_injection")) & F.col("want_group").isNotNull(), "gt_injection"),
        F.when(~F.col("gt_malware_behavior").eqNullSafe(F.col("want_behavior")) & F.col("want_group").isNotNull(), "gt_malware_behavior"),
    ))
    return rows.withColumn("reason", F.explode(reasons)).select("pair_id", "role", "reason")


def pair_violations(manifest: DataFrame) -> DataFrame:
    """(pair_id, reason): members of different splits, different code, equal files, or too little likeness."""
    reasons = F.array_compact(F.array(
        F.when(~(F.col("clean.split").eqNullSafe(F.col("split")) & F.col("injected.split").eqNullSafe(F.col("split"))), "split"),
        F.when(~F.col("clean.code_region_sha256").eqNullSafe(F.col("injected.code_region_sha256")), "code_region_sha256"),
        F.when(F.col("clean.sha256").eqNullSafe(F.col("injected.sha256")), "sha256"),
        F.when(~F.coalesce(F.col("invariance.jaccard").between(LEAST_JACCARD, 1.0), F.lit(False)), "jaccard"),
    ))
    return manifest.withColumn("reason", F.explode(reasons)).select("pair_id", "reason")


def leaks(manifest: DataFrame, family: str) -> DataFrame:
    """(family, splits, pairs) of families in more than one split, by exact name."""
    rows = manifest.filter(F.col(family).isNotNull() & F.col("split").isNotNull())
    found = rows.groupBy(F.col(family).alias("family")).agg(F.array_sort(F.collect_set("split")).alias("_s"), F.countDistinct("pair_id").alias("pairs"))
    return found.filter(F.size("_s") > 1).select("family", F.array_join("_s", ",").alias("splits"), "pairs")


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def census(manifest: DataFrame) -> DataFrame:
    """(origin, split, locus, pairs, rows, jaccard_sum) with subtotals; null in place of 'all' is told by level."""
    rows = manifest.select(F.coalesce("origin", F.lit("?")).alias("origin"), F.coalesce("split", F.lit("?")).alias("split"), F.coalesce("insertion_locus", F.lit("?")).alias("locus"), "pair_id", F.col("invariance.jaccard").alias("j"))
    cube = rows.rollup("origin", "split", "locus").agg(F.grouping_id().cast("int").alias("level"), F.countDistinct("pair_id").alias("pairs"), F.count("*").alias("n_rows"), F.round(F.sum("j"), 4).alias("jaccard_sum"))
    return cube.select("origin", "split", "locus", "level", "pairs", "n_rows", "jaccard_sum")


def rejection_rate(accepted: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """(rejected, considered, rate): distinct rejected ids over all distinct ids; the rate of none is null."""
    marked = accepted.select(key, F.lit(False).alias("_r")).unionByName(rejected.select(key, F.lit(True).alias("_r"))).filter(F.col(key).isNotNull())
    each = marked.groupBy(key).agg(F.max("_r").alias("_r"))
    return each.agg(F.count_if("_r").alias("rejected"), F.count("*").alias("considered")).withColumn("rate", F.round(F.try_divide("rejected", "considered"), 4))


def unmatched_outcomes(outcomes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sample_id, reason) of outcomes whose sample is not in the manifest, or under another group or split."""
    known = members(manifest).select("sample_id", F.col("group_no").alias("_group"), F.col("pair_split").alias("_split")).filter(F.col("sample_id").isNotNull()).distinct()
    met = outcomes.select("sample_id", "group_no", "split").join(known.withColumn("_known", F.lit(True)), "sample_id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown").when(~F.col("group_no").eqNullSafe(F.col("_group")), "group_no").when(~F.col("split").eqNullSafe(F.col("_split")), "split")
    return met.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("sample_id", "reason")


def late_uses(manifest: DataFrame, family: str, order: list[str]) -> DataFrame:
    """(pair_id, family, split, first_split): rows whose family was first used in another split, in order. The first use
    of a family is found by an aggregate and looked up, so a family of any size is no one task's."""
    rows = manifest.filter(F.col(family).isNotNull() & F.col("split").isNotNull()).select("pair_id", F.col(family).alias("family"), "split", *[c for c in order if c != "pair_id"])
    first = rows.groupBy("family").agg(F.min(F.struct(*order, "split")).alias("_f")).select("family", F.col("_f.split").alias("first_split"))
    return lookup(rows, first, "family", rows.count()).filter(F.col("split") != F.col("first_split")).select("pair_id", "family", "split", "first_split")


def errors(manifest: DataFrame) -> DataFrame:
    """(check, subject, role, reason): everything that is wrong with a manifest, as one table: members that contradict
    the group table, pairs that break an invariant (of which unequal code regions are a reason to reject the pair, the
    others violations), families in several splits, and repeated pair and sample ids."""
    none = F.lit(None).cast("string")
    pairs = pair_violations(manifest).withColumn("check", F.when(F.col("reason") == "code_region_sha256", "rejection").otherwise("pair"))
    found = member_violations(manifest).select(F.lit("member").alias("check"), F.col("pair_id").alias("subject"), "role", "reason")
    found = found.unionByName(pairs.select("check", F.col("pair_id").alias("subject"), none.alias("role"), "reason"))
    for family in ("malware_family", "payload_family"):
        found = found.unionByName(leaks(manifest, family).select(F.lit("leak").alias("check"), F.col("family").alias("subject"), none.alias("role"), F.lit(family).alias("reason")))
    for table, key in ((manifest, "pair_id"), (members(manifest), "sample_id")):
        found = found.unionByName(repeated(table, key).select(F.lit("repeat").alias("check"), F.col(key).alias("subject"), none.alias("role"), F.lit(key).alias("reason")))
    return found


class Unmatched(ValueError):
    """Outcomes that don't belong to the manifest."""


def require_matched(outcomes: DataFrame, manifest: DataFrame, shown: int = 10) -> DataFrame:
    """outcomes, if every one is of a sample of the manifest, under its group and split; else an error that names the
    first few."""
    bad = unmatched_outcomes(outcomes, manifest).orderBy("sample_id", "reason").limit(shown).collect()
    if bad:
        raise Unmatched("; ".join(f"{r.sample_id}: {r.reason}" for r in bad))
    return outcomes


def rejection_errors(accepted: DataFrame, rejected: DataFrame, most: float, key: str = "pair_id") -> DataFrame:
    """(subject, reason): ids both accepted and rejected, rejected ids that repeat, and a rate of rejection above `most`."""
    text = lambda df: df.select(F.col(key).cast("string").alias("subject"))
    both = text(rejected).distinct().join(text(accepted).distinct(), "subject", "left_semi").withColumn("reason", F.lit("accepted and rejected"))
    twice = repeated(rejected, key).select(F.col(key).cast("string").alias("subject"), F.lit("rejected twice").alias("reason"))
    over = rejection_rate(accepted, rejected, key).filter(F.col("rejected") > F.lit(most) * F.col("considered")).select(F.lit(None).cast("string").alias("subject"), F.lit("too many rejected").alias("reason"))
    return both.unionByName(twice).unionByName(over)
