"""Evidence rows of a decision: which slots an action has, what fills them, and ids in one sequence per artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.budgets import numbered
from siltstone.operators.prefix_sums import prefix_sums

# Action, place of the slot, what fills it (seed_if_none: the seed where there are no findings), decision.
SLOTS = (
    ("TAG_AS_EVIDENCE", 0, "findings", "TAG_AS_EVIDENCE"),
    ("TAG_AS_EVIDENCE", 1, "seed_if_none", "TAG_AS_EVIDENCE"),
    ("CAUTIOUS_QUARANTINE", 0, "seed", "SANITIZE_AND_STRIP"),
    ("CAUTIOUS_QUARANTINE", 1, "seed", "ESCALATE_TO_HUMAN"),
    ("ESCALATE_AND_INCONCLUSIVE", 0, "findings", "TAG_AS_EVIDENCE"),
    ("ESCALATE_AND_INCONCLUSIVE", 1, "seed", "ESCALATE_TO_HUMAN"),
    ("PIPELINE_ABSTENTION", 0, "seed", "ESCALATE_TO_HUMAN"),
    ("PIPELINE_ABSTENTION", 1, "findings", "TAG_AS_EVIDENCE"),
)
SEED_DETECTOR, RECORD_VERSION = "TELEMETRY_ADAPTER", "1.0.0"
METHODS = "array<struct<detector_name:string,rule_or_model_version:string,score:double>>"
_CONTENT = ("detection_source", "prov_type", "locator", "section_or_pid", "parent_artifact_sha256", "detection_methods", "transform_chain", "technique_ids", "confidence_score", "summary")


def slot_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SLOTS, "action string, slot int, fill string, decision string")


def rule_evidence(findings: DataFrame) -> DataFrame:
    """findings of rules (with rule, version, technique_id, score, confidence, detector) with the content columns of an
    evidence row: one method, and the technique."""
    method = F.array(F.struct(F.col("detector").alias("detector_name"), F.col("version").alias("rule_or_model_version"), F.col("score").cast("double").alias("score")))
    return findings.withColumn("detection_methods", method.cast(METHODS)).withColumn("technique_ids", F.array("technique_id")).withColumn("confidence_score", F.col("confidence"))


def coverage_seeds(results: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, content columns): what an artifact's evidence says where it is of no single finding: a method for each
    detector result, in order, no technique, no confidence. A key's results are its few detectors."""
    methods = F.transform(F.sort_array(F.collect_list(F.struct(order, "detector", F.coalesce("score", F.lit(0.0)).alias("score")))), lambda x: F.struct(x["detector"].alias("detector_name"), F.lit(RECORD_VERSION).alias("rule_or_model_version"), x["score"].alias("score")))
    rows = results.groupBy(*keys).agg(methods.cast(METHODS).alias("detection_methods"))
    text, none = lambda x: F.lit(x).cast("string"), F.lit(None).cast("string")
    return rows.select(
        *keys, text("SANDBOX_API_LOG").alias("detection_source"), text("JSON_LOG_POINTER").alias("prov_type"), text("/behavior").alias("locator"), none.alias("section_or_pid"), none.alias("parent_artifact_sha256"), "detection_methods",
        F.array().cast("array<string>").alias("transform_chain"), F.array().cast("array<string>").alias("technique_ids"), F.lit(0.0).alias("confidence_score"), none.alias("summary"),
    )


def emit(decisions: DataFrame, findings: DataFrame, seeds: DataFrame, key: str, order: list[str], year: int, first: int = 1, raw_locator: str | None = None) -> DataFrame:
    """(evidence_id, key, content columns, policy_decision, pipeline_action, status_flags): the evidence of every artifact.

    decisions: key, action and flags (a list in one text) of each artifact; an action without slots, such as ALLOW, gives
    nothing. findings and seeds have key and the content columns; findings come in `order`. Findings are placed by
    slot; where an action takes none, as in quarantine, they are not evidence. raw_locator: where an abstention's seed
    points to. An artifact's findings are those its budget left, so one task can number them.
    """
    slots = decisions.select(key, "action", "flags").join(F.broadcast(slot_table(decisions.sparkSession)), "action")  # eight rows
    given = findings.select(key, *order, *_CONTENT)
    some = given.select(key).distinct().withColumn("_some", F.lit(True))
    no_order = [F.lit(None).cast(findings.schema[c].dataType).alias(c) for c in order]
    own = slots.filter(F.col("fill") == "findings").join(given, key)
    bare = slots.filter(F.col("fill") != "findings").join(some, key, "left").filter((F.col("fill") == "seed") | F.col("_some").isNull()).drop("_some")
    bare = bare.join(seeds.select(key, *_CONTENT), key).select(*slots.columns, *no_order, *_CONTENT)
    if raw_locator is not None:
        bare = bare.withColumn("locator", F.when(F.col("action") == "PIPELINE_ABSTENTION", F.lit(raw_locator)).otherwise(F.col("locator")))
    rows = own.select(*slots.columns, *order, *_CONTENT).unionByName(bare)
    place = F.row_number().over(Window.partitionBy(key).orderBy("slot", *order)) + (first - 1)
    flags = F.array_distinct(F.filter(F.split(F.coalesce("flags", F.lit("")), ","), lambda x: x != ""))
    return rows.select(numbered(f"EVD-{year:04d}", place).alias("evidence_id"), key, *_CONTENT, F.col("decision").alias("policy_decision"), F.col("action").alias("pipeline_action"), flags.alias("status_flags"))


def _filled(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column)) != "", F.lit(False))


def violations(evidence: DataFrame, key: str) -> DataFrame:
    """(evidence_id, reason): evidence rows that break the contract of their columns."""
    share = lambda x: F.coalesce(x.between(0.0, 1.0) & ~F.isnan(x), F.lit(False))
    sha = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    methods = F.coalesce(F.size("detection_methods") > 0, F.lit(False)) & F.forall("detection_methods", lambda m: (F.coalesce(F.trim(m["detector_name"]), F.lit("")) != "") & (F.coalesce(F.trim(m["rule_or_model_version"]), F.lit("")) != "") & share(m["score"]))
    address = F.col("prov_type") != "VIRTUAL_ADDRESS"
    checks = {
        "evidence_id": F.col("evidence_id").rlike(r"^EVD-[0-9]{4}-[0-9]{4,}$"), "artifact": sha(key), "locator": _filled("locator") & _filled("prov_type"), "virtual_address": address | (sha("parent_artifact_sha256") & F.col("locator").startswith("0x")),
        "detection_source": _filled("detection_source"), "detection_methods": F.coalesce(methods, F.lit(False)), "confidence_score": share(F.col("confidence_score")), "status_flags": F.size(F.array_distinct("status_flags")) == F.size("status_flags"),
        "technique_ids": F.forall("technique_ids", lambda x: F.coalesce(F.trim(x) != "", F.lit(False))),
    }
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(fine, F.lit(False)), F.lit(n)) for n, fine in checks.items()]))
    return evidence.select("evidence_id", F.explode(bad).alias("reason"))


def blocked_calls(calls: DataFrame, key: str, order: list[str], year: int, after: DataFrame) -> DataFrame:
    """(evidence_id, key, order, policy_decision, pipeline_action, technique_id): a row for every tool call that was blocked
    (decision HARD_BLOCK), numbered on from an artifact's other evidence. after: (key, n), how many ids are used up."""
    blocked = calls.filter(F.col("decision") == "HARD_BLOCK").join(after.select(key, F.col("n").alias("_n")), key, "left")
    ranked = prefix_sums(blocked.withColumn("_one", F.lit(1)), [key], order, "_one", calls.count(), "_k")  # an artifact may hold most calls
    place = F.col("_k") + F.coalesce("_n", F.lit(0)) + 1
    return ranked.select(numbered(f"EVD-{year:04d}", place).alias("evidence_id"), key, *order, F.lit("HARD_BLOCK").alias("policy_decision"), F.lit("HARD_BLOCK").alias("pipeline_action"), F.lit("AML.T0053").alias("technique_id"))
