"""Detector results and coverage folded per artifact, and looked up in the decision table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Processing, detection, action, forward, sanitize, flags, escalation, immediate.
DECISIONS = (
    ("COMPLETE", "DETECTED", "TAG_AS_EVIDENCE", True, True, "", "P3", False),
    ("COMPLETE", "NOT_DETECTED", "ALLOW", True, False, "", None, False),
    ("COMPLETE", "INCONCLUSIVE", "CAUTIOUS_QUARANTINE", True, True, "DISAGREEMENT", "P2", False),
    ("PARTIAL", "DETECTED", "ESCALATE_AND_INCONCLUSIVE", True, True, "TRUNCATED", "P1", False),
    ("PARTIAL", "NOT_DETECTED", "ESCALATE_AND_INCONCLUSIVE", True, True, "TRUNCATED", "P1", False),
    ("PARTIAL", "INCONCLUSIVE", "ESCALATE_AND_INCONCLUSIVE", True, True, "TRUNCATED,DISAGREEMENT", "P1", False),
    ("FAILED", "DETECTED", "PIPELINE_ABSTENTION", False, True, "TRUNCATED", "P1", True),
    ("FAILED", "NOT_DETECTED", "PIPELINE_ABSTENTION", False, True, "TRUNCATED", "P1", True),
    ("FAILED", "INCONCLUSIVE", "PIPELINE_ABSTENTION", False, True, "TRUNCATED", "P1", True),
)
STATES = ("COMPLETE", "PARTIAL", "FAILED")
# Technique names and what they are under the other scheme.
TECHNIQUES = {
    "AML.T0051.001": ("LLM Prompt Injection: Indirect", "LLM01:2025-PromptInjection"),
    "AML.T0034": ("Cost Harvesting", None),
    "AML.T0043": ("Craft Adversarial Data", "LLM01:2025-PromptInjection"),
    "AML.T0043.001": ("Craft Adversarial Data: Black-Box Optimization", "LLM01:2025-PromptInjection"),
    "AML.T0048": ("External Harms", None),
    "AML.T0051": ("LLM Prompt Injection", "LLM01:2025-PromptInjection"),
    "AML.T0053": ("AI Agent Tool Invocation", "LLM06:2025-ExcessiveAgency"),
    "AML.T0054": ("LLM Jailbreak", "LLM01:2025-PromptInjection"),
    "AML.T0056": ("Extract LLM System Prompt", "LLM07:2025-SystemPromptLeakage"),
    "AML.T0057": ("LLM Data Leakage", "LLM07:2025-SystemPromptLeakage"),
    "AML.T0015": ("Evade AI Model", "LLM01:2025-PromptInjection"),
}
NO_MAPPING = "No direct mapping"


def decision_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DECISIONS, "processing string, detection string, action string, forward boolean, sanitize boolean, flags string, escalation string, immediate boolean")


def technique_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in TECHNIQUES.items()], "technique_id string, technique_name string, owasp string")


def named_techniques(df: DataFrame, codes: str) -> DataFrame:
    """A row for each code of a list written with commas or blanks, with its place, its name, and why it has none; codes
    without a name or a mapping get NO_MAPPING."""
    each = df.select("*", F.posexplode(F.filter(F.split(F.col(codes), r"[,\s]+"), lambda x: x != "")).alias("code_pos", "technique_id"))
    named = each.join(F.broadcast(technique_table(df.sparkSession)), "technique_id", "left")  # eleven rows
    reason = F.when(F.col("technique_name").isNull(), "the code is not in the table")
    return named.withColumn("no_mapping_reason", reason).withColumn("technique_name", F.coalesce("technique_name", F.lit(NO_MAPPING))).withColumn("owasp", F.coalesce("owasp", F.lit(NO_MAPPING)))


def first_mapping(named: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, owasp): of the codes of each key, the mapping of the first that has one, else NO_MAPPING."""
    place = F.when(F.col("owasp") != NO_MAPPING, F.col("code_pos"))
    return named.groupBy(*keys).agg(F.coalesce(F.min_by("owasp", place), F.lit(NO_MAPPING)).alias("owasp"))


def folded_coverage(states: DataFrame, keys: list[str]) -> DataFrame:
    """The worst of the states of each key; a state that is unknown or null counts as FAILED."""
    worst = F.max(F.when(F.col("state") == "COMPLETE", 0).when(F.col("state") == "PARTIAL", 1).otherwise(2))
    return states.groupBy(*keys).agg(worst.alias("_w")).select(*keys, F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("_w") + 1).alias("processing"))


def detection_state(results: DataFrame, keys: list[str], required: tuple[str, ...] = (), ordinal: str | None = None) -> DataFrame:
    """One row per key: the first of disagreement, a required detector missing or errored (unless processing has
    FAILED), any valid positive, all required ones clean, else inconclusive.

    results has keys, detector, positive, errored, has_provenance and processing. A positive without provenance
    counts as errored. Of a required detector's several results the last by `ordinal` counts, or, without one, they are
    clean if all are; all results count as positives. Of several processing states the worst counts.
    """
    errored = F.col("errored") | (F.col("positive") & ~F.col("has_provenance"))
    found = F.col("positive") & ~errored
    clean = ~F.col("positive") & ~errored
    worst = F.max(F.when(F.col("processing") == "COMPLETE", 0).when(F.col("processing") == "PARTIAL", 1).otherwise(2))
    agg = [F.max(found).alias("any_found"), F.max(clean).alias("any_clean"), worst.alias("_w")]
    for i, name in enumerate(required):
        mine = lambda x, name=name: F.when(F.col("detector") == name, x)
        if ordinal is None:
            agg += [F.max(mine(errored)).alias(f"bad{i}"), F.min(mine(clean)).alias(f"clean{i}")]
        else:
            agg += [F.max_by(x, mine(F.col(ordinal))).alias(f"{n}{i}") for n, x in (("bad", errored), ("clean", clean))]
    rows = results.groupBy(*keys).agg(*agg)
    bad, all_clean = F.lit(False), F.lit(bool(required))
    for i in range(len(required)):
        bad = bad | F.coalesce(F.col(f"bad{i}"), F.lit(True))
        all_clean = all_clean & F.coalesce(F.col(f"clean{i}"), F.lit(False))
    rows = rows.withColumn("processing", F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("_w") + 1))
    state = (
        F.when(F.col("any_found") & F.col("any_clean"), "INCONCLUSIVE").when((F.col("processing") != "FAILED") & bad, "INCONCLUSIVE").when(F.col("any_found"), "DETECTED").when(all_clean, "NOT_DETECTED").otherwise("INCONCLUSIVE")
    )
    return rows.select(*keys, "processing", state.alias("detection"))


def decided(states: DataFrame) -> DataFrame:
    return states.join(F.broadcast(decision_table(states.sparkSession)), ["processing", "detection"])  # nine rows
