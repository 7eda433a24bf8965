"""Scanning texts with the rule set: literal patterns inside one projection, matches exploded."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules, their patterns by identifier, and their metadata.
RULES: dict[str, dict[str, str]] = {
    "Static_Promptware_InstructionBypass": {
        "override_1": r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)",
        "override_2": r"disregard\s+(all\s+)?(prior|previous)\s+(system\s+)?(commands|context)",
        "override_3": r"you\s+are\s+now\s+(in\s+)?(developer\s+mode|unrestricted|a\s+benign)",
        "verdict_1": r"classify\s+this\s+(file|sample|program)\s+as\s+(clean|safe|benign)",
        "verdict_2": r"do\s+not\s+(report|alert|flag)\s+this\s+(threat|malware|binary)",
        "verdict_3": r"output\s+verdict:\s*benign",
        "role_1": r"system\s+override:\s*role\s*=\s*",
        "role_2": r"assistant\s+should\s+say\s+nothing\s+is\s+wrong",
    },
    "Promptware_InstructionBypassExt": {
        "override_reset": r"reset\s+your\s+(instructions|context|prompt)",
        "verdict_goodware": r"classify\s+(this\s+|the\s+)?(file|sample|binary|program|it)\s+as\s+goodware",
        "verdict_no_ioc": r"do\s+not\s+(report|mention)\s+(the\s+|any\s+)?(c2|command[-\s]and[-\s]control|indicators?\s+of\s+compromise|iocs?|exfiltration)",
        "verdict_no_mal": r"(conclude|report|state|say|declare)\s+(that\s+)?(there\s+is\s+)?no\s+malicious\s+(behavior|activity)",
        "role_acting": r"you\s+(are|will\s+be)\s+acting\s+as\s+(a\s+)?(trusted\s+)?(admin|analyst|supervisor)",
        "role_clearance": r"(has|with|granted)\s+admin\s+clearance",
        "role_approved": r"(is|in|on)\s+the\s+(approved|whitelisted)\s+software\s+list",
    },
    "Promptware_FakeStructure": {
        "verdict_json": r'"malicious"\s*:\s*false',
        "verdict_tag": r"</?(official_verdict|analysis_result)[^>]*>",
        "verdict_safe": r'"verdict"\s*:\s*"(benign|safe|clean)"',
        "end_marker": r"={3,}\s*end\s+(of\s+)?(report|data|analysis)",
        "threat_none": r'"threat_?level"\s*:\s*"(none|safe)"',
        "whitelist": r"this\s+(file|sample|binary|program|executable)\s+(is|was|has\s+been)\s+(whitelisted|pre-?cleared|(a\s+)?(legitimate|trusted)\s+(software|scanner|sample|file))",
    },
    "Promptware_Roleplay": {
        "auth_1": r"I(\s+am|'m)\s+(the\s+)?(security\s+lead|admin|analyst|supervisor)\b.{0,80}(authori[sz]e|instruct|approve|clear|benign|clean|safe|ignore|skip|suppress|do\s+not|don't)",
        "auth_2": r"(authori[sz]e|instruct|clear(ed)?)\s+you\s+to\s+(ignore|skip|classify|mark|report|output|treat|suppress|disregard|say|declare|label)",
        "auth_3": r"(entering|switch(ing|ed)?\s+to|now\s+in|enable[sd]?)\s+(a\s+)?(maintenance|developer|debug)\s+mode\b.{0,60}(ignore|skip|disable|bypass|no\s+(alerts?|restrictions?|filters?)|benign|clean|safe)",
        "auth_4": r"this\s+(file|sample|binary|program|executable)\s+(is|was|has\s+been)\s+(pre-?cleared|(pre-?)?approved|whitelisted)|pre-?cleared\s+(by|sample|file)",
        "auth_5": r"suppress\s+(all\s+)?(malware\s+)?(alerts|detections)",
        "auth_6": r"(red[-\s]?team|penetration\s+test|pentest)\b.{0,40}(mark|treat|classify|report|label|ignore)\b.{0,30}(benign|clean|safe|alerts|detections)",
    },
    "Promptware_Evasion": {
        "leet_ignore_1": "1gnore",
        "leet_ignore_2": "ig9ore",
        "leet_ignore_3": "ign0re",
        "leet_ignore_4": "ignor3",
        "leet_ignore_5": "19n0r3",
        "leet_ignore_6": "i9nore",
        "leet_ignore_7": "1gn0re",
        "leet_benign_1": "b3nign",
        "leet_benign_2": "ben1gn",
        "leet_benign_3": "b3n1gn",
        "leet_clean_1": "cl34n",
        "leet_clean_2": "cle4n",
        "leet_clean_3": "c134n",
        "leet_clean_4": "cl3an",
        "leet_goodware_1": "g00dware",
        "leet_goodware_2": "goodw4r",
        "leet_goodware_3": "g00dw4r",
        "leet_verdict_1": "v3rdict",
        "leet_verdict_2": "verd1ct",
        "spaced_dash": r"i[-_.]g[-_.]n[-_.]o[-_.]r[-_.]e",
        "spaced_space": "i g n o r e",
    },
}
RULE_VERSIONS = {"Static_Promptware_InstructionBypass": "1.4.0"}
OTHER_VERSION = "ext-1.0.0"
RULE_TECHNIQUE, RULE_SCORE, RULE_CONFIDENCE = "AML.T0051.001", 1.0, 0.9
NETWORK_RULE = "Dynamic_Cuckoo_Network_Telemetry"
_IDENTIFIERS = sorted({n for p in RULES.values() for n in p})
USER_AGENT_PATTERN, REQUEST_PATTERN = "(ignore|bypass).*prompt", "(override_role|verdict=benign)"


def jvm_pattern(pattern: str) -> str:
    r"""The pattern for Java: letters without case, '.' stops at line feeds only, and \b knows ASCII words only."""
    return "(?id)" + pattern.replace(r"\b", "(?![A-Za-z0-9_])")


def anchor(pattern: str) -> str:
    """The longest run of letters and digits, in lower case, that any match of a pattern contains; '' if none is sure."""
    bare = re.sub(r"\\.[+*?]?|\[[^\]]*\][+*?]?", "\0", pattern)
    while (outer := re.sub(r"\([^()]*\)(?:[?*+]|\{[0-9,]+\})?", "\0", bare)) != bare:
        bare = outer
    if "|" in bare:
        return ""
    bare = re.sub(r".(?:[?*]|\{0[0-9,]*\})", "\0", bare, flags=re.DOTALL)
    return max(re.findall(r"[a-z0-9]+", re.sub(r"\{[0-9,]+\}", "\0", bare).lower()), key=len, default="")


def matches(text: Column, low: Column | None = None) -> Column:
    """Array of struct(rule_ord, rule, identifier) of the patterns that a text meets. A pattern is tried only on texts
    that contain its anchor; low is the text in lower case, where that is a column already."""
    low = F.lower(text) if low is None else low
    hits = []
    for i, (rule, patterns) in enumerate(RULES.items()):
        for name, p in patterns.items():
            meets = text.rlike(jvm_pattern(p))
            meets = F.contains(low, F.lit(anchor(p))) & meets if anchor(p) else meets
            hits.append(F.when(meets, F.struct(F.lit(i).alias("rule_ord"), F.lit(rule).alias("rule"), F.lit(name).alias("identifier"))))
    return F.array_compact(F.array(*hits))


def scan(df: DataFrame, text: str) -> DataFrame:
    """A row for each pattern that a row's text meets: df with rule_ord, rule and identifier. Null meets nothing."""
    low = df.withColumn("_low", F.lower(text))  # a column of its own: made once for all patterns
    return low.withColumn("_m", F.explode(matches(F.col(text), F.col("_low")))).select(*df.columns, "_m.*")


def rule_table(spark) -> DataFrame:
    """(rule_ord, rule, version, technique_id, score, confidence, patterns): the metadata of every rule."""
    rows = [(i, r, RULE_VERSIONS.get(r, OTHER_VERSION), RULE_TECHNIQUE, RULE_SCORE, RULE_CONFIDENCE, len(p)) for i, (r, p) in enumerate(RULES.items())]
    return spark.createDataFrame(rows, "rule_ord int, rule string, version string, technique_id string, score double, confidence double, patterns int")


def findings(hits: DataFrame, keys: list[str]) -> DataFrame:
    """One finding per keys and rule: its identifiers, and the rule's version, technique, score and confidence."""
    by_rule = hits.groupBy(*keys, "rule_ord", "rule").agg(F.array_sort(F.collect_set("identifier")).alias("identifiers"))
    return by_rule.join(F.broadcast(rule_table(hits.sparkSession).drop("patterns")), ["rule_ord", "rule"])  # five rows


def deduplicated(hits: DataFrame, group: list[str], order: list[str], keep: list[str], chain: str | None = None) -> DataFrame:
    """One row per group and rule: the columns of its first hit, how many rows hit, all identifiers, and, where hits have
    a transform chain, its distinct steps in the order they first appear in (order tells rows apart).

    Hits are put together by row first, so that what is counted is distinct and no group is collected.
    """
    steps = [] if chain is None else [F.min(chain).alias("_chain")]
    by_row = hits.groupBy(*group, "rule", *order).agg(F.min(F.struct(*keep)).alias("_k"), F.collect_set("identifier").alias("_i"), *steps)  # a rule's identifiers at most
    seen = [F.max(F.array_contains("_i", n)).alias(f"_i{k}") for k, n in enumerate(_IDENTIFIERS)]
    merged = by_row.groupBy(*group, "rule").agg(F.min(F.struct(*order, "_k")).alias("_first"), F.count("*").alias("hits"), *seen)
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_i{k}"), F.lit(n)) for k, n in enumerate(_IDENTIFIERS)])), ",")
    found = merged.select(*group, "rule", *[F.col(f"_first._k.{k}").alias(k) for k in keep], "hits", names.alias("identifiers"))
    if chain is None:
        return found
    each = by_row.select(*group, "rule", F.struct(*order).alias("_at"), F.posexplode("_chain").alias("_p", "step"))
    first = each.groupBy(*group, "rule", "step").agg(F.min(F.struct("_at", "_p")).alias("_at"))  # a few kinds of step
    merged = first.groupBy(*group, "rule").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "step"))), lambda x: x["step"]).alias(chain))
    same = lambda a, b: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "rule")]
    both = found.alias("a").join(merged.alias("b"), same("a", "b"), "left")
    return both.select("a.*", F.coalesce(F.col(f"b.{chain}"), F.array().cast("array<string>")).alias(chain))


def coverage(rows: DataFrame, scanned: str, keys: list[str]) -> DataFrame:
    """(keys, state, payloads, unread): whether all payloads of a key could be scanned: COMPLETE, else PARTIAL, or FAILED
    if none of those it has could be. A null payload is one that could not be read."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("payloads"), F.count_if(F.col(scanned).isNull()).alias("unread"))
    state = F.when(F.col("unread") == 0, "COMPLETE").when(F.col("unread") < F.col("payloads"), "PARTIAL").otherwise("FAILED")
    return counted.select(*keys, state.alias("state"), "payloads", "unread")


def network_hits(records: DataFrame) -> DataFrame:
    """The records whose user agent or request meets the network rule, upper and lower case apart; null meets nothing."""
    meets = lambda column, pattern: F.coalesce(F.col(column).rlike("(?d)" + pattern), F.lit(False))
    return records.filter(meets("user_agent", USER_AGENT_PATTERN) | meets("uri", REQUEST_PATTERN))


def offsets(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, rule, identifier, start_byte, matched): every match of every pattern in a column of bytes, by offset.

    Patterns are met byte by byte, letters without case in ASCII only. Null and empty bytes have no matches. Only bytes
    that meet some pattern, read as Latin-1, leave the JVM, and there only patterns whose anchor they contain are tried.
    """
    kind = df.schema[key].dataType.simpleString()
    compiled = [(rule, name, anchor(p).encode(), re.compile(p.encode(), re.IGNORECASE)) for rule, patterns in RULES.items() for name, p in patterns.items()]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, found = [], []
            for i, raw in enumerate(batch.column("data").to_pylist()):
                low = raw.lower()
                for rule, name, sure, pattern in compiled:
                    if sure in low:
                        met = [(rule, name, m.start(), m[0]) for m in pattern.finditer(raw)]
                        owner += [i] * len(met)
                        found += met
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.binary()))]], names=[key, "rule", "identifier", "start_byte", "matched"])

    some = F.size(matches(F.decode(F.col(data), "ISO-8859-1"))) > 0
    return df.filter(some).select(F.col(key).alias("key"), F.col(data).alias("data")).mapInArrow(stage, f"`{key}` {kind}, rule string, identifier string, start_byte long, matched binary")
