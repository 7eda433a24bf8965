"""Capabilities out of static-capability reports: rule map, subscope filter, current and legacy technique lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import escape_pointer
from siltstone.functions.variants import is_a, missing, object_variant, part, text_at

# Markers of subscope rules, and the technique list under its current and its former name.
SUBSCOPE_MARKERS = ("is_subscope_rule", "capa/subscope", "capa/subscope-rule")
TECHNIQUE_LISTS = ("attack", "att&ck")


def _at(key: str) -> str:
    return f'$["{key}"]'


def rules(reports: DataFrame, keys: list[str]) -> DataFrame:
    """keys with rule_pos, rule, body (a variant): the rules of each report in the document's order.

    A repeated rule name counts once, at its first place with its last body. Broken reports and those whose rules
    are no object have none.
    """
    listed = F.map_entries(F.from_json(F.get_json_object("report", "$.rules"), "map<string,string>"))
    found = reports.select(*keys, listed.alias("l")).withColumn("n", F.transform("l", lambda e: e["key"]))
    at = lambda place, e: F.struct(place.cast("int").alias("rule_pos"), e["key"].alias("rule"), e["value"].alias("body"))
    last = F.filter("l", lambda e, i: ~F.exists(F.slice("n", i + 2, F.size("n")), lambda k: k == e["key"]))
    repeated = F.size(F.array_distinct("n")) < F.size("n")
    placed = F.when(repeated, F.transform(last, lambda e: at(F.array_position("n", e["key"]) - 1, e))).otherwise(F.transform("l", lambda e, i: at(i, e)))
    return found.select(*keys, F.explode(placed).alias("r")).select(*keys, "r.rule_pos", "r.rule", object_variant(F.col("r.body")).alias("body"))


def entries(reports: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule_pos, rule, entry_pos, locator, namespace, tactic, technique_id, technique_name and fault: a row for
    each technique entry of each rule, read as an object or as one line 'Tactic::Technique::Sub [id]', and one for each
    rule that cannot be read.

    A rule of which a marker is literally true is a subscope rule and gives nothing. The former list is read only
    where the current one is absent, whatever that is; null is an empty list. A tactic or name that is missing is ''.
    fault says why a row names no technique: a rule, a meta or an entry of another type, or no id; null if it does.
    """
    meta = part("body", "$.meta")
    flagged = " OR ".join(f"(schema_of_variant(try_variant_get(meta, '{_at(m)}', 'variant')) = 'BOOLEAN' AND try_variant_get(meta, '{_at(m)}', 'boolean'))" for m in SUBSCOPE_MARKERS)
    now, before = TECHNIQUE_LISTS
    listed = reports.sparkSession.sql(f"""
        WITH m AS (SELECT * EXCEPT (body), {is_a("body", "OBJECT")} AS rule_fits, {meta} AS meta FROM {{rows}}),
        l AS (SELECT *, {part("meta", _at(now))} IS NOT NULL AS is_now, coalesce({part("meta", _at(now))}, {part("meta", _at(before))}) AS list FROM m WHERE NOT coalesce({flagged}, false))
        SELECT * EXCEPT (meta, rule_fits), coalesce({text_at("meta", "$.namespace")}, '') AS namespace,
            CASE WHEN NOT rule_fits THEN 'rule is no object' WHEN NOT {is_a("meta", "OBJECT")} THEN 'meta is no object'
                WHEN NOT ({missing("meta", "$.namespace")} OR {is_a(part("meta", "$.namespace"), "STRING")}) THEN 'namespace is no text'
                WHEN NOT (list IS NULL OR is_variant_null(list) OR {is_a("list", "ARRAY")}) THEN 'techniques are no list' END AS rule_fault
        FROM l
    """, rows=rules(reports, keys))  # fmt: skip
    each = listed.withColumn("items", F.expr("CASE WHEN rule_fault IS NULL THEN try_variant_get(list, '$', 'array<variant>') END"))
    each = each.select(*keys, "rule_pos", "rule", "is_now", "namespace", "rule_fault", F.posexplode_outer("items").alias("entry_pos", "entry")).filter(F.col("entry_pos").isNotNull() | F.col("rule_fault").isNotNull())
    field = lambda f: text_at("entry", f"$.{f}")
    other = " OR ".join(f"NOT ({missing('entry', f'$.{f}')} OR {is_a(part('entry', f'$.{f}'), 'STRING')})" for f in ("tactic", "technique", "subtechnique", "id"))
    first = f"CASE WHEN {is_a(part('entry', '$.parts'), 'ARRAY')} AND {missing('entry', '$.tactic')} THEN {text_at('entry', '$.parts[0]')} END"
    read = each.sparkSession.sql(f"""
        WITH t AS (SELECT *, CASE WHEN {is_a("entry", "STRING")} THEN split(try_variant_get(entry, '$', 'string'), '::') END AS line FROM {{rows}}),
        i AS (SELECT *, substring_index(element_at(line, -1), ' ', -1) AS tail FROM t),
        p AS (SELECT *, CASE WHEN line IS NOT NULL THEN concat(slice(line, 1, size(line) - 1), array(left(element_at(line, -1), greatest(0, length(element_at(line, -1)) - length(tail) - 1)))) END AS parts FROM i)
        SELECT * EXCEPT (entry, line, tail, parts, rule_fault, is_now),
            coalesce(CASE WHEN line IS NULL THEN coalesce({field("tactic")}, {first}) ELSE parts[0] END, '') AS tactic,
            CASE WHEN line IS NULL THEN {field("id")} WHEN tail LIKE '[%]' THEN substring(tail, 2, length(tail) - 2) END AS technique_id,
            coalesce(CASE WHEN line IS NULL THEN coalesce(nullif({field("subtechnique")}, ''), {field("technique")}) ELSE coalesce(nullif(get(parts, 2), ''), get(parts, 1)) END, '') AS technique_name,
            CASE WHEN entry_pos IS NULL THEN rule_fault WHEN line IS NOT NULL AND tail NOT LIKE '[%]' THEN 'entry has no id'
                WHEN line IS NULL AND NOT {is_a("entry", "OBJECT")} THEN 'entry is no object or text' WHEN line IS NULL AND ({other}) THEN 'entry has a field that is no text'
                WHEN coalesce(CASE WHEN line IS NULL THEN {field("id")} ELSE substring(tail, 2, length(tail) - 2) END, '') = '' THEN 'entry has no id' END AS fault,
            is_now, line IS NOT NULL AS is_line
        FROM p
    """, rows=each)  # fmt: skip
    rule_path = F.concat(F.lit("/rules/"), escape_pointer(F.col("rule")))
    list_path = F.concat(rule_path, F.lit("/meta/"), F.when(F.col("is_now"), now).otherwise(before))
    entry_path = F.concat_ws("/", list_path, F.col("entry_pos").cast("string"))
    where = {"rule is no object": rule_path, "meta is no object": F.concat(rule_path, F.lit("/meta")), "namespace is no text": F.concat(rule_path, F.lit("/meta/namespace")), "techniques are no list": list_path}
    locator = F.when(F.col("fault").isNull() & ~F.col("is_line"), F.concat(entry_path, F.lit("/id"))).otherwise(entry_path)
    for fault, path in where.items():
        locator = F.when(F.col("fault").eqNullSafe(F.lit(fault)), path).otherwise(locator)
    return read.withColumn("locator", locator).drop("is_now", "is_line")


def techniques(found: DataFrame) -> DataFrame:
    """The entries that name a technique."""
    return found.filter(F.col("fault").isNull()).drop("fault")


def capabilities(reports: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys and distinct (tactic, technique_id, technique_name, namespace), with the place it first appears
    at. What cannot be read is left out here and told by status()."""
    rows = techniques(entries(reports, keys))
    return rows.groupBy(*keys, "tactic", "technique_id", "technique_name", "namespace").agg(F.min(F.struct("rule_pos", "entry_pos")).alias("at")).select(*keys, "tactic", "technique_id", "technique_name", "namespace", F.col("at.rule_pos").alias("rule_pos"), F.col("at.entry_pos").alias("entry_pos"))


def status(reports: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, techniques, faults, first_fault): READ for a report of which all rules could be read, with or without
    techniques; FAULTY if some could not, with the first in the document's order; NO_RULES if it has no object of rules;
    BROKEN if it holds no JSON object. keys must tell reports apart."""
    rows = entries(reports, keys)
    place = F.struct("rule_pos", F.coalesce("entry_pos", F.lit(-1)), F.concat_ws(": ", "locator", "fault").alias("text"))
    counted = rows.groupBy(*keys).agg(F.count_if(F.col("fault").isNull()).alias("techniques"), F.count("fault").alias("faults"), F.min(F.when(F.col("fault").isNotNull(), place)).alias("_f"))
    whole = object_variant(F.col("report").cast("string"), ("rules",))
    base = reports.select(*keys, whole.alias("doc")).selectExpr(*[f"`{k}`" for k in keys], f"{is_a('doc', 'OBJECT')} AS valid", f"{is_a(part('doc', '$.rules'), 'OBJECT')} AS has_rules")
    state = F.when(~F.col("valid"), "BROKEN").when(~F.col("has_rules"), "NO_RULES").when(F.col("faults") > 0, "FAULTY").otherwise("READ")
    return base.join(counted, keys, "left").na.fill(0, ["techniques", "faults"]).select(*keys, state.alias("status"), "techniques", "faults", F.col("_f.text").alias("first_fault"))
