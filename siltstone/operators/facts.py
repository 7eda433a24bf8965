"""Facts and network indicators out of sandbox and capability reports.

Every report is parsed once. What may count as evidence in it becomes a row, a *record*, with its place: capabilities,
registry writes, reported families and network objects, in this order. One budget is counted over all of a report's
records; facts and indicators are what the records within it say, numbered by first appearance.
"""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import defang
from siltstone.functions.variants import is_a, list_at, missing, part, text_at
from siltstone.operators import capability
from siltstone.operators.budgets import first_per_group, numbered
from siltstone.operators.extraction import BUDGET, report_variant
from siltstone.runtime import stored

# Fixed values.
RUN_APIS, RUN_KEYS = ("RegSetValueExA", "RegSetValueExW"), ("run", "runonce")
SECTIONS = ("http", "http_ex", "https_ex", "dns", "tcp", "udp", "hosts")
FIELD_BYTES = 65536
CAPABILITY_ID = r"^T[0-9]{4}(\.[0-9]{3})?\z"
SHA256 = "^[0-9a-fA-F]{64}$"

_KINDS = ("capability", "behaviour", "family", "network")
_ROW = "section int, o1 int, o2 int, counts boolean, locator string, kind string, value string, basis string, sources array<struct<document:string,locator:string>>, fields array<struct<field_ord:int,role:string,locator:string,raw:string,fault:string>>, fault string, partial boolean, source string, user_agent string, uri string"


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def items(reports: DataFrame, kinds=_KINDS[1:]) -> DataFrame:
    """(report_id, sha, section, o1, o2, name, x): what may hold evidence in each report, as variants, out of one parse:
    calls that set a registry value, detections, and the elements of the network lists (name: of the list)."""
    call = f"transform(filter(transform({list_at('p', '$.calls')}, (c, j) -> named_struct('j', j, 'c', c)), x -> coalesce(try_variant_get(x.c, '$.api', 'string') IN ({_quoted(RUN_APIS)}), false)), x -> named_struct('section', 1, 'o1', i, 'o2', x.j, 'name', '', 'x', x.c))"
    lists = ", ".join(f"named_struct('n', {i}, 'name', '{s}', 'list', {list_at('doc', f'$.network.{s}')})" for i, s in enumerate(SECTIONS))
    parts = {
        "behaviour": f"flatten(transform({list_at('doc', '$.behavior.processes')}, (p, i) -> {call}))",
        "family": f"transform({list_at('doc', '$.detections')}, (d, i) -> named_struct('section', 2, 'o1', i, 'o2', 0, 'name', '', 'x', d))",
        "network": f"flatten(transform(array({lists}), s -> transform(s.list, (x, i) -> named_struct('section', 3, 'o1', s.n, 'o2', i, 'name', s.name, 'x', x))))",
    }
    docs = reports.select("report_id", F.lower("artifact_sha256").alias("sha") if "artifact_sha256" in reports.columns else F.lit(None).cast("string").alias("sha"), report_variant(F.col("report")).alias("doc"))
    return docs.selectExpr("report_id", "sha", f"explode(concat({', '.join(parts[k] for k in kinds)})) AS e").select("report_id", "sha", "e.*")


def registry_writes(found: DataFrame) -> DataFrame:
    """(report_id, o1, o2, locator, value_name, kind, basis, fault, counts): of items(), the calls that may write below a
    run key, with what is wrong with them.

    A write counts if it has exactly one text FullName below a run key and one filled text Buffer; then its status, a
    boolean or 0 or 1, tells success from attempt. Arguments longer than FIELD_BYTES don't count.
    """
    given = f"transform({list_at('x', '$.arguments')}, x -> named_struct('object', {is_a('x', 'OBJECT')}, 'name', {text_at('x', '$.name')}, 'v', {text_at('x', '$.value')}))"
    fits = "x.v IS NOT NULL AND octet_length(x.v) <= " + str(FIELD_BYTES)
    return found.sparkSession.sql(f"""
        WITH g AS (SELECT report_id, o1, o2, x AS call, {given} AS given, {is_a(part('x', '$.arguments'), 'ARRAY')} AS listed FROM {{rows}} WHERE section = 1),
        n AS (SELECT *, filter(given, x -> coalesce(x.name = 'FullName' AND {fits}, false)) AS names, filter(given, x -> coalesce(x.name = 'Buffer' AND {fits}, false)) AS buffers FROM g),
        p AS (SELECT *, filter(split(replace(get(names, 0).v, '/', '\\\\'), '\\\\\\\\'), x -> x <> '') AS parts FROM n),
        r AS (SELECT *, CAST(array_position(transform(parts, x -> lower(x) IN ({_quoted(RUN_KEYS)})), true) AS INT) AS at,
                CASE WHEN schema_of_variant(try_variant_get(call, '$.status', 'variant')) = 'BOOLEAN' THEN try_variant_get(call, '$.status', 'boolean')
                    WHEN schema_of_variant(try_variant_get(call, '$.status', 'variant')) = 'BIGINT' AND try_variant_get(call, '$.status', 'bigint') IN (0, 1) THEN try_variant_get(call, '$.status', 'bigint') = 1 END AS done FROM p),
        f AS (SELECT report_id, o1, o2, done, try_element_at(parts, at + 1) AS value_name,
            CASE WHEN NOT listed THEN 'arguments is no list' WHEN size(names) > 1 OR size(buffers) > 1 THEN 'an argument is repeated' WHEN size(names) = 0 THEN 'no usable FullName'
                WHEN at = 0 THEN '' WHEN size(parts) <= at THEN 'the run key has no value name' WHEN size(buffers) = 0 OR get(buffers, 0).v = '' THEN 'no filled Buffer' END AS misses FROM r)
        SELECT report_id, o1, o2, format_string('/behavior/processes/%d/calls/%d', o1, o2) AS locator, value_name,
            CASE WHEN misses IS NULL AND done THEN 'AUTORUN_WRITE_SUCCESS' WHEN misses IS NULL AND NOT done THEN 'AUTORUN_WRITE_ATTEMPT' END AS kind,
            CASE WHEN misses IS NULL AND done THEN 'OBSERVED' WHEN misses IS NULL AND NOT done THEN 'ATTEMPTED' END AS basis,
            CASE WHEN misses IS NOT NULL THEN misses WHEN done IS NULL THEN 'status is missing or invalid' END AS fault, misses IS NULL AS counts
        FROM f WHERE misses IS NULL OR misses <> ''
    """, rows=found)  # fmt: skip


def run_key_writes(reports: DataFrame) -> DataFrame:
    """(report_id, process_pos, call_pos, locator, value_name, kind, basis) of the writes below a run key."""
    found = registry_writes(items(reports, ("behaviour",))).filter(F.col("kind").isNotNull())
    return found.select("report_id", F.col("o1").alias("process_pos"), F.col("o2").alias("call_pos"), "locator", "value_name", "kind", "basis")


def family_hints(found: DataFrame) -> DataFrame:
    """(report_id, detection_pos, family, sources, fault, partial): of items(), every reported detection. A hint is bound, and has
    sources, if a Yara or ClamAV detail names this very artifact; details of one object come in order of their names.
    An unbound hint is a fault that leaves the report's coverage as it is."""
    digest = SHA256.replace("{", "{{").replace("}", "}}")  # sql() reads braces itself
    pick = f"transform({list_at('d', '$.details')}, (x, k) -> named_struct('k', k, 'engines', CASE WHEN {is_a('x', 'OBJECT')} THEN map_filter(variant_get(x, '$', 'map<string,variant>'), (n, v) -> lower(n) IN ('yara', 'clamav')) END))"
    said = "transform(map_entries(x.engines), e -> named_struct('n', e.key, 'sha', CASE WHEN schema_of_variant(e.value) = 'STRING' THEN variant_get(e.value, '$', 'string') END))"
    return found.sparkSession.sql(f"""
        WITH d AS (SELECT report_id, sha, o1 AS detection_pos, x AS d FROM {{rows}} WHERE section = 2),
        p AS (SELECT *, {is_a('d', 'OBJECT')} AS fits, {text_at('d', '$.family')} AS family, {is_a(part('d', '$.details'), 'ARRAY')} AS listed, {pick} AS details FROM d),
        s AS (SELECT *, flatten(transform(filter(details, x -> x.engines IS NOT NULL), x -> transform({said}, e -> named_struct('locator', format_string('/detections/%d/details/%d/%s', detection_pos, x.k, e.n), 'sha', e.sha)))) AS said FROM p),
        b AS (SELECT *, filter(said, e -> coalesce(lower(e.sha) = sha, false)) AS bound FROM s)
        SELECT report_id, detection_pos, family, CASE WHEN size(bound) > 0 AND family <> '' AND octet_length(family) <= {FIELD_BYTES} THEN
                concat(array(format_string('/detections/%d/family', detection_pos)), transform(bound, e -> e.locator)) END AS sources,
            CASE WHEN NOT fits THEN 'detection is no object' WHEN coalesce(family, '') = '' THEN 'family is no filled text' WHEN octet_length(family) > {FIELD_BYTES} THEN 'family is too long'
                WHEN NOT listed THEN 'details is no list' WHEN exists(details, x -> x.engines IS NULL) THEN 'a detail is no object'
                WHEN exists(said, e -> NOT coalesce(e.sha RLIKE '{digest}', false)) THEN 'a detail holds no SHA-256' WHEN size(bound) = 0 THEN 'no detail names this artifact' END AS fault,
            NOT (fits AND coalesce(family, '') <> '' AND listed AND size(bound) = 0 AND NOT exists(details, x -> x.engines IS NULL) AND forall(said, e -> coalesce(e.sha RLIKE '{digest}', false))) AS partial
        FROM b
    """, rows=found)  # fmt: skip


def reported_families(reports: DataFrame) -> DataFrame:
    """(report_id, detection_pos, family): detections of which a Yara or ClamAV detail names this very artifact."""
    return family_hints(items(reports, ("family",))).filter(F.col("sources").isNotNull()).select("report_id", "detection_pos", "family")


def aliased(families: DataFrame, aliases: DataFrame, name: Column) -> DataFrame:
    """families with canonical: the alias table's name, compared without case; null where it has none."""
    table = aliases.select(F.lower("alias_name").alias("_alias"), F.col("canonical_name").alias("canonical")).groupBy("_alias").agg(F.min("canonical").alias("canonical"))
    return families.withColumn("_alias", F.lower(name)).join(table, "_alias", "left").drop("_alias")


def network_objects(found: DataFrame) -> DataFrame:
    """(report_id, section_ord, section, pos, source, user_agent, uri, is_object, sourced, fields, fault): of items(), the
    elements of the lists of the network section. sourced: the source is text or missing. fields: the values to be read as
    indicators, each with its role and, if it is no filled text within FIELD_BYTES, its fault."""
    field = lambda section, role, name, at: f"CASE WHEN section IN ({_quoted(section)}) AND {part('x', f'$.{name}')} IS NOT NULL THEN named_struct('field_ord', {at}, 'role', '{role}', 'locator', '/{name}', 'raw', {text_at('x', f'$.{name}')}) END"
    web = SECTIONS[:3]
    own = ", ".join([field(web, "uri", "uri", 0), field(web, "host", "host", 1), field(("dns",), "request", "request", 0), field(("tcp", "udp"), "address", "dst", 0), field(("hosts",), "address", "ip", 0)])
    answers = f"transform(filter(transform({list_at('x', '$.answers')}, (a, k) -> named_struct('k', k, 'kind', {text_at('a', '$.type')}, 'raw', {text_at('a', '$.data')})), a -> section = 'dns' AND coalesce(upper(a.kind) IN ('A', 'AAAA'), false)), a -> named_struct('field_ord', a.k + 1, 'role', 'address', 'locator', format_string('/answers/%d/data', a.k), 'raw', a.raw))"
    lacks = lambda sections, names, reason: f"WHEN section IN ({_quoted(sections)}) AND {' AND '.join(part('x', f'$.{n}') + ' IS NULL' for n in names)} THEN '{reason}'"
    text = "transform(concat(array_compact(array({own})), {answers}), f -> named_struct('field_ord', f.field_ord, 'role', f.role, 'locator', f.locator, 'raw', f.raw, 'fault', CASE WHEN coalesce(f.raw, '') = '' THEN 'value is no filled text' WHEN octet_length(f.raw) > {most} THEN 'value is too long' END))".format(own=own, answers=answers, most=FIELD_BYTES)
    return found.sparkSession.sql(f"""
        WITH x AS (SELECT report_id, o1 AS section_ord, name AS section, o2 AS pos, x, {is_a('x', 'OBJECT')} AS is_object FROM {{rows}} WHERE section = 3)
        SELECT report_id, section_ord, section, pos, is_object, {text_at('x', '$.source')} AS source, {text_at('x', '$["user-agent"]')} AS user_agent, {text_at('x', '$.uri')} AS uri,
            {missing('x', '$.source')} OR {is_a(part('x', '$.source'), 'STRING')} AS sourced, CASE WHEN is_object THEN {text} END AS fields,
            CASE WHEN NOT is_object THEN 'network record is no object' {lacks(web, ('uri', 'host'), 'no URI and no host')} {lacks(('tcp', 'udp'), ('dst',), 'no destination')} {lacks(('hosts',), ('ip',), 'no address')}
                WHEN section = 'dns' AND {part('x', '$.answers')} IS NOT NULL AND NOT {is_a(part('x', '$.answers'), 'ARRAY')} THEN 'answers is no list' END AS fault
        FROM x
    """, rows=found)  # fmt: skip


def network_records(reports: DataFrame) -> DataFrame:
    """The objects among network_objects()."""
    return network_objects(items(reports, ("network",))).filter("is_object")


def network_activity(records: DataFrame) -> DataFrame:
    """(report_id, basis, n): how many records were observed and attempted; plain hosts and records whose source is no
    text don't count."""
    basis = F.when(F.col("source") == "behavior", "ATTEMPTED").otherwise("OBSERVED")
    return records.filter((F.col("section") != "hosts") & F.col("sourced")).groupBy("report_id", basis.alias("basis")).agg(F.count("*").alias("n"))


# Hosts, addresses and URIs as columns; Python only for what is not ASCII and for IPv6.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"
_LABEL = "(?!-)[a-z0-9-]{1,63}(?<!-)"
_NAME = rf"^{_LABEL}(?:\.{_LABEL})*\z"
_EDGE = r"^[\s\x1c-\x1f\x85\p{Z}]|[\s\x1c-\x1f\x85\p{Z}]\z"
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def _wire_form(host: str) -> str | None:
    try:
        return ipaddress.ip_address(host).compressed
    except ValueError:
        pass
    try:
        return host.removesuffix(".").encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None


def with_host(df: DataFrame, host: Column, domains: Column, addresses: Column) -> DataFrame:
    """df with host_kind and host_form: DOMAIN in lower-case ASCII without a last dot, or IP in its short form; both null
    for anything else and for what isn't asked for."""

    @F.arrow_udf("string")
    def wired(hosts: pa.Array) -> pa.Array:
        return pa.array([h and _wire_form(h) for h in hosts.to_pylist()], pa.string())

    rows = df.withColumn("_host", F.when(~host.rlike(_EDGE), F.regexp_replace(host, r"(?s)^\[(.*)\]\z", "$1")))
    rows = rows.withColumn("_odd", F.when(~F.col("_host").rlike(r"^[\x00-\x39\x3b-\x7f]*+\z"), F.col("_host")))  # not ASCII, or with a colon
    rows = rows.withColumn("_odd", wired("_odd")).withColumn("_form", F.coalesce("_odd", F.lower(F.regexp_replace("_host", r"\.\z", ""))))
    rows = rows.withColumn("_address", F.col("_host").rlike(_IPV4) | F.contains("_odd", F.lit(":")))
    dotted = ~addresses & F.col("_host").rlike(r"^[0-9.]*\.[0-9.]*\z")
    kind = F.when(F.coalesce("_address", F.lit(False)), F.when(addresses, "IP")).when(domains & ~dotted & (F.length("_form") <= 253) & F.col("_form").rlike(_NAME), "DOMAIN")
    rows = rows.withColumn("host_kind", kind)
    return rows.withColumn("host_form", F.when(F.col("host_kind").isNotNull(), F.col("_form"))).drop("_host", "_odd", "_form", "_address")


def read_fields(fields: DataFrame) -> DataFrame:
    """fields (with role, raw and fault) with kind, canonical, value and display of the indicator that each is, or why it
    is none (fault, kept where there is one already).

    role uri: an http or https URI without credentials, kept as it is written, or the host of '//host'; host: a domain
    or address; request: a domain only; address: an address only. Display forms cannot be followed by accident.
    """
    cleaned = F.regexp_replace(F.regexp_replace(F.col("raw"), r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\r\n]", "")
    is_uri = F.col("role") == "uri"
    rows = fields.withColumn("_uri", F.when(is_uri, cleaned))
    for name, i in (("_scheme", 1), ("_site", 2), ("_path", 3), ("_query", 4), ("_rest", 5)):
        rows = rows.withColumn(name, F.regexp_extract("_uri", _URI, i))
    rows = rows.withColumn("_scheme", F.lower("_scheme")).withColumn("_port", F.regexp_extract("_site", r":([0-9]+)\z", 1)).withColumn("_port", F.expr("CASE WHEN _port = '' THEN 0 ELSE try_cast(ltrim('0', _port) || '.' AS DECIMAL(38, 0)) END"))
    whole = F.col("_site").rlike(r"^(?:\[[^\[\]]*:[^\[\]]*\]|[^:\[\]]+)(?::[0-9]*)?\z")
    rows = rows.withColumn("_bare", F.when(is_uri, F.when(whole, F.lower(F.regexp_replace("_site", r":[0-9]*\z", "")))).otherwise(F.col("raw")))
    rows = with_host(rows, F.col("_bare"), F.col("role") != "address", F.col("role") != "request")
    web = is_uri & (F.col("_scheme") != "")
    why = (
        F.when(is_uri & (F.col("_site") == ""), "URI names no host").when(is_uri & F.contains(F.col("_site"), F.lit("@")), "URI holds credentials").when(web & ~F.col("_scheme").isin("http", "https"), "scheme is not http or https")
        .when(is_uri & ~F.coalesce(F.col("_port") <= 65535, F.lit(False)), "port is invalid").when(F.col("host_kind").isNull(), "not a host of the kind asked for")
    )
    rows = rows.withColumn("fault", F.coalesce("fault", why)).withColumn("_found", F.col("fault").isNull())
    rows = rows.withColumn("_shown", defang(F.col("host_form"))).withColumn("_kind", F.when(web, "URL").otherwise(F.col("host_kind")))
    boxed = F.when(F.contains("host_form", F.lit(":")), F.concat(F.lit("["), F.col("_shown"), F.lit("]"))).otherwise(F.col("_shown"))
    extra = lambda mark, name: F.when(F.col(name) != "", F.concat(F.lit(mark), F.col(name))).otherwise("")
    ported = F.when(F.col("_site").rlike(r":[0-9]+\z"), F.concat(F.lit(":"), F.col("_port").cast("string"))).otherwise("")
    link = F.concat(F.replace("_scheme", F.lit("tt"), F.lit("xx")), F.lit("://"), boxed, ported, F.col("_path"), extra("?", "_query"), extra("#", "_rest"))
    kept = F.when(F.col("_kind") == "IP", F.col("host_form")).otherwise(F.col("_bare"))
    return rows.select(
        *fields.columns, F.when(F.col("_found"), F.col("_kind")).alias("kind"), F.when(F.col("_found"), F.when(web, F.col("raw")).otherwise(F.col("host_form"))).alias("canonical"),
        F.when(F.col("_found"), F.when(web, F.col("raw")).otherwise(kept)).alias("value"), F.when(F.col("_found"), F.when(web, link).otherwise(F.col("_shown"))).alias("display"),
    )


def records(reports: DataFrame, aliases: DataFrame | None = None, capabilities: DataFrame | None = None) -> DataFrame:
    """Every record and every fault of every report, in one shape and with its place (section, o1, o2).

    capabilities (artifact_sha256, report): at most one capability report per artifact; it is read for all reports of
    that artifact. aliases names the known families. Records that count use up the budget, faults alone do not.
    """
    source = lambda document, place: F.array(F.struct(F.lit(document).alias("document"), place.alias("locator")))
    text, none = lambda x: F.lit(x).cast("string"), F.lit(None)

    def shaped(rows, section, o1, o2, **have):
        kinds = [f.split(" ", 1) for f in _ROW.split(", ")]
        have |= {"section": F.lit(_KINDS.index(section)), "o1": o1, "o2": o2}
        return rows.select("report_id", *[have.get(n, none).cast(k).alias(n) for n, k in kinds])

    own = stored(items(reports), "report-items")
    writes = registry_writes(own)
    writes = shaped(writes, "behaviour", F.col("o1"), F.col("o2"), counts=F.col("counts"), locator=F.col("locator"), kind=F.col("kind"), value=F.when(F.col("kind").isNotNull(), "true"), basis=F.col("basis"), sources=source("CAPE", F.col("locator")), fault=F.col("fault"), partial=F.lit(True))
    hints = family_hints(own)
    hints = aliased(hints, aliases, F.col("family")) if aliases is not None else hints.withColumn("canonical", text(None))
    bound = F.col("sources").isNotNull()
    hints = shaped(
        hints, "family", F.col("detection_pos"), F.lit(0), counts=bound, locator=F.format_string("/detections/%d", "detection_pos"), kind=F.when(bound & F.col("canonical").isNotNull(), "REPORTED_FAMILY").when(bound, "UNMAPPED_REPORTED_FAMILY"),
        value=F.when(bound, F.coalesce("canonical", F.lit("true"))), basis=F.when(bound, "REPORTED_DETECTION"), sources=F.transform("sources", lambda x: F.struct(F.lit("CAPE").alias("document"), x.alias("locator"))), fault=F.col("fault"), partial=F.col("partial"),
    )
    net = network_objects(own)
    place = F.format_string("/network/%s/%d", "section", "pos")
    active = F.col("is_object") & F.col("sourced") & (F.col("section") != "hosts")
    net = shaped(
        net, "network", F.col("section_ord"), F.col("pos"), counts=F.col("is_object"), locator=place, kind=F.when(active, "NETWORK_ACTIVITY"), value=F.when(active, ""), basis=F.when(active, F.when(F.col("source") == "behavior", "ATTEMPTED").otherwise("OBSERVED")),
        sources=source("CAPE", place), fields=F.col("fields"), fault=F.coalesce("fault", F.when(F.col("is_object") & ~F.col("sourced"), "source is no text")), partial=F.lit(True), source=F.col("source"), user_agent=F.col("user_agent"), uri=F.col("uri"),
    )
    found = writes.unionByName(hints).unionByName(net)
    if capabilities is not None:
        listed = capability.entries(capabilities.select(F.lower("artifact_sha256").alias("sha"), "report"), ["sha"])
        named = listed.filter(F.col("fault").isNotNull() | F.col("technique_id").rlike(CAPABILITY_ID))
        mine = reports.select("report_id", F.lower("artifact_sha256").alias("sha")).join(named, "sha")
        fine = F.col("fault").isNull()
        caps = shaped(mine, "capability", F.col("rule_pos"), F.coalesce("entry_pos", F.lit(-1)), counts=fine, locator=F.col("locator"), kind=F.when(fine, "CAPABILITY"), value=F.when(fine, F.col("technique_id")), basis=F.when(fine, "CAPABILITY"), sources=source("CAPA", F.col("locator")), fault=F.col("fault"), partial=F.lit(True))
        found = found.unionByName(caps)
    return found


_ORDER = ["section", "o1", "o2"]


def within_budget(found: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The first `budget` counting records of every report with their place, over all kinds of record together."""
    return first_per_group(found.filter("counts"), ["report_id"], _ORDER, budget)


def facts(kept: DataFrame) -> DataFrame:
    """(report_id, fact_id, kind, value, basis, n, sources): one fact per report, kind, value and basis, numbered by
    first appearance, with its distinct sources in order. The value of NETWORK_ACTIVITY is its number of records."""
    said = kept.filter(F.col("kind").isNotNull())
    merged = said.groupBy("report_id", "kind", "value", "basis").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("place", "sources"))).alias("_s"))  # within the budget
    place = F.row_number().over(Window.partitionBy("report_id").orderBy("first"))
    value = F.when(F.col("kind") == "NETWORK_ACTIVITY", F.col("n").cast("string")).otherwise(F.col("value"))
    return merged.select("report_id", numbered("FACT", place).alias("fact_id"), "kind", value.alias("value"), "basis", "n", F.array_distinct(F.flatten(F.transform("_s", lambda x: x["sources"]))).alias("sources"))


def indicators(kept: DataFrame) -> DataFrame:
    """(report_id, ioc_id, kind, canonical, value, display, sources): one row per report, kind and canonical form, with
    the value and display first seen, numbered by first appearance, and how many fields gave it."""
    each = kept.filter(F.size("fields") > 0).select("report_id", "place", F.explode("fields").alias("_field")).select("report_id", "place", "_field.*")
    read = read_fields(each).filter(F.col("kind").isNotNull())
    first = F.min(F.struct("place", "field_ord", "value", "display")).alias("_f")
    merged = read.groupBy("report_id", "kind", "canonical").agg(first, F.count("*").alias("sources"))
    place = F.row_number().over(Window.partitionBy("report_id").orderBy("_f.place", "_f.field_ord", "kind", "canonical"))
    return merged.select("report_id", numbered("IOC", place).alias("ioc_id"), "kind", "canonical", F.col("_f.value").alias("value"), F.col("_f.display").alias("display"), "sources")


def issues(found: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(report_id, locator, reason, partial): the faults of every report up to its budget, fields included, and one for
    the record that is beyond it. partial: whether it makes the report's coverage PARTIAL."""
    over = first_per_group(found.filter("counts"), ["report_id"], _ORDER, budget + 1).filter(F.col("place") == budget + 1)
    ends = over.select("report_id", F.struct(*_ORDER).alias("_end"))
    own = found.filter(F.col("fault").isNotNull()).select("report_id", *_ORDER, "locator", F.col("fault").alias("reason"), "partial")
    each = found.filter(F.size("fields") > 0).select("report_id", *_ORDER, F.col("locator").alias("_at"), F.explode("fields").alias("_field")).select("report_id", *_ORDER, "_at", "_field.*")
    bad = read_fields(each).filter(F.col("fault").isNotNull()).select("report_id", *_ORDER, F.concat("_at", "locator").alias("locator"), F.col("fault").alias("reason"), F.lit(True).alias("partial"))
    early = own.unionByName(bad).join(ends, "report_id", "left").filter(F.col("_end").isNull() | (F.struct(*_ORDER) < F.col("_end")))
    last = over.select("report_id", "locator", F.lit(f"more than {budget} records").alias("reason"), F.lit(True).alias("partial"))
    return early.select("report_id", "locator", "reason", "partial").unionByName(last)


def bindings(reports: DataFrame, capabilities: DataFrame | None = None, artifacts: DataFrame | None = None) -> DataFrame:
    """(report_id, artifact_sha256, bound, reason): whether a report, the artifact's capability report and its bytes are
    of one sample: all digests that are there must be the artifact's, without case.

    capabilities (artifact_sha256, report) and artifacts (artifact_sha256, data) have at most one row per artifact.
    """
    sha = lambda c: F.lower(c)
    rows = reports.select("report_id", "artifact_sha256", sha(F.col("artifact_sha256")).alias("_key"), report_variant(F.col("report")).alias("doc")).withColumn("_cape", F.expr(f"lower({text_at('doc', '$.target.file.sha256')})")).drop("doc")
    rows = rows.withColumn("_capa", F.col("_key")).withColumn("_bytes", F.col("_key"))
    for table, name, digest in ((capabilities, "_capa", lambda: F.lower(F.get_json_object("report", "$.meta.sample.sha256"))), (artifacts, "_bytes", lambda: F.sha2("data", 256))):
        if table is not None:
            theirs = table.select(sha(F.col("artifact_sha256")).alias("_key"), F.coalesce(digest(), F.lit("")).alias("_theirs"))
            rows = rows.join(theirs, "_key", "left").withColumn(name, F.coalesce("_theirs", "_key")).drop("_theirs")
    reason = F.when(~F.coalesce(F.col("_key").rlike(SHA256), F.lit(False)), "the artifact has no SHA-256").when(~F.col("_cape").eqNullSafe(F.col("_key")), "the report is of another sample").when(F.col("_capa") != F.col("_key"), "the capability report is of another sample").when(F.col("_bytes") != F.col("_key"), "the bytes are of another sample")
    return rows.select("report_id", "artifact_sha256", reason.isNull().alias("bound"), reason.alias("reason"))
