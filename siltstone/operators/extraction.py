"""Printable strings out of bytes, and text arguments out of sandbox reports."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siltstone.functions.json_text import parse_object
from siltstone.functions.text import widened
from siltstone.functions.variants import object_variant
from siltstone.operators.budgets import first_per_group

# Fixed values.
STRING_CHARS, CHUNK_CHARS, BUDGET = 6, 256, 2000
ENTROPY_LOW, ENTROPY_HIGH = 2.5, 5.5
DATA_SECTIONS = (".rsrc", ".data", ".edata", ".idata", ".debug")
TEXT_ARGUMENTS = {
    "OutputDebugStringA": ["lpOutputString"],
    "OutputDebugStringW": ["lpOutputString"],
    "SetWindowTextA": ["lpString"],
    "SetWindowTextW": ["lpString"],
    "MessageBoxA": ["lpText", "lpCaption"],
    "MessageBoxW": ["lpText", "lpCaption"],
}

_narrow, _wide = re.compile(rb"[ -~]+"), re.compile(rb"(?:[ -~]\x00)+")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def printable_strings(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(offset, text, encoding) of the runs of printable bytes and of printable 16-bit units, by offset; runs are
    cut into chunks, and short, too regular and too random chunks are left out."""
    runs = [(m.start(), 0, 1, m[0].decode("ascii")) for m in _narrow.finditer(data)]
    runs += [(m.start(), 1, 2, m[0][::2].decode("ascii")) for m in _wide.finditer(data)]
    for start, kind, width, run in sorted(runs, key=lambda r: r[:2]):
        for at in range(0, len(run), CHUNK_CHARS):
            chunk = run[at : at + CHUNK_CHARS]
            if len(chunk) >= STRING_CHARS and ENTROPY_LOW <= _entropy(chunk) <= ENTROPY_HIGH:
                yield start + at * width, chunk, ("ascii", "utf-16le")[kind]


def _regions(size: int, sections) -> list[tuple[int, int]]:
    """(start, end) of the parts of a file to read: its sections, data sections first, cut to the file and
    without empty ones; the whole file where none are named."""
    if not sections:
        return [(0, size)]
    ranked = sorted(enumerate(sections), key=lambda x: (x[1]["name"] not in DATA_SECTIONS, x[0]))
    cut = [(max(0, s["start"] or 0), min(size, (s["start"] or 0) + (s["size"] or 0))) for _, s in ranked]
    return [(a, b) for a, b in cut if a < b]


def extract_strings(artifacts: DataFrame, key: str, data: str, budget: int = BUDGET, sections: DataFrame | None = None) -> DataFrame:
    """(key, ord, locator, encoding, raw_string, truncated): at most `budget` strings of every artifact, in order.

    sections (key, section_ord, name, start, size) names the parts of a file to read, the sections of DATA_SECTIONS
    first; a file without any is read whole. An artifact is one row, so its budget is kept where its bytes are and
    only sections are shuffled. Null and empty bytes have no strings.
    """
    kind = artifacts.schema[key].dataType.simpleString()
    rows = artifacts.select(F.col(key).alias("key"), F.col(data).alias("data"))
    if sections is None:
        rows = rows.withColumn("sections", F.lit(None).cast("array<struct<name:string,start:bigint,size:bigint>>"))
    else:
        listed = F.transform(F.sort_array(F.collect_list(F.struct("section_ord", "name", F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size")))), lambda x: F.struct(x["name"].alias("name"), x["start"].alias("start"), x["size"].alias("size")))
        rows = rows.join(sections.groupBy(F.col(key).alias("key")).agg(listed.alias("sections")), "key", "left")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                owner, rows = [], []
                for at, (raw, parts) in enumerate(zip(part.column("data").to_pylist(), part.column("sections").to_pylist())):
                    raw = raw or b""
                    found = []
                    for start, end in _regions(len(raw), parts):
                        for offset, text, encoding in printable_strings(raw[start:end]):
                            found.append((start + offset, text, encoding))
                            if len(found) > budget:
                                break
                        if len(found) > budget:
                            break
                    over = len(found) > budget
                    owner += [at] * min(len(found), budget)
                    rows += [(n, f"0x{offset:08X}", encoding, text, over) for n, (offset, text, encoding) in enumerate(found[:budget])]
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(owner, pa.int32())), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[key, "ord", "locator", "encoding", "raw_string", "truncated"])

    return rows.select("key", "data", "sections").mapInArrow(stage, f"`{key}` {kind}, ord int, locator string, encoding string, raw_string string, truncated boolean")


def printable_runs(text: Column, least: int = STRING_CHARS) -> Column:
    """The runs of at least `least` printable ASCII characters of a text, in order."""
    return F.regexp_extract_all(text, F.lit(f"[ -~]{{{least},}}"), F.lit(0))


def text_chunks(df: DataFrame, text: str, size: int = CHUNK_CHARS) -> DataFrame:
    """df without text, with chunk_no and chunk: pieces of `size` characters. Null and empty texts have none."""
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size))
    cut = df.filter(F.length(text) > 0).withColumn("_at", F.explode(starts))
    rest = [c for c in df.columns if c != text]
    return cut.select(*rest, (F.col("_at") / size).cast("int").alias("chunk_no"), F.substring(F.col(text), F.col("_at") + 1, F.lit(size)).alias("chunk"))


def measured(df: DataFrame, text: str) -> DataFrame:
    """df with the entropy of text in bits a character: 0 for empty text, null for null. Its cost is linear, however
    long a text is."""

    @F.arrow_udf("double")
    def entropy(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _entropy(t) or 0.0 for t in texts.to_pylist()], pa.float64())

    return df.withColumn("entropy", entropy(F.col(text)))


def candidates(df: DataFrame, text: str) -> DataFrame:
    """The rows of df whose text is long enough and neither too regular nor too random, with its entropy."""
    return measured(df.filter(F.length(text) >= STRING_CHARS), text).filter(F.col("entropy").between(ENTROPY_LOW, ENTROPY_HIGH))


#: The parts of a report that variants are asked for.
REPORT_FIELDS = ("behavior", "network", "detections", "target")


def report_variant(report: Column) -> Column:
    """A report as a variant; null for broken texts. See object_variant for repeated keys and deep containers."""
    return object_variant(report.cast("string"), REPORT_FIELDS)


def telemetry_calls(reports: DataFrame) -> DataFrame:
    """(report_id, artifact_sha256, process_pos, call_pos, pid, api, call): calls in lists of processes in lists.

    Broken reports have none.
    """
    view = reports.select("report_id", "artifact_sha256", report_variant(F.col("report")).alias("doc"))
    steps = view.selectExpr("report_id", "artifact_sha256", "try_variant_get(doc, '$.behavior.processes', 'variant') AS processes")
    return reports.sparkSession.sql("""
        SELECT r.report_id, r.artifact_sha256, p.pos AS process_pos, c.pos AS call_pos,
               CASE WHEN schema_of_variant(try_variant_get(p.value, '$.process_id', 'variant')) IN ('BIGINT', 'STRING')
                    THEN try_variant_get(p.value, '$.process_id', 'string') ELSE 'unknown' END AS pid,
               try_variant_get(c.value, '$.api', 'string') AS api, c.value AS call
        FROM {rows} r,
             LATERAL variant_explode(r.processes) p,
             LATERAL variant_explode(try_variant_get(p.value, '$.calls', 'variant')) c
        WHERE p.key IS NULL AND c.key IS NULL
    """, rows=steps)


def telemetry_strings(reports: DataFrame, budget: int | None = BUDGET) -> DataFrame:
    """The text arguments of the listed calls: report_id, artifact_sha256, locator, section_or_pid, api,
    argument_name, raw_string; with a budget also place and truncated, counted by report.

    Values that aren't text, are short or are hex numbers are left out; wide text seen as bytes is read as text.
    """
    calls = telemetry_calls(reports)
    names = sorted({(api, name) for api, args in TEXT_ARGUMENTS.items() for name in args})
    calls = calls.filter(F.col("api").isin(*TEXT_ARGUMENTS))
    arguments = reports.sparkSession.sql("""
        SELECT c.* EXCEPT (call), a.pos AS argument_pos, try_variant_get(a.value, '$.name', 'string') AS argument_name,
               CASE WHEN schema_of_variant(try_variant_get(a.value, '$.value', 'variant')) = 'STRING' THEN try_variant_get(a.value, '$.value', 'string') END AS v
        FROM {rows} c, LATERAL variant_explode(try_variant_get(c.call, '$.arguments', 'variant')) a WHERE a.key IS NULL
    """, rows=calls)
    listed = F.concat_ws("|", "api", "argument_name").isin(*[f"{a}|{n}" for a, n in names])
    found = arguments.filter(listed).withColumn("raw_string", widened(F.col("v"))).filter((F.length("raw_string") >= STRING_CHARS) & ~F.col("raw_string").startswith("0x"))
    locator = F.format_string("/behavior/processes/%d/calls/%d/arguments/%d", "process_pos", "call_pos", "argument_pos")
    rows = found.select("report_id", "artifact_sha256", "process_pos", "call_pos", "argument_pos", locator.alias("locator"), F.col("pid").alias("section_or_pid"), "api", "argument_name", "raw_string")
    if budget is None:
        return rows
    return first_per_group(rows, ["report_id"], ["process_pos", "call_pos", "argument_pos"], budget)


_wide_text = re.compile(r"(?:[ -~\r\n\t\xa1-\xac\xae-\xff]\x00){2,}")


def _ingest(report, budget: int) -> tuple[list[tuple[str, str]], bool]:
    """(errors, truncated) of a parsed report in document order; nothing is looked at after text budget + 1."""
    errors: list[tuple[str, str]] = []

    def wrong(holder, name, path, kind, noun):
        value = holder.get(name)
        if isinstance(value, kind):
            return False
        errors.append((f"{path}/{name}", f"{name} is missing" if value is None else f"{name} is no {noun}"))
        return True

    def untexted(holder, name, path):
        if isinstance(holder.get(name), str):
            return False
        errors.append((f"{path}/{name}", f"{name} is missing or no text"))
        return True

    def arguments(call, at):
        """Whether each text argument of a call is one to keep."""
        if not isinstance(call, dict):
            errors.append((at, "call is no object"))
            return
        if untexted(call, "api", at) or call["api"] not in TEXT_ARGUMENTS:
            return
        if not isinstance(call.get("timestamp"), (str, type(None))):
            errors.append((f"{at}/timestamp", "timestamp is no text"))
        if wrong(call, "arguments", at, list, "list"):
            return
        for k, argument in enumerate(call["arguments"]):
            here = f"{at}/arguments/{k}"
            if not isinstance(argument, dict):
                errors.append((here, "argument is no object"))
            elif not untexted(argument, "name", here) and argument["name"] in TEXT_ARGUMENTS[call["api"]] and not untexted(argument, "value", here):
                value = argument["value"]
                value = value[::2] if _wide_text.fullmatch(value) else value
                if len(value) >= STRING_CHARS and not value.startswith("0x"):
                    yield

    def texts():
        if not isinstance(report, dict):
            errors.append(("/", "report is no object"))
            return
        if wrong(report, "behavior", "", dict, "object") or wrong(report["behavior"], "processes", "/behavior", list, "list"):
            return
        for i, process in enumerate(report["behavior"]["processes"]):
            at = f"/behavior/processes/{i}"
            if not isinstance(process, dict):
                errors.append((at, "process is no object"))
                continue
            pid = process.get("process_id")
            if isinstance(pid, bool) or not isinstance(pid, (int, str, type(None))):
                errors.append((f"{at}/process_id", "process_id is no integer or text"))
            if not wrong(process, "calls", at, list, "list"):
                for j, call in enumerate(process["calls"]):
                    yield from arguments(call, f"{at}/calls/{j}")

    truncated = any(n >= budget for n, _ in enumerate(texts()))
    return errors, truncated


def _ingested(reports: DataFrame, budget: int, fields: str, rows_of) -> DataFrame:
    if budget < 0:
        raise ValueError("the budget is negative")
    kind = reports.schema["report_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"report_id {kind}, {fields}")
    arrow = to_arrow_schema(schema)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for at, text in enumerate(batch.column("report")):
                found = rows_of(*_ingest(parse_object(text.as_py(), keep_entries=False), budget))
                owner += [at] * len(found)
                rows += found
            columns = list(zip(*rows)) or [()] * (len(arrow) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("report_id").take(pa.array(owner, pa.int32())), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:])]], names=arrow.names)

    return reports.select("report_id", F.col("report").cast("string").alias("report")).mapInArrow(stage, schema)


def telemetry_errors(reports: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(report_id, ord, path, reason) of what is not as it should be down to the listed arguments' values, in document
    order. What follows a report's text budget + 1 is not looked at. Of a repeated key the last value counts."""
    return _ingested(reports, budget, "ord int, path string, reason string", lambda errors, _: [(n, *e) for n, e in enumerate(errors)])


def telemetry_coverage(reports: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(report_id, coverage, errors, truncated): COMPLETE for reports without errors and within the budget, else PARTIAL."""
    return _ingested(reports, budget, "coverage string, errors int, truncated boolean", lambda errors, over: [("PARTIAL" if errors or over else "COMPLETE", len(errors), over)])
