"""Untrusted text on its way to a reader: markers, escapes, summaries, canaries, references, allowlists."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.json_text import clean, parse_object, written
from siltstone.functions.text import escape_markup, shortened

# Fixed values.
INGRESS_MARKERS = (
    "<untrusted_malware_telemetry>", "</", "ignore previous instructions", "ignore all previous", "disregard previous",
    "system override", "you are now", "developer mode", "do not report", "output verdict: benign",
)
REDACTION = "[REDACTED:CANARY]"
CANARY_PREFIX = "CANARY"


def ingress_hits(text: Column) -> Column:
    """The markers that a text contains without case, in their order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in INGRESS_MARKERS]))


def summary(text: Column, most: int = 280) -> Column:
    return escape_markup(shortened(text, most))


def canary(label: str) -> str:
    return f"{CANARY_PREFIX}-{label}-{hashlib.sha256(label.encode()).hexdigest()[:16].upper()}"


def canary_hits(df: DataFrame, text: str, canaries: list[str]) -> DataFrame:
    """A row for each token that a row's text contains, whatever the case."""
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(c.lower())), F.lit(c)) for c in canaries]))
    return df.withColumn("token", F.explode(hits))


def redacted(text: Column, canaries: list[str]) -> Column:
    """Text with every token replaced, longer tokens first, whatever the case."""
    pattern = "|".join(re.escape(c) for c in sorted(canaries, key=lambda c: (-len(c), c)))
    return F.regexp_replace(text, f"(?i)(?:{pattern})", REDACTION.replace("$", r"\$")) if canaries else text


def unknown_references(claims: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """Claims whose key is not among the known rows."""
    return claims.join(known.select(*key).distinct(), key, "left_anti")


def dispatched(calls: DataFrame, tool: str, allowed: tuple[str, ...]) -> DataFrame:
    """calls with decision: FORWARD for an allowed tool, else HARD_BLOCK; null is no tool."""
    return calls.withColumn("decision", F.when(F.coalesce(F.col(tool).isin(*allowed), F.lit(False)), "FORWARD").otherwise("HARD_BLOCK"))


def _rewritten(document: dict, rewrite: Callable[[str, str, str], str]) -> dict:
    """A document of any depth with every text and key replaced by rewrite(text, locator, 'value' or 'key'). Keys that
    become equal are told apart by '#2', '#3' and on."""
    top: dict = {}
    due = [(document, top, "")]
    while due:
        source, target, path = due.pop()
        pairs = source.items() if isinstance(source, dict) else enumerate(source)
        for key, x in pairs:
            at = f"{path}/{str(key).replace('~', '~0').replace('/', '~1')}"
            if isinstance(x, (dict, list)):
                new = {} if isinstance(x, dict) else []
                due.append((x, new, at))
            else:
                new = rewrite(x, at, "value") if isinstance(x, str) else x
            if isinstance(source, dict):
                name = plain = rewrite(key, at, "key")
                n = 1
                while name in target:
                    n += 1
                    name = f"{plain}#{n}"
                target[name] = new
            else:
                target.append(new)
    return top


def _over_documents(df: DataFrame, key: str, column: str, made: Callable, fields: str) -> DataFrame:
    """made(document) gives the rows (without key) of each JSON object of a column; other texts give none."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key), F.col(column).cast("string").alias("_d"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                owner, found = [], []
                for at, text in enumerate(part.column("_d").to_pylist()):
                    document = parse_object(text, keep_entries=False)
                    if document is not None:
                        new = made(document)
                        owner += [at] * len(new)
                        found += new
                names = [f.split()[0] for f in fields.split(", ")]
                columns = list(zip(*found)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(owner, pa.int32())), *[pa.array(c, pa.string()) for c in columns]], names=[key, *names])

    return rows.mapInArrow(stage, f"`{key}` {kind}, {fields}")


def nested_canary_hits(df: DataFrame, key: str, document: str, canaries: list[str]) -> DataFrame:
    """(key, locator, kind, token): the tokens in the texts (kind value) and the keys (kind key) of nested JSON objects,
    whatever the case, once per place; the locator is the JSON pointer of the value."""
    tokens = [(c, c.lower()) for c in dict.fromkeys(canaries)]

    def made(found: dict) -> list[tuple]:
        hits: dict[tuple, None] = {}

        def look(text, at, kind):
            low = text.lower()
            hits.update(dict.fromkeys((clean(at), kind, c) for c, wanted in tokens if wanted in low))
            return text

        _rewritten(found, look)
        return sorted(hits)

    return _over_documents(df, key, document, made, "locator string, kind string, token string")


def redacted_documents(df: DataFrame, key: str, document: str, canaries: list[str]) -> DataFrame:
    """(key, redacted): JSON objects with every token in their texts and keys replaced."""
    pattern = re.compile("|".join(re.escape(c) for c in sorted(canaries, key=lambda c: (-len(c), c))) or r"(?!)", re.IGNORECASE)
    return _over_documents(df, key, document, lambda found: [(clean(written(_rewritten(found, lambda text, *_: pattern.sub(REDACTION, text)))),)], "redacted string")


def escaped_documents(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, escaped): JSON objects with the markup in their texts and keys escaped."""
    escape = lambda text, *_: text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return _over_documents(df, key, document, lambda found: [(clean(written(_rewritten(found, escape))),)], "escaped string")


def finding_summaries(findings: DataFrame, identifier: str, techniques: str, text: str, none: str = "No direct mapping") -> DataFrame:
    """(identifier, techniques, summary): findings as they are shown: their id where it is well formed, technique ids
    without the sentinel, escaped, and their text cut and escaped."""
    kept = F.transform(F.filter(techniques, lambda x: x.isNotNull() & (x != none)), escape_markup)
    return findings.filter(F.col(identifier).rlike(r"^EVD-[0-9]{4}-[0-9]{4,}$")).select(identifier, kept.alias(techniques), summary(F.col(text)).alias("summary"))
