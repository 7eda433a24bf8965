"""JSON texts as variants, and the types found in them, as columns."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.json_text import clean, parse_object, pruned, written


def object_variant(text: Column, fields: Sequence[str] | None = None) -> Column:
    """A JSON text as a variant. Texts that try_parse_json refuses, but that hold an object, are written anew: of a
    key that an object repeats the last value counts, only `fields` (all where None) are kept, and containers below
    the parser's depth are empty. Null for other broken texts."""

    @F.arrow_udf("string")
    def rewritten(texts: pa.Array) -> pa.Array:
        found = [parse_object(t, keep_entries=False) for t in texts.to_pylist()]
        return pa.array([None if x is None else clean(written(pruned(x, x if fields is None else fields))) for x in found], pa.string())

    plain = F.try_parse_json(text)
    return F.coalesce(plain, F.try_parse_json(rewritten(F.when(plain.isNull(), text))))


def part(value: str, path: str) -> str:
    """SQL of the variant at a path."""
    return f"try_variant_get({value}, '{path}', 'variant')"


_NESTED = {"ARRAY": "array<variant>", "OBJECT": "map<string,variant>"}


def is_a(value: str, kind: str) -> str:
    """SQL: whether a variant is a STRING, BOOLEAN, BIGINT, OBJECT or ARRAY; false for none. Of containers only the
    elements are looked up; their schema would be that of all that is in them."""
    if kind in _NESTED:
        return f"(try_variant_get({value}, '$', '{_NESTED[kind]}') IS NOT NULL)"
    return f"coalesce(schema_of_variant({value}) LIKE '{kind}%', false)"


def list_at(value: str, path: str) -> str:
    """SQL of the elements of a list at a path; an empty array where there is none."""
    return f"coalesce(try_variant_get({value}, '{path}', 'array<variant>'), array())"


def text_at(value: str, path: str) -> str:
    """SQL of the text at a path; null for anything but text."""
    return f"CASE WHEN {is_a(part(value, path), 'STRING')} THEN try_variant_get({value}, '{path}', 'string') END"


def missing(value: str, path: str) -> str:
    """SQL: whether there is nothing or null at a path."""
    return f"({part(value, path)} IS NULL OR is_variant_null({part(value, path)}))"
