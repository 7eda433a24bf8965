import json
import random

from siltstone.functions.json_text import as_text, decode_deep, parse_object, type_of, written
from siltstone.operators import extraction, schema_drift, shredding

DEEP = "[" * 20_000 + "]" * 20_000


def test_numbers_stay_as_they_are_written():
    long = "9" * 5000
    found = parse_object('{"a": [1.10, -0, 123456789012345678901234567890.123456789, 1e400, %s], "b": 1.10}' % long)
    assert as_text(found["a"]) == f"[1.10,-0,123456789012345678901234567890.123456789,1e400,{long}]" and as_text(found["b"]) == "1.10"
    assert [type_of(x) for x in found["a"]] == ["fraction", "integer", "fraction", "fraction", "integer"]


def test_any_depth():
    found = parse_object('{"x": %s, "y": 1.50}' % DEEP)
    assert as_text(found["y"]) == "1.50" and as_text(found["x"]) == DEEP
    assert parse_object('{"x": %s}' % DEEP[:-1]) is None


def test_deep_decoder_reads_what_the_plain_one_reads():
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(8) if depth else 0
        if kind < 4:
            return rng.choice([1, -5, True, None, 'a"\n\u00e9', 1.5, "", [], {}])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind < 6 else {rng.choice("abcd"): value(depth - 1) for _ in range(rng.randrange(4))}

    def read(decode, text):
        try:
            return decode(text)
        except ValueError:
            return ValueError

    for _ in range(1500):
        text = json.dumps(value(5), indent=rng.choice([None, 1]))
        cut = text[: rng.randrange(len(text) + 1)] + rng.choice(["", ",", "]", "}", '"']) + text[rng.randrange(len(text) + 1) :]
        for t in (text, cut):
            assert read(lambda x: json.loads(written(decode_deep(x))), t) == read(json.loads, t)


def test_deep_reports_lose_nothing(spark):
    call = {"api": "MessageBoxA", "arguments": [{"name": "lpText", "value": "hello there"}]}
    text = json.dumps({"behavior": {"processes": [{"process_id": 7, "calls": [call]}]}, "junk": "JUNK"}).replace('"JUNK"', DEEP)
    rows = spark.createDataFrame([(1, "s", text)], "report_id long, artifact_sha256 string, report string")
    assert [(r.argument_name, r.argument_value) for r in shredding.arguments_table(rows).collect()] == [("lpText", "hello there")]
    assert [(r.section_or_pid, r.raw_string) for r in extraction.telemetry_strings(rows).collect()] == [("7", "hello there")]
    assert extraction.telemetry_coverage(rows).first().coverage == "COMPLETE"


def test_deep_schemas_are_whole(spark):
    feed = [(i, "f", i, '{"before": 1, "x": %s, "zz%d": 2}' % ("[" * n + tail + "]" * n, i)) for i, n, tail in ((1, 3000, "1"), (2, 3000, '"s"'), (3, 2999, '"s"'))]
    _, steps = schema_drift.drift(spark.createDataFrame(feed, "record_id long, feed string, file_no int, report string"))
    got = sorted((r.file_no, r.change_kind, len(r.field_path)) for r in steps.collect())
    assert got == [(2, "renamed", 3), (2, "type_changed", 1 + 2 * 3000), (3, "renamed", 3), (3, "type_changed", 1 + 2 * 2999)]
