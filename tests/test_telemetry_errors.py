import json

import pytest

from siltstone.operators import extraction

GOOD = {"name": "lpText", "value": "hello world"}


def report(*processes):
    return {"behavior": {"processes": [*processes]}}


def call(**fields):
    return {"api": "MessageBoxA", "arguments": [GOOD]} | fields


def test_seventeen_checks_in_order_and_coverage(spark):
    texts = [
        [], {}, {"behavior": 1}, {"behavior": {}}, {"behavior": {"processes": {}}},
        report("odd", {}, {"process_id": True, "calls": 5}, {"process_id": 1.5, "calls": [
            3, {"api": 4}, {"api": "Sleep", "timestamp": 1}, call(timestamp=1, arguments=None), call(arguments="x"), call(arguments=[1, {"name": 2}, {"name": "other", "value": 3}, {"name": "lpText", "value": 4}, GOOD]),
        ]}), report({"process_id": "7", "calls": [call(timestamp="now")]}),
    ]
    rows = [(i, json.dumps(t)) for i, t in enumerate(texts)] + [(7, '{"behavior": 1, "behavior": {"processes": []}}'), (8, None), (9, "{")]
    reports = spark.createDataFrame(rows, "report_id long, report string")
    got = extraction.telemetry_errors(reports).orderBy("report_id", "ord").collect()
    p, c = "/behavior/processes", "/behavior/processes/3/calls"
    assert [(r.report_id, r.path, r.reason) for r in got] == [
        (0, "/", "report is no object"), (1, "/behavior", "behavior is missing"), (2, "/behavior", "behavior is no object"), (3, p, "processes is missing"), (4, p, "processes is no list"),
        (5, f"{p}/0", "process is no object"), (5, f"{p}/1/calls", "calls is missing"), (5, f"{p}/2/process_id", "process_id is no integer or text"), (5, f"{p}/2/calls", "calls is no list"), (5, f"{p}/3/process_id", "process_id is no integer or text"),
        (5, f"{c}/0", "call is no object"), (5, f"{c}/1/api", "api is missing or no text"), (5, f"{c}/3/timestamp", "timestamp is no text"), (5, f"{c}/3/arguments", "arguments is missing"), (5, f"{c}/4/arguments", "arguments is no list"),
        (5, f"{c}/5/arguments/0", "argument is no object"), (5, f"{c}/5/arguments/1/name", "name is missing or no text"), (5, f"{c}/5/arguments/3/value", "value is missing or no text"), (8, "/", "report is no object"), (9, "/", "report is no object"),
    ]
    coverage = {r.report_id: r.coverage for r in extraction.telemetry_coverage(reports).collect()}
    assert coverage == {i: "COMPLETE" if i in (6, 7) else "PARTIAL" for i in range(10)}


def test_nothing_is_looked_at_after_the_budget(spark):
    reports = spark.createDataFrame([(1, json.dumps(report({"calls": [call(), 5, call(), 6]})))], "report_id long, report string")
    for budget, paths in ((2, [1, 3]), (1, [1]), (0, [])):
        got = extraction.telemetry_errors(reports, budget).collect()
        assert [r.path for r in got] == [f"/behavior/processes/0/calls/{i}" for i in paths]
        assert extraction.telemetry_coverage(reports, budget).first().truncated == (budget < 2)
    with pytest.raises(ValueError):
        extraction.telemetry_errors(reports, -1)
