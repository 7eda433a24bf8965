import json
import random

import pytest

from siltstone.operators import shredding as sh

SCHEMA = "report_id long, rep string, record string, report string"


def table(spark, reports):
    return spark.createDataFrame([(i, "x", "y", r) for i, r in enumerate(reports)], SCHEMA)


def plain(value):
    if isinstance(value, tuple):
        return {k: plain(v) for k, v in value[1]}
    return [plain(v) for v in value] if isinstance(value, list) else value


def brute(report):
    try:
        document = json.loads(report, object_pairs_hook=lambda p: ("o", p), parse_constant=lambda c: 1 / 0)
    except (ValueError, TypeError, ZeroDivisionError):
        return
    get = lambda o, k: dict(o[1]).get(k) if isinstance(o, tuple) else None
    items = lambda v: [v] if isinstance(v, tuple) else v if isinstance(v, list) else []
    for i, p in enumerate(items(get(get(document, "behavior"), "processes"))):
        for j, c in enumerate(items(get(p, "calls"))):
            a = get(c, "arguments")
            if isinstance(a, tuple):
                yield from ((i, j, k, n) for k, (n, _) in enumerate(a[1]))
            for k, x in enumerate(a if isinstance(a, list) else []):
                if isinstance(x, tuple):
                    n = get(x, "name")
                    yield i, j, k, "" if n is None else n if isinstance(n, str) else json.dumps(plain(n), separators=(",", ":"))


def found(spark, reports):
    rows = sh.arguments_table(table(spark, reports), values=False).collect()
    return sorted((r.report_id, r.process_pos, r.call_pos, r.argument_pos, r.argument_name) for r in rows)


def wrap(processes):
    return json.dumps({"behavior": {"processes": processes}})


def test_odd_reports(spark):
    call = {"api": "x", "arguments": [{"name": "a", "value": 1}, 7, None, {"value": "b"}, {"name": None}, [], {"name": 3}]}
    reports = [
        None, "", "null", "[]", "{", "[1]", '{"behavior": 5}', '{"behavior": {"processes": null}}', '{"a": NaN, "behavior": {"processes": []}}',
        wrap([{"calls": [call]}]), wrap({"calls": call}), wrap([None, 5, {"calls": None}, {"calls": [3, call, call]}]),
        '{"behavior":{"processes":[{"calls":[{"arguments":{"b":1,"a":2,"b":3}}]}]}}', wrap([{"calls": [{"arguments": {}}, {"arguments": "text"}, {}]}]),
        wrap([{"calls": [{"arguments": [{"name": "n" * 100_000}]}]}]), '{"x":' + "9" * 5000 + ',"behavior":{"processes":{"calls":{"arguments":[{}]}}}}',
        wrap([{"calls": [call]}]),
    ]
    reports = [r for r in reports if not (r and "9999" in r)] + [r for r in reports if r and "9999" in r]
    want = sorted((i, *row) for i, r in enumerate(reports) if r is not None and "9999" not in r for row in brute(r))
    got = found(spark, reports)
    assert [g for g in got if g[0] < len(reports) - 1] == want
    assert [g[1:] for g in got if g[0] == len(reports) - 1] == [(0, 0, 0, "")]


def test_random_reports(spark):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(8)
        if kind < 4 and depth < 5:
            key = ["behavior", "processes", "calls", "arguments", "name"][depth]
            inner = value(depth + 1)
            return {key: inner} if kind < 2 or depth == 0 else [{["behavior", "processes", "calls", "arguments", "name"][min(4, depth)]: value(depth + 1)} for _ in range(rng.randrange(3))]
        return rng.choice([None, 1, "s", [], {}, [1, {}], True])

    reports = [wrap([{"calls": [{"arguments": value(4)} for _ in range(rng.randrange(4))]} if rng.random() < 0.8 else value(3) for _ in range(rng.randrange(4))]) for _ in range(300)]
    assert found(spark, reports) == sorted((i, *row) for i, r in enumerate(reports) for row in brute(r))


def test_tables_link(spark):
    reports = [wrap([{"process_id": 4, "process_name": "a", "calls": [{"api": "x", "arguments": [{"name": "n", "value": {"b": [1]}}]}]}])]
    t = table(spark, reports)
    joined = sh.processes_table(t).join(sh.calls_table(t), ["report_id", "process_pos"]).join(sh.arguments_table(t), ["report_id", "process_pos", "call_pos"]).collect()
    assert [(r.process_id, r.api, r.argument_value) for r in joined] == [("4", "x", '{"b":[1]}')]


def test_empty_and_null_ids(spark):
    assert sh.arguments_table(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(None, "", "", wrap([{"calls": [{"arguments": {"k": 1}}]}]))] * 2, SCHEMA)
    assert [tuple(r) for r in sh.arguments_table(one, values=False).collect()] == [(None, 0, 0, 0, "k")] * 2


@pytest.mark.parametrize("leaf", ["name", "value"])
def test_round_trip_levels(spark, leaf):
    report = wrap([{"calls": []}, {"calls": [{"arguments": [{"name": "a", "value": "1"}]}, {"arguments": []}]}])
    root = sh.behaviour_layout(arguments=(leaf,))
    row = sh.shred(table(spark, [report]), "report_id", "report", root).first()[f"{sh.ARGUMENT_PATH}/{leaf}"]
    assert (row["rep"], row["def"]) == ([0, 1, 2], [3, 8, 5])


def test_surrogates(spark):
    assert found(spark, ['{"behavior":{"processes":{"calls":{"arguments":{"\\ud800x":1}}}}}'])[0][4] == "?x"
