from siltstone.operators import extraction, facts

TEXT = '{"behavior": 1, "behavior": {"processes": [{"process_id": 1, "process_id": 7, "calls": [{"api": "MessageBoxA", "arguments": [{"name": "lpText", "value": "first text", "value": "last text \\u00e9"}]}]}]}, "network": {"hosts": [{"ip": "1.1.1.1", "ip": "2.2.2.2"}]}, "detections": [{"family": "a", "family": "b", "details": [{"Yara": "s"}]}]}'


def test_reports_that_repeat_a_key_are_kept(spark):
    rows = spark.createDataFrame([(1, "s", TEXT), (2, "s", '{"a": 1, "a": '), (3, "s", None), (4, "s", '[{"a": 1, "a": 2}]')], "report_id long, artifact_sha256 string, report string")
    assert [(r.report_id, r.section_or_pid, r.raw_string) for r in extraction.telemetry_strings(rows).collect()] == [(1, "7", "last text é")]
    assert [r.canonical for r in facts.indicators(facts.within_budget(facts.records(rows))).collect()] == ["2.2.2.2"]
    assert [r.family for r in facts.reported_families(rows).collect()] == ["b"]
