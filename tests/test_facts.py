import json

import pytest

from siltstone.operators import facts

SHA = "a" * 64
REPORTS, CAPA, ALIASES = "report_id long, artifact_sha256 string, report string", "artifact_sha256 string, report string", "alias_name string, canonical_name string"


def call(name="HKLM/x/Run\\evil", **more):
    given = [{"name": "FullName", "value": name}, {"name": "Buffer", "value": "x"}]
    return {"api": "RegSetValueExA", "status": True, "arguments": given} | more


REPORT = {
    "target": {"file": {"sha256": SHA.upper()}},
    "behavior": {"processes": [{"calls": [call(), call("HKLM\\RunOnce\\b", status=0), call(status=2), call("a\\Run"), call("none"), call(arguments=4), call(arguments=[{"name": "FullName", "value": "a"}] * 2), {"api": "x"}, 5, call("a\\RunSomething\\b")]}, 7]},
    "detections": [{"family": "Agt", "details": [{"Yara": SHA, "x": 1}, {"clamav": SHA.upper()}]}, {"family": "Zed", "details": [{"Yara": "b" * 64}]}, {"family": "", "details": []}, {"family": "q", "details": [{"yara": SHA}]}],
    "network": {
        "http": [{"uri": "http://a.b/", "host": "a.b", "source": "behavior"}, 5, {"host": "A.B"}, {"uri": "http://u:p@x/", "host": 3}, {}],
        "dns": [{"request": "1.1.1.1", "answers": [{"type": "a", "data": "2.2.2.2"}, {"type": "TXT", "data": "3.3.3.3"}]}, {"request": "Bücher.example.", "answers": 7}],
        "tcp": {"dst": "9.9.9.9"}, "udp": [{"dst": "::0001", "source": 4}], "hosts": [{"ip": "2.2.2.2"}],
    },
}
CAPABILITY = {"meta": {"sample": {"sha256": SHA}}, "rules": {"synthetic/persistence~rule": {"meta": {"attack": [{"id": "T1547.001"}, {"id": "T1071.001"}, {"id": "odd"}, {}]}}}}


@pytest.fixture(scope="module")
def found(spark):
    reports = spark.createDataFrame([(1, SHA.upper(), json.dumps(REPORT)), (2, "b" * 64, None), (3, None, "{"), (4, SHA, "[]")], REPORTS)
    return facts.records(reports, spark.createDataFrame([("AGT", "agent_t")], ALIASES), spark.createDataFrame([(SHA, json.dumps(CAPABILITY))], CAPA))


def test_facts(found):
    got = [r for r in facts.facts(facts.within_budget(found)).orderBy("fact_id").collect() if r.report_id == 1]
    assert [(r.fact_id, r.kind, r.value, r.basis, r.n) for r in got] == [
        ("FACT-0001", "CAPABILITY", "T1547.001", "CAPABILITY", 1), ("FACT-0002", "CAPABILITY", "T1071.001", "CAPABILITY", 1), ("FACT-0003", "AUTORUN_WRITE_SUCCESS", "true", "OBSERVED", 1), ("FACT-0004", "AUTORUN_WRITE_ATTEMPT", "true", "ATTEMPTED", 1),
        ("FACT-0005", "REPORTED_FAMILY", "agent_t", "REPORTED_DETECTION", 1), ("FACT-0006", "UNMAPPED_REPORTED_FAMILY", "true", "REPORTED_DETECTION", 1), ("FACT-0007", "NETWORK_ACTIVITY", "1", "ATTEMPTED", 1), ("FACT-0008", "NETWORK_ACTIVITY", "5", "OBSERVED", 5),
    ]
    assert got[0].sources[0].locator == "/rules/synthetic~1persistence~0rule/meta/attack/0/id"
    assert [s.locator for s in got[4].sources] == ["/detections/0/family", "/detections/0/details/0/Yara", "/detections/0/details/1/clamav"]


def test_indicators(found):
    got = facts.indicators(facts.within_budget(found)).orderBy("ioc_id").collect()
    assert [(r.ioc_id, r.kind, r.value, r.display, r.sources) for r in got] == [
        ("IOC-0001", "URL", "http://a.b/", "hxxp://a[.]b/", 1), ("IOC-0002", "DOMAIN", "a.b", "a[.]b", 2), ("IOC-0003", "IP", "2.2.2.2", "2[.]2[.]2[.]2", 2),
        ("IOC-0004", "DOMAIN", "Bücher.example.", "xn--bcher-kva[.]example", 1), ("IOC-0005", "IP", "::1", "::1", 1),
    ]


def test_issues(found):
    got = {(r.locator, r.partial) for r in facts.issues(found).collect() if r.report_id == 1}
    p = "/behavior/processes/0/calls"
    assert got == {
        (f"{p}/2", True), (f"{p}/3", True), (f"{p}/5", True), (f"{p}/6", True), ("/detections/1", False), ("/detections/2", True), ("/network/http/1", True), ("/network/http/4", True), ("/network/dns/1", True), ("/network/udp/0", True),
        ("/rules/synthetic~1persistence~0rule/meta/attack/3", True), ("/network/http/3/uri", True), ("/network/http/3/host", True), ("/network/dns/0/request", True),
    }


def test_one_budget_over_all_kinds(found):
    kept = facts.within_budget(found, 3).filter("report_id = 1")
    assert {r.kind for r in kept.collect()} == {"CAPABILITY", "AUTORUN_WRITE_SUCCESS"} and kept.first().truncated
    got = [(r.locator, r.reason) for r in facts.issues(found, 3).filter("report_id = 1").collect()]
    assert sorted(got) == [("/behavior/processes/0/calls/1", "more than 3 records"), ("/rules/synthetic~1persistence~0rule/meta/attack/3", "entry has no id")]


@pytest.mark.parametrize(("role", "raw", "want"), [
    ("uri", "http://A.example:80/x?y", "hxxp://a[.]example:80/x?y"), ("uri", "https://[::1]/", "hxxps://[::1]/"), ("uri", "//1.2.3.4/x", "1[.]2[.]3[.]4"), ("uri", "ftp://a/", None), ("uri", "http://u:p@a/", None), ("uri", "http://a:99999/", None),
    ("uri", "relative", None), ("uri", "http://a.b:/?#", "hxxp://a[.]b/"), ("uri", "http://-a.b/", None), ("uri", " HTTPS://a.b:0443/q#f", "hxxps://a[.]b:443/q#f"), ("uri", "http:///x", None), ("host", "[1.2.3.4]", "1[.]2[.]3[.]4"), ("host", "a_b.c", None),
    ("host", " a.b", None), ("host", "x" * 64 + ".b", None), ("host", "01.2.3.4", "01[.]2[.]3[.]4"), ("request", "1.2.3", None), ("request", "1.2.3.x", "1[.]2[.]3[.]x"), ("address", "a.b", None), ("address", "2001:DB8::0:1", "2001:db8::1"), ("host", "１.2.3.4", "1[.]2[.]3[.]4"),
])
def test_fields(spark, role, raw, want):
    row = facts.read_fields(spark.createDataFrame([(role, raw, None)], "role string, raw string, fault string")).first()
    assert row.display == want and (row.fault is None) == (want is not None)


def test_bindings(spark):
    capa = json.dumps(CAPABILITY)
    reports = spark.createDataFrame([(1, SHA.upper(), json.dumps(REPORT)), (2, "b" * 64, json.dumps(REPORT)), (3, None, None), (4, "no", "{}")], REPORTS)
    other = json.dumps({"meta": {"sample": {"sha256": "c" * 64}}})
    assert {r.report_id for r in facts.bindings(reports, spark.createDataFrame([(SHA, capa)], CAPA)).collect() if r.bound} == {1}
    assert not [r for r in facts.bindings(reports, spark.createDataFrame([(SHA, other)], CAPA)).collect() if r.bound]
    assert not [r for r in facts.bindings(reports, None, spark.createDataFrame([(SHA, bytearray(b"x"))], "artifact_sha256 string, data binary")).collect() if r.bound]
