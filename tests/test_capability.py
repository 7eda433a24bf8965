import json

from siltstone.operators import capability

DOC = {"rules": {
    "b": {"meta": {"namespace": None, "attack": [{"parts": ["P"], "technique": "T", "subtechnique": "S", "id": "T1.1"}, {"technique": "x"}, "Tac::Tech::Sub [T2]", "[T9]", "a::b", 5, None, {"id": 7}]}},
    "sub": {"meta": {"is_subscope_rule": True, "attack": [{"id": "T5"}]}}, "sub2": {"meta": {"capa/subscope": True, "attack": [{"id": "T8"}]}}, "text": {"meta": {"is_subscope_rule": "true", "attack": [{"id": "T7"}]}},
    "odd/~": 5, "m": {"meta": 3}, "l": {"meta": {"attack": "no"}}, "n": {"meta": {"namespace": 4}},
}}
REPEATED = '{"rules": {"x": {"meta": {"attack": [{"id": "T1"}]}}, "y": {"meta": {"attack": [{"id": "T2"}]}}, "x": {"meta": {"attack": [{"id": "T3"}], "attack": [{"id": "T4"}]}}}}'


def rows(spark):
    return spark.createDataFrame([(1, json.dumps(DOC)), (2, None), (3, "{"), (4, "[]"), (5, REPEATED), (6, '{"rules": {}}'), (7, '{"a": 1}')], "record_id long, report string")


def test_flags_are_literal_and_faults_are_told(spark):
    found = capability.entries(rows(spark), ["record_id"])
    assert {r.technique_id for r in capability.techniques(found).collect() if r.record_id == 1} == {"T1.1", "T2", "T9", "T7"}
    faults = {r.locator: r.fault for r in found.collect() if r.fault and r.record_id == 1}
    b = "/rules/b/meta/attack"
    assert faults == {
        f"{b}/1": "entry has no id", f"{b}/4": "entry has no id", f"{b}/5": "entry is no object or text", f"{b}/6": "entry is no object or text", f"{b}/7": "entry has a field that is no text",
        "/rules/odd~1~0": "rule is no object", "/rules/m/meta": "meta is no object", "/rules/l/meta/attack": "techniques are no list", "/rules/n/meta/namespace": "namespace is no text",
    }


def test_a_repeated_rule_counts_once(spark):
    got = capability.capabilities(rows(spark), ["record_id"]).filter("record_id = 5").orderBy("rule_pos").collect()
    assert [(r.rule_pos, r.technique_id) for r in got] == [(0, "T4"), (1, "T2")]


def test_status_tells_errors_from_nothing(spark):
    got = {r.record_id: (r.status, r.techniques, r.faults) for r in capability.status(rows(spark), ["record_id"]).collect()}
    assert got == {1: ("FAULTY", 4, 9), 2: ("BROKEN", 0, 0), 3: ("BROKEN", 0, 0), 4: ("BROKEN", 0, 0), 5: ("READ", 2, 0), 6: ("READ", 0, 0), 7: ("NO_RULES", 0, 0)}
