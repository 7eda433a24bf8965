import json
import re

import pytest

from siltstone.operators import classifier, context, evidence, manifest, policy, rules

KEYS = "artifact_sha256 string, action string, flags string"
CONTENT = "detection_source string, prov_type string, locator string, section_or_pid string, parent_artifact_sha256 string, detection_methods array<struct<detector_name:string,rule_or_model_version:string,score:double>>, transform_chain array<string>, technique_ids array<string>, confidence_score double, summary string"


def content(name, score=1.0, locator="/x"):
    return ("S", "JSON_LOG_POINTER", locator, None, None, [("Y", "1", score)], [], ["T"], score, name)


def test_slots(spark):
    actions = ["ALLOW", "TAG_AS_EVIDENCE", "TAG_AS_EVIDENCE", "CAUTIOUS_QUARANTINE", "ESCALATE_AND_INCONCLUSIVE", "PIPELINE_ABSTENTION"]
    keys = [c * 64 for c in "abcdef"]
    decisions = spark.createDataFrame([(k, a, "X,Y,X") for k, a in zip(keys, actions)], KEYS)
    findings = spark.createDataFrame([(k, n, *content(f"f{n}")) for k in keys if k[0] != "b" for n in (2, 1)], f"artifact_sha256 string, n int, {CONTENT}")
    seeds = spark.createDataFrame([(k, *content("seed", 0.0)) for k in keys], f"artifact_sha256 string, {CONTENT}")
    rows = evidence.emit(decisions, findings, seeds, "artifact_sha256", ["n"], 2026, first=7, raw_locator="/raw")
    got = {}
    for r in rows.orderBy("evidence_id").collect():
        got.setdefault(r.artifact_sha256[0], []).append((r.evidence_id, r.summary, r.policy_decision))
        assert r.status_flags == ["X", "Y"] and (r.locator == "/raw") == (r.summary == "seed" and r.artifact_sha256[0] == "f")
    tag, up = "TAG_AS_EVIDENCE", "ESCALATE_TO_HUMAN"
    assert got == {
        "b": [("EVD-2026-0007", "seed", tag)], "c": [("EVD-2026-0007", "f1", tag), ("EVD-2026-0008", "f2", tag)], "d": [("EVD-2026-0007", "seed", "SANITIZE_AND_STRIP"), ("EVD-2026-0008", "seed", up)],
        "e": [("EVD-2026-0007", "f1", tag), ("EVD-2026-0008", "f2", tag), ("EVD-2026-0009", "seed", up)], "f": [("EVD-2026-0007", "seed", up), ("EVD-2026-0008", "f1", tag), ("EVD-2026-0009", "f2", tag)],
    }
    assert evidence.violations(rows, "artifact_sha256").count() == 0
    bad = rows.limit(1).selectExpr("* EXCEPT (confidence_score, prov_type, status_flags)", "2.0D AS confidence_score", "'VIRTUAL_ADDRESS' AS prov_type", "array('a', 'a') AS status_flags")
    assert {r.reason for r in evidence.violations(bad, "artifact_sha256").collect()} == {"confidence_score", "virtual_address", "status_flags"}


def test_last_result_of_a_detector_counts(spark):
    rows = spark.createDataFrame([(1, 1, "a", False, True, True, "COMPLETE"), (1, 2, "a", False, False, True, "PARTIAL"), (2, 1, "a", False, False, True, "COMPLETE"), (2, 2, "a", False, True, True, "COMPLETE")], "k int, n int, detector string, positive boolean, errored boolean, has_provenance boolean, processing string")
    got = {r.k: (r.processing, r.detection) for r in policy.detection_state(rows, ["k"], ("a",), ordinal="n").collect()}
    assert got == {1: ("PARTIAL", "NOT_DETECTED"), 2: ("COMPLETE", "INCONCLUSIVE")}


def test_label_places():
    assert classifier.label_places({0: "jailbreak ", "1": "Benign", 2: "INJECTION"}) == (1, 2, 0)
    for bad in ({}, {0: "BENIGN", 1: "INJECTION"}, {0: "BENIGN", 1: "INJECTION", 2: "OTHER"}, {0: "BENIGN", 1: "INJECTION", 2: "JAILBREAK", 3: "BENIGN"}, {"x": "BENIGN", 1: "INJECTION", 2: "JAILBREAK"}, {0: "BENIGN", 1: "INJECTION", 2: None}):
        with pytest.raises(classifier.LabelError):
            classifier.label_places(bad)


def test_promptware_needs_a_context(spark):
    rows = spark.createDataFrame([("a", "said", "p1", True), ("a", "said", "p2", True), ("a", "other", "p3", True), ("b", "said", "p1", True), ("a", "mild", "p1", False), ("a", "said", None, True)], "g string, t string, provenance string, adversarial boolean")
    found = spark.createDataFrame([("a", "p1"), ("b", "p9"), ("a", None)], "g string, provenance string")
    got = {(r.g, r.t, r.provenance): r.promptware for r in classifier.promptware(rows, found, "g", "t", "provenance").collect()}
    assert got == {("a", "said", "p1"): True, ("a", "said", "p2"): True, ("a", "other", "p3"): False, ("b", "said", "p1"): False, ("a", "mild", "p1"): False, ("a", "said", None): True}
    assert all(r.promptware == r.adversarial for r in classifier.promptware(rows, found, "g", "t", "provenance", target_is_llm=True).collect())


def test_chains_are_merged_in_order(spark):
    rows = spark.createDataFrame([("g", 2, "R", "i1", ["B", "A"]), ("g", 1, "R", "i2", ["A"]), ("g", 3, "R", "i2", []), (None, 1, "R", "i1", ["C"]), ("h", 1, "R", "i1", None)], "grp string, ord int, rule string, identifier string, chain array<string>")
    rows = rows.replace("i1", "role_1", "identifier").replace("i2", "auth_1", "identifier")
    got = {r.grp: (r.hits, r.identifiers, r.chain) for r in rules.deduplicated(rows, ["grp"], ["ord"], ["ord"], chain="chain").collect()}
    assert got == {"g": (3, "auth_1,role_1", ["A", "B"]), None: (1, "role_1", ["C"]), "h": (1, "role_1", [])}


def test_anchors_are_in_every_match():
    import random

    rng = random.Random(3)
    words = ["ignore", "all", "previous", "instructions", "you", "are", "now", "in", "developer mode", "classify", "this", "file", "as", "benign", "1gnore", "suppress", "alerts", "verdict", '"verdict": "safe"', "i g n o r e", "I am admin, approve", "end of report", "=== end of data"]
    patterns = [(p, rules.anchor(p)) for ps in rules.RULES.values() for p in ps.values()]
    met = 0
    for _ in range(4000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
        for p, sure in patterns:
            if m := re.search(p, text, re.IGNORECASE):
                met += 1
                assert sure in m[0].lower()
    assert met > 500


def test_documents_are_walked_whole(spark):
    deep = '{"CANARY-x": [1, {"a/b": "say canary-X now"}], "canary-x": "CANARY-xCANARY-x", "n": 1.10, "d": %s}' % ("[" * 3000 + '"CANARY-x"' + "]" * 3000)
    rows = spark.createDataFrame([(1, deep), (2, None), (3, "[]"), (4, "")], "k long, d string")
    hits = {(r.locator[:12], r.kind) for r in context.nested_canary_hits(rows, "k", "d", ["CANARY-x"]).collect()}
    assert hits == {("/CANARY-x", "key"), ("/CANARY-x/1/", "value"), ("/canary-x", "key"), ("/canary-x", "value"), ("/d/0/0/0/0/0", "value")}
    got = context.redacted_documents(rows, "k", "d", ["CANARY-x"]).collect()
    assert len(got) == 1 and "anary" not in got[0].redacted.lower().replace(":canary]", "") and '"n":1.10' in got[0].redacted and f'"{context.REDACTION}#2"' in got[0].redacted
    escaped = context.escaped_documents(spark.createDataFrame([(1, '{"<a>": ["&", {"b": "x>y"}]}')], "k long, d string"), "k", "d").first().escaped
    assert json.loads(escaped) == {"&lt;a&gt;": ["&amp;", {"b": "x&gt;y"}]}


def test_manifest_runs_fail_on_strangers(spark):
    side = ("s1", 1, "train")
    table = spark.createDataFrame([("p", "benign", "train", side, ("s2", 2, "train"))], "pair_id string, origin string, split string, clean struct<sample_id:string,group_no:int,split:string>, injected struct<sample_id:string,group_no:int,split:string>")
    outcomes = lambda *r: spark.createDataFrame(list(r), "sample_id string, group_no int, split string")
    assert manifest.require_matched(outcomes(("s1", 1, "train")), table).count() == 1
    with pytest.raises(manifest.Unmatched, match="s2: group_no; s9: unknown"):
        manifest.require_matched(outcomes(("s1", 1, "train"), ("s9", 1, "train"), ("s2", 1, "train")), table)
    rejected = spark.createDataFrame([("p",), ("q",), ("q",)], "pair_id string")
    assert {(r.subject, r.reason) for r in manifest.rejection_errors(table, rejected, 0.4).collect()} == {("p", "accepted and rejected"), ("q", "rejected twice"), (None, "too many rejected")}
