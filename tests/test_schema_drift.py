import json

from siltstone.operators import schema_drift as sd

SCHEMA = "record_id long, feed string, file_no int, report string, path string, types int"


def table(spark, rows):
    return spark.createDataFrame([(i, f, n, r if r is None or isinstance(r, str) else json.dumps(r), "x", 1) for i, (f, n, r) in enumerate(rows)], SCHEMA)


def changes(spark, rows):
    _, steps = sd.drift(table(spark, rows))
    return sorted((r.feed, r.file_no, r.change_kind, r.field_path) for r in steps.collect())


def test_kinds(spark):
    rows = [
        ("a", 1, {"meta": {"v": "1", "old": 1}, "rules": {"r.1": {"meta": {"attack": [{"id": "T1"}]}}}, "gone": {"x": 1}}),
        ("a", 1, None), ("a", 1, "{cut"), ("a", 1, "[]"), ("a", 1, {"meta": {"v": "1", "old": 1}}),
        ("a", 3, {"meta": {"v": 1.5, "new": 2}, "rules": {"other": {"meta": {"att&ck": [{"id": "T1", "extra": 1}]}}}, "more": [1, {"y": True}]}),
        ("b", 1, {"x": None}), ("b", 2, {"x": 1}), ("b", 3, {"x": True}), ("b", 4, {"x": 1}), ("b", 4, {"x": "s"}),
        (None, 1, {"q": 1}), ("c", None, {"q": 1}), ("d", 5, "broken"), ("d", 7, {"z": 1}),
    ]
    assert changes(spark, rows) == sorted([
        ("a", 3, "type_changed", "meta.v"), ("a", 3, "renamed", "meta.new"), ("a", 3, "renamed", "rules.*.meta.att&ck"), ("a", 3, "removed", "gone"), ("a", 3, "added", "more"),
        ("b", 2, "type_changed", "x"), ("b", 3, "type_changed", "x"), ("b", 4, "type_changed", "x"), ("d", 7, "added", "z"),
    ])


def test_blocks_of_files_and_repeats(spark):
    rows = [("f", n, {"k": 1} if n < 9000 else {"k": "s"}) for n in (1, 4095, 4096, 9000, 20000)] * 2
    assert changes(spark, rows) == [("f", 9000, "type_changed", "k")]


def test_empty(spark):
    assert changes(spark, []) == []


def test_names_lead_through_renames(spark):
    rows = [
        ("a", 1, {"meta": {"version": "1"}, "rules": {"r": {"meta": {"attack": [{"id": "T1"}]}}}}),
        ("a", 2, {"meta": {"capa_version": "2"}, "rules": {"r": {"meta": {"att&ck": [{"id": "T2"}]}}}}),
        ("a", 3, {"meta": {"capa_version": "3"}, "rules": {"r": {"meta": {"att&ck": [{"technique_id": "T3"}]}}}}),
        ("a", 4, {"meta": {"capa_version": "4"}, "rules": {"r": {"meta": {"att&ck": ["Tactic::Technique [T4]"]}}}}),
        ("a", 5, {}),
    ]
    records = table(spark, rows)
    schemas, steps = sd.drift(records)
    names = sd.known_names(steps, schemas)
    assert names["meta.version"] == ["meta.capa_version"]
    got = {r.file_no: (r.meta_version, r.technique_ids) for r in sd.consistent_table(records, names).collect()}
    assert got[1] == ("1", ["T1"]) and got[2] == ("2", ["T2"]) and got[4] == ("4", ["T4"]) and got[5] == (None, [])


def routed(spark, rows):
    records = table(spark, rows)
    schemas, steps = sd.drift(records)
    names, routes = sd.file_routes(steps, schemas)
    return {(r.feed, r.file_no): (r.meta_version, r.technique_ids) for r in sd.consistent_table(records, names, routes=routes).collect()}


def test_files_are_routed_through_chained_renames(spark):
    rule = lambda name, entry: {"r": {"meta": {name: [entry]}}}
    rows = [
        ("a", 1, {"meta": {"version": "1"}, "rules": rule("attack", {"id": "T1"})}),
        ("a", 2, {"meta": {"capa_version": "2"}, "rules": rule("att&ck", {"id": "T2"})}),
        ("a", 3, {"meta": {"release": "3"}, "rules": rule("att&ck", {"technique_id": "T3"})}),
        ("a", 4, {"meta": {"release": "4", "version": "other"}, "rules": rule("att&ck", {"technique_id": "T4"})}),
        ("b", 1, {"meta": {"release": "5"}, "rules": rule("att&ck", {"technique_id": "T5"})}),
        ("b", 2, {"meta": {"version": "6"}, "rules": rule("attack", {"technique_id": "T6"})}),
        ("c", 1, {"meta": {"capa_version": "7"}, "rules": rule("att&ck", {"id": "T7"})}),
        (None, 1, {"meta": {"capa_version": "8"}, "rules": rule("att&ck", {"technique_id": "T8"})}),
    ]
    assert routed(spark, rows) == {(f, n): (str(i), [f"T{i}"]) for i, (f, n, _) in enumerate(rows, 1)}


def test_objects_and_lists_are_cast(spark):
    versions = [{"major": 7, "minor": 4, "label": "7.3.2"}, {"major": 7, "minor": 0, "label": None}, {"build": [1]}, [7, "x"], {}, True, None]
    rows = [("a", n, {"meta": {"version": v}, "rules": {"r": {"meta": {"namespace": ["x", None, {"y": 1}], "attack": [{"id": ["T1", "T2"]}, {"id": {"n": 3}}]}}}}) for n, v in enumerate(versions)]
    records = table(spark, rows)
    got = {r.file_no: r for r in sd.consistent_table(records, {}).collect()}
    assert [got[n].meta_version for n in range(len(rows))] == ["7.3.2", "7.0", '{"build":[1]}', '[7,"x"]', "{}", "true", None]
    assert got[0].namespaces == ["x", '{"y":1}'] and got[0].technique_ids == ["T1", "T2", '{"n":3}']
