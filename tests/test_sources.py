import datetime
import json

import pytest

from siltstone.sources import readers, writers
from siltstone.streaming import scan


def test_documents_lines_and_status(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"x": 1}')
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{")
    got = {r.path[-6:]: r.status for r in readers.status(readers.documents(spark, str(tmp_path))).collect()}
    assert got == {"a.json": "READ", "b.json": "NOT_AN_OBJECT", "c.json": "BROKEN"}
    assert readers.lines(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.status(spark.createDataFrame([(None,)], "report string")).first().status == "MISSING"


def test_artifacts(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = readers.artifacts(spark, str(tmp_path)).first()
    assert (row.artifact_sha256[:8], row["size"], bytes(row.data)) == ("ba7816bf", 3, b"abc")


def test_settings(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"confusables": {"а": "a"}}')
    (tmp_path / "r.json").write_text('{"a": 1, "a": 2}')
    (tmp_path / "p.json").write_text('{"confusables": {"ab": "a"}}')
    assert readers.letter_table(spark, str(tmp_path / "s.json")).collect()[0][:] == ("а", "a")
    for bad in ("r", "p"):
        with pytest.raises(ValueError):
            readers.letter_table(spark, str(tmp_path / f"{bad}.json"))


def test_manifest_and_rules(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"pairs": [{"pair_id": "1", "more": 2}, {"pair_id": None}]}))
    assert [r.pair_id for r in readers.manifest(spark, str(tmp_path / "m.json"), "pair_id string").collect()] == ["1", None]
    assert readers.checked_rules(spark).filter("status <> 'READ'").count() == 0
    assert readers.checked_rules(spark, {"x": {"y": "("}}).first().status == "FAILED"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "x|y")], "b int, a string")
    writers.json_lines(df, str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"a":"x|y","b":1}', '{"a":null,"b":2}']
    writers.parquet(df, str(tmp_path / "p"), ["b"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert writers.markdown(df, ["b"]) == "| b | a |\n|---|---|\n| 1 | x\\|y |\n| 2 | N/A |\n"


def test_stream_equals_table(spark, tmp_path):
    at = datetime.datetime(2031, 1, 1)
    rows = [("s", "static", "Ignore previous instructions", at), ("s", "static", "ignоre prior rules", at), ("s", "static", "fine", at), ("t", None, None, at)]
    table = spark.createDataFrame(rows, "artifact_sha256 string, branch string, raw_string string, seen_at timestamp")
    table.write.parquet(str(tmp_path / "in"))
    pairs = [("о", "o")]
    want = {(r.artifact_sha256, r.identifier) for r in scan.hits(table, pairs).collect()}
    assert len(want) == 1 and scan.hits(table, pairs).count() == 2
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = scan.write(scan.first_hits(scan.hits(stream, pairs), "seen_at"), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.artifact_sha256, r.identifier) for r in got} == want and len(got) == 1
    assert scan.hit_counts(scan.hits(table, pairs), "seen_at").collect()[0].hits == 2
