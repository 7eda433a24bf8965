from siltstone.plans import catalogue


def test_whole_budget(spark, tmp_path):
    rows = [("a", n, n, f"text {n}") for n in range(2300)] + [("b", n, 5000 + n, f"text {n // 2}") for n in range(300)]
    spark.createDataFrame(rows, "artifact_sha256 string, ord int, string_id long, raw_string string").write.parquet(f"{tmp_path}/raw_string.parquet")
    for name, want in (("q_string_budget_2000", {("a", True): 2000, ("b", False): 300}), ("q_text_budget_2000", {("a", True): 2000, ("b", False): 150})):
        got = catalogue.QUERIES[name](spark, str(tmp_path)).groupBy("artifact_sha256", "truncated").count().collect()
        assert {(r.artifact_sha256, r.truncated): r["count"] for r in got} == want
