from siltstone.operators import metrics


def test_attack_modes(spark):
    flags = ("verdict_flipped", "omission", "tool_attempt", "tool_executed", "leak")
    rows = [("a", 4, True, True, True, False, None), ("a", 4, None, False, True, False, True), ("a", 3, True, True, True, True, True), ("a", 2, True, True, False, None, True), ("a", 1, *[True] * 5), ("b", 1, *[True] * 5)]
    outcomes = spark.createDataFrame(rows, f"baseline string, group_no int, {', '.join(f'{f} boolean' for f in flags)}")
    got = {(r.baseline, r.metric): (r.numerator, r.denominator, r.value) for r in metrics.attack_modes(outcomes).collect()}
    assert {m: v for (b, m), v in got.items() if b == "a"} == {"as_verdict": (1, 2, 0.5), "as_omission": (2, 3, 0.666667), "as_tool": (2, 3, 0.666667), "as_tool_executed": (0, 3, 0.0), "as_leak": (2, 3, 0.666667)}
    assert {v for (b, _), v in got.items() if b == "b"} == {(0, 0, None)}
