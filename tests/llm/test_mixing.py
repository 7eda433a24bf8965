import random

from siltstone.llm import mixing

SIZED, TARGETS = "doc_id long, source string, n_tokens long, repeats int, one int", "source string, target_share double, max_repeats int, budget int"


def mixed(rows, docs, targets, **more):
    table = rows(SIZED, *[(*d, 0, 0) for d in docs]).drop("repeats", "one")
    got, plan = mixing.mix(table, rows(TARGETS, *[(*t, 0) for t in targets]), **more)
    return got.collect(), {r.source: r for r in mixing.share_report(got, plan).collect()}


def test_budgets_and_caps(rows):
    rng = random.Random(3)
    docs = [(i, rng.choice("aaab"), rng.randrange(1, 50)) for i in range(3000)] + [(9000, "c", 7), (9001, None, 9), (9002, "d", 10), (9003, "a", 0)]
    total = sum(d[2] for d in docs)
    got, report = mixed(rows, docs, [(" A", 0.3, 1), ("b ", 0.6, 4), ("c", 0.05, 3), ("none", 0.05, 9)])
    for s in "ab":
        assert abs(report[s].tokens - int(report[s].target_share * total)) <= 25
    assert report["c"].tokens == 21 and report["none"].tokens == 0 and set(report) == {"a", "b", "c", "none"}
    assert all(r.repeats <= {"a": 1, "b": 4, "c": 3}[r.source] for r in got)
    assert sum(r.n_tokens * r.repeats for r in got) == sum(r.tokens for r in report.values())
    b = {r.repeats for r in got if r.source == "b"}
    assert max(b) - min(b) <= 1


def test_seed_ties_and_empty(rows):
    docs = [(1, "a", 5)] * 10
    got, report = mixed(rows, docs, [("a", 0.5, 1)])
    assert report["a"].tokens == 25 and len(got) == 5
    again, _ = mixed(rows, [(i, "a", 1) for i in range(200)], [("a", 0.5, 1)], seed=1)
    other, _ = mixed(rows, [(i, "a", 1) for i in range(200)], [("a", 0.5, 1)], seed=2)
    assert {r.doc_id for r in again} != {r.doc_id for r in other}
    assert mixed(rows, [], [("a", 1.0, 1)])[1]["a"].tokens == 0
    assert mixed(rows, [(1, "a", 1)], [])[0] == []
    assert mixed(rows, [(1, "a", 4)], [("a", 0.5, 1), ("A", 0.5, 2), (None, 1.0, 1), ("b", None, None)])[1]["a"].tokens == 4
