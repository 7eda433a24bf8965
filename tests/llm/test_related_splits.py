import random
from collections import defaultdict

from siltstone.llm import related_splits as rs

SCHEMA = "pair_id string, malware_family string, payload_family string, split string, clean struct<split:string>, injected struct<split:string>, bits string, root int"
ALIAS = "alias_name string, canonical_name string, node int"


def row(pair, mal=None, pay=None, split="train", clean=None, injected=None):
    return pair, mal, pay, split, (clean,), (injected,), "x", 1


def brute(values, aliases):
    name = lambda x: "".join(c for c in (x or "").lower() if c not in " -_\t\n")
    alias = {name(a): name(b) for a, b in aliases}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, v in enumerate(values):
        keys = [("p", v[0])] if v[0] and v[0].strip() else []
        keys += [("m", alias.get(name(v[1]), name(v[1])))] if name(v[1]) else []
        keys += [("f", name(v[2]))] if name(v[2]) else []
        for k in keys:
            parent[find(("r", i))] = find(k)
    splits, members = defaultdict(set), defaultdict(set)
    for i, v in enumerate(values):
        g = find(("r", i))
        splits[g] |= {s.strip().lower() for s in (v[3], v[4][0], v[5][0]) if s} & {"train", "test", "calibration"}
        members[g].add(v[0])
    return members, {p for g in members if len(splits[g]) > 1 for p in members[g] if p is not None}


def test_random_groups(rows):
    rng = random.Random(11)
    pick = lambda p, n: f"{p}-{rng.randrange(n)}" if rng.random() < 0.5 else rng.choice([None, " ", f" {p.upper()}_{rng.randrange(n)}"])
    values = [row(f"P{rng.randrange(200)}", pick("m", 150), pick("f", 150), rng.choice(["train", "train ", "TEST", "?", None]), rng.choice(["train", None]), "train") for _ in range(260)]
    aliases = [("m1", "m2"), ("M-3", "m 4"), (None, "m5"), ("m6", None)]
    got = rs.torn_pairs(rows(SCHEMA, *values), rows(ALIAS, *[(*a, 1) for a in aliases])).collect()
    members, want = brute(values, [a for a in aliases if None not in a])
    assert {r.pair_id for r in got} == want and len(got) == len(want)
    given = rs.assign(rows(SCHEMA, *values), rows(ALIAS, *[(*a, 1) for a in aliases])).collect()
    split = {r.pair_id: r.split for r in given}
    assert len(given) == len(split) == len({v[0] for v in values})
    assert all(len({split[p] for p in g}) == 1 for g in members.values())


def test_chain_contracts(rows):
    values = [row(f"P{i}", f"m{i // 2}", f"f{(i + 1) // 2}", "test" if i == 59 else "train") for i in range(60)]
    assert rs.torn_pairs(rows(SCHEMA, *values), rows(ALIAS)).count() == 60
    forest, labels = rs.spanning_forest(rs.edges(rs.entities(rows(SCHEMA, *values)), rows(ALIAS)))
    assert labels.select("root").distinct().count() == 1
    assert forest.count() == labels.count() - 1


def test_shares(rows):
    values = [row(f"P{i}", f"m{i % 700}" if i % 3 else "big" if i % 2 else None) for i in range(3000)]
    given = rs.assign(rows(SCHEMA, *values), rows(ALIAS)).groupBy("split").count().collect()
    got = {r["split"]: r["count"] / 3000 for r in given}
    assert all(abs(got[s] - x) < 0.01 for s, x in rs.SHARES.items()), got


def test_null_rows_and_empty_tables(rows):
    null = row(None), row(None, "a", "b", "test"), row("1", "A", None), row("2", None, "B"), row("3")
    assert {r.pair_id for r in rs.torn_pairs(rows(SCHEMA, *null), rows(ALIAS)).collect()} == {"1", "2"}
    assert rs.torn_pairs(rows(SCHEMA), rows(ALIAS)).count() == 0
    assert rs.assign(rows(SCHEMA), rows(ALIAS)).count() == 0
