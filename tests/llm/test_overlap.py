import random
import re

from siltstone.llm import overlap

MEMBER = "struct<sha256:string,code_region_sha256:string,split:string>"
SCHEMA = f"pair_id string, source string, split string, clean {MEMBER}, payload_text string, cls string, sh string, side string"


def row(pair, split, text=None, file=None, code=None):
    return pair, "s", split, (file, code, split), text, "x", "y", "z"


def sets(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def brute(values):
    found = set()
    for a in values:
        for b in values:
            if a[1:3] and a[2] == "train" and b[2] in ("test", "calibration") and a[0] != b[0]:
                x, y = sets(a[4]), sets(b[4])
                if x and y and 2 * len(x & y) >= len(x | y):
                    found.add(tuple(sorted((a[0], b[0]))))
    return found


def pairs(df):
    got = [tuple(r) for r in overlap.overlaps(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_texts(rows):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    values = []
    for i in range(160):
        if values and rng.random() < 0.6:
            words = rng.choice(values)[4].split()
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))]
        values.append(row(f"P{i % 140:03}", rng.choice(["train", "train", "test", "calibration"]), " ".join(words)))
    want = brute(values)
    assert len(want) > 20
    assert pairs(rows(SCHEMA, *values)) == want


def test_exact_half_counts(rows):
    # 3 of 6 shingles shared
    a, b = "a b c d e f x1 x2", "a b c d e f"
    assert pairs(rows(SCHEMA, row("1", "train", a), row("2", "test", b))) == {("1", "2")}
    c = "a b c d e y1 y2 y3"
    assert pairs(rows(SCHEMA, row("1", "train", a), row("2", "test", c))) == brute([row("1", "train", a), row("2", "test", c)])


def test_hashes_and_odd_rows(rows):
    h, g = "ab" * 32, "cd" * 32
    values = [
        row("1", " Train ", file=f" SHA256:{h.upper()}\n"), row("2", "TEST", file=h), row("3", "test", code=h), row("4", "other", file=h), row("5", None, file=h), row(None, "test", file=h),
        row("6", "train", file="0" * 64), row("7", "test", file="0" * 64), row("8", "train", code="e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
        row("9", "test", code="e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), row("10", "train", file="xyz"), row("11", "test", file="xyz"),
        row("12", "calibration", code=g), row("13", "train", code=g), row("13", "test", code=g), row("1", " Train ", file=h), row("14", "train", ""), row("15", "test", ""), row("16", "train", "two words"), row("17", "test", "two words"),
    ]
    assert pairs(rows(SCHEMA, *values)) == {("1", "2"), ("12", "13")}


def test_long_and_same(rows):
    long = " ".join(f"t{i}" for i in range(30_000))
    assert pairs(rows(SCHEMA, row("1", "train", long), row("2", "test", long.upper()), row("1", "test", long))) == {("1", "2")}


def test_empty(rows):
    assert pairs(rows(SCHEMA)) == set()
    assert overlap.overlap_report(rows(SCHEMA)).count() == 0


def test_report(rows):
    h = "ab" * 32
    got = overlap.overlap_report(rows(SCHEMA, row("1", "train", file=h), row("2", "test", "a b c d", file=h), row("3", "train", "a b c d"), row("4", "test"), row("1", "test", file=h))).collect()
    assert [tuple(r) for r in got] == [("test", "s", 3, 1, 1, 0, 1)]


def test_classes_say_what_pairs_say(rows):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(25)]
    values = [row(f"p{i}", rng.choice(["train", "test", "calibration"]), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 7)))) for i in range(120)]
    table = rows(SCHEMA, *values, *values[:20])
    members = overlap.class_members(table).collect()
    links = {(r.cls_e, r.cls_t): (r.e_pairs, r.t_pairs) for r in overlap.class_links(table).collect()}
    by = {}
    for r in members:
        by.setdefault((r.cls, "t" if r.split == "train" else "e"), set()).add(r.pair_id)
    expanded = {tuple(sorted((a, b))) for e, t in links for a in by[e, "e"] for b in by[t, "t"] if a != b}
    assert expanded == brute(values)
    assert all(n == (len(by[e, "e"]), len(by[t, "t"])) for (e, t), n in links.items())
    for r in members:
        own = "t" if r.split == "train" else "e"
        assert r.links == sum((t if own == "t" else e) == r.cls for e, t in links)


def test_hot_shingles_are_dealt_on_either_side(rows, monkeypatch):
    monkeypatch.setattr(overlap, "PART_PAIRS", 50)
    index = rows("sh long, cls_e long", *[(1, i) for i in range(6000)], (2, 1), (3, 1))
    probe = rows("sh long, cls_t long", (1, 7), (2, 5), *[(3, i) for i in range(20)])
    a, b = overlap._dealt(index, probe, rows("sh long", (1,), (2,)), 10)
    met = a.join(b, ["sh", "_part"])
    assert met.count() == 6000 + 1 + 20 and met.select("sh", "cls_e", "cls_t").distinct().count() == 6021
    assert met.filter("sh = 1").select("_part").distinct().count() > 50
