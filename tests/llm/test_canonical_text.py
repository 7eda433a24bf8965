import itertools
import pickle
import random
import unicodedata

import pytest

from siltstone.llm import canonical_text as ct

PAIRS = [("а", "a"), ("е", "e"), ("ο", "o"), ("і", "i")]
STRINGS = "string_id long, artifact_sha256 string, raw_string string, canonical string, form string"


def brute(text):
    drop = dict.fromkeys(map(ord, ct.INVISIBLE))
    text = unicodedata.normalize("NFKD", text.translate(drop)).translate(drop)
    text = "".join(" " if unicodedata.category(c) == "Zs" else c for c in text).translate({ord(a): b for a, b in PAIRS})
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", text))


def test_against_brute_force():
    t, rng = pickle.loads(pickle.dumps(ct.Transducer(PAIRS))), random.Random(1)
    some = "ab аеοі̧́̈​‍­﻿ 　ａｂﬁéёṩ각각Å…\U0001f469中ßİͅ´ệй\t\n"
    for _ in range(20_000):
        text = "".join(rng.choice(some) for _ in range(rng.randrange(12)))
        assert t(text) == brute(text), ascii(text)
    for point in range(0x20, 0x30000, 3):
        if not 0xD800 <= point < 0xE000:
            for text in (chr(point), f"a{chr(point)}́"):
                assert t(text) == brute(text), hex(point)


def test_idempotent_and_kept():
    t = ct.Transducer(PAIRS)
    assert t("Case É stays, so do accents") == "Case É stays, so do accents"
    assert t(t("а́​")) == t("а́​") == "á"
    assert t("\U0001f469‍\U0001f4bb") == "\U0001f469\U0001f4bb"


def test_conflicts_and_chains():
    with pytest.raises(ct.Conflict):
        ct.Transducer([("а", "a"), ("а", "b")])
    with pytest.raises(ct.Conflict):
        ct.Transducer([("а", "е"), ("е", "а")])
    assert ct.Transducer([("а", "е"), ("е", "e")])("а") == "e"
    assert ct.Transducer([("й", "u")])("йи") == "uи"  # longest match over the cluster
    assert ct.Transducer([("l", "1")])("aĺ") == "a1́"


def test_pairs(rows):
    a, b = "s1", "s2"
    values = [
        (1, a, "pass", "", ""), (2, a, "pаss", "", ""), (3, a, "pаss", "", ""), (4, a, "pass", "", ""), (5, b, "pass", "", ""), (6, a, "Pass", "", ""), (7, a, "", "", ""), (8, a, "​", "", ""), (9, a, None, "", ""),
        (10, None, "pass", "", ""), (11, a, "pa­ss", "", ""), (None, a, "pａss", "", ""), (12, b, "x y", "", ""), (13, b, "x　y", "", ""), (14, a, "é" * 100_000, "", ""), (15, a, "é" * 100_000, "", ""),
    ]
    table = rows(STRINGS, *values)
    confusable = rows("glyph string, ascii_char string, form int", *[(g, c, 1) for g, c in PAIRS], (None, "a", 1), ("а", "a", 1))
    want = set()
    for x, y in itertools.combinations([v for v in values if v[0] is not None and v[1] and v[2] is not None], 2):
        if x[1] == y[1] and x[2] != y[2] and brute(x[2]) == brute(y[2]):
            want.add((min(x[0], y[0]), max(x[0], y[0])))
    got = [tuple(r) for r in ct.lookalikes(table, confusable).collect()]
    assert set(got) == want and len(got) == len(want)
    assert ct.lookalikes(rows(STRINGS), confusable).count() == 0
    assert ct.canonical_strings(table, confusable).count() == len(values)
    doubled = ct.lookalikes(table.unionByName(table), confusable)
    assert {tuple(r) for r in doubled.collect()} == want


def test_members_count_what_pairs_list(rows):
    values = [(1, "s", "pass", "", ""), (2, "s", "pаss", "", ""), (3, "s", "pаss", "", ""), (4, "s", "pass", "", ""), (5, "t", "pass", "", ""), (6, "s", "other", "", ""), (7, "s", None, "", ""), (8, None, "pass", "", "")]
    table = rows(STRINGS, *values)
    confusable = rows("glyph string, ascii_char string, form int", *[(g, c, 1) for g, c in PAIRS])
    got = {r.string_id: r for r in ct.form_members(table, confusable).collect()}
    pairs = [tuple(r) for r in ct.lookalikes(table, confusable).collect()]
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert {i: r.links for i, r in got.items()} == {i: sum(i in p for p in pairs) for i in got}
    assert got[1].form == got[2].form != got[5].form and got[2].said == got[3].said
    assert ct.form_members(rows(STRINGS), confusable).count() == 0


@pytest.mark.parametrize("pair", [("​", "a"), ("　", "a"), ("ａ", "b")])
def test_rules_must_not_contradict_each_other(pair):
    with pytest.raises(ct.Conflict):
        ct.Transducer([pair])
