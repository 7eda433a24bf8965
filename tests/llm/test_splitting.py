import random

import pytest

from siltstone.llm import splitting
from siltstone.llm.splitting import Limits, cut

STRINGS, COUNTS = "string_id long, raw_string string, tokens int, piece string", "string_id long, token_count int, tokens int"


def check(text, tokens, limits=Limits()):
    found = cut(text, tokens, limits)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for a, b, t in found:
        assert 0 < b - a <= limits.chars
        assert not tokens or t <= limits.tokens + 1e-6 or b - a == 1
    for (a, b, _), (c, d, _) in zip(found, found[1:]):
        assert a < c <= b < d
    return found


def test_random_texts():
    rng = random.Random(2)
    for _ in range(300):
        alphabet = rng.choice(["ab. ", "abc, \n", "会。x ", "éa ", "\U0001f469‍\U0001f4bb ", "a\r\n"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9000)))
        check(text, rng.choice([None, 1, 513, 5000, 40_000]))


def test_overlap_balance_and_boundaries():
    text = "One sentence here. " * 400
    found = check(text, None)
    assert all(a[1] - b[0] == 200 for a, b in zip(found, found[1:]))
    assert all(text[:b].endswith(". ") for _, b, _ in found[:-1])
    assert len(found) == -(-(len(text) - 200) // 1848)
    assert max(b - a for a, b, _ in found) - min(b - a for a, b, _ in found) < 260
    strong = "word " * 300 + "\n\n" + "word " * 300
    assert strong[: check(strong, None)[0][1]].endswith("\n\n")


def test_tight_limits():
    assert [b - a for a, b, _ in check("abc", 10_000)] == [1, 1, 1]
    assert cut("", 5) == [] and cut("abc", 5) == [(0, 3, 5.0)]
    assert len(check("x" * 2049, None)) == 2 and len(check("x" * 2048, None)) == 1
    assert len(check("y" * 91, 558)) >= 2


def test_dense_stretches_and_least_counts():
    found = check("a" * 3000 + "会" * 300, 4000)
    assert len(found) < 40 and max(b - a for a, b, _ in found) > 100
    assert all(b - c >= 60 for (_, b, _), (c, _, _) in zip(found, found[1:]))
    long = check("word " * 90_000, None)
    assert len(long) == -(-(450_000 - 200) // 1848) or len(long) <= 1.1 * 450_000 / 1848


def test_table(rows):
    strings = rows(STRINGS, (1, "a" * 3000, 9, "x"), (2, "b" * 3000, 9, "x"), (3, "short", 9, "x"), (4, "", 9, "x"), (5, None, 9, "x"), (6, "d" * 3000, 9, "x"), (None, "e" * 3000, 9, "x"), (7, "c c " * 50_000, 9, "x"), (7, "c c " * 50_000, 9, "x"))
    counts = rows(COUNTS, (2, 10, 1), (2, None, 1), (3, 600, 1), (3, 5, 1), (4, 600, 1), (5, 600, 1), (6, 0, 1), (6, -4, 1), (None, 900, 1))
    got = splitting.pieces(strings, counts).collect()
    assert {r.string_id for r in got} == {1, 3, 6, None, 7}
    assert sum(r.string_id == 7 and r.piece_no == 0 for r in got) == 2
    assert splitting.pieces(rows(STRINGS), counts).count() == 0
    assert {r.string_id for r in splitting.pieces(strings, rows(COUNTS)).collect()} == {1, 2, 6, None, 7}


@pytest.mark.parametrize("at", range(1, 8))
def test_marks_stay(at):
    text = "aé̂b\r\nc"
    whole = splitting._whole(text, at)
    assert text[whole : whole + 1] not in ("́", "̂", "\n")
