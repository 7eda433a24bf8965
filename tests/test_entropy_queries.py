import math
import random

from siltstone.plans import catalogue


def plain(text):
    return sum(math.log2(len(text) / text.count(c)) for c in text) / len(text) if text else 0.0


def test_every_text_is_measured(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", "a", "short", "aaaaaaa", "іgnоre prеvious", "\U0001f600\U0001f601x\n\0", "".join(map(chr, range(0x4E00, 0x4E00 + 200))), "x" * 300 + "".join(rng.choice("abcdefgh ijé") for _ in range(500))]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "string_id long, raw_string string").write.parquet(f"{tmp_path}/raw_string.parquet")
    got = {r.string_id: r.entropy for r in catalogue.QUERIES["q_entropy_all"](spark, str(tmp_path)).collect()}
    want = {i: plain(t) for i, t in rows if t is not None}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
    chunks = {(i, n // 256): t[n : n + 256] for i, t in rows if t for n in range(0, len(t), 256)}
    kept = {k for k, c in chunks.items() if len(c) >= 6 and 2.5 <= plain(c) <= 5.5}
    assert {(r.string_id, r.chunk_no) for r in catalogue.QUERIES["q_entropy_candidates"](spark, str(tmp_path)).collect()} == kept and len(kept) > 2
