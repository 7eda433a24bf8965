import os
import random
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import tokenizing as tk

FOLDER = tk.tokenizer_folder()
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/{tk.VOCABULARY}"), reason="no vocabulary here")
DOCS = "doc_id long, text string, source string, word string, n long"


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return lambda texts: [e.ids for e in made.encode_batch(texts, add_special_tokens=False)]


def samples():
    rng = random.Random(4)
    some = list("aehiost  \n\t.,'09-_") + ["é", "会", "\U0001f469", "‍", " the", "'ll", "<|endoftext|>", " ", "́", "\r\n", "x" * 300]
    return ["", " ", "\n\n", "a" * 5000, "=" * 3000, "<|endoftext|>", "It's we'll  they're   x"] + ["".join(rng.choice(some) for _ in range(rng.randrange(60))) for _ in range(600)]


def test_merges_are_exact(public):
    encoder = tk.Encoder(FOLDER)
    texts = samples()
    assert [encoder(t) for t in texts] == public(texts)


def test_lexicon_is_exact_and_minimal(tmp_path):
    rng = random.Random(9)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(900)} | {b"stating", b"skating", "é".encode()})
    entries = [(w, [rng.randrange(50_000) for _ in range(rng.randrange(1, 4))]) for w in words]
    data = tk.Lexicon.compile(entries)
    (tmp_path / "l").write_bytes(data.tobytes())
    lexicon = tk.Lexicon.open(str(tmp_path / "l"))
    assert [lexicon.find(w) for w, _ in entries] == [ids for _, ids in entries]
    known = set(words)
    for w in words:
        for other in (w + b"z", w[:-1], w + b"a"):
            assert (lexicon.find(other) is not None) == (other in known)
    shared = tk.Lexicon.compile([(w, [1]) for w in sorted([b"walking", b"talking", b"stalking"])])
    apart = tk.Lexicon.compile([(w, [1]) for w in sorted([b"walking", b"talkinh", b"stalkink"])])
    assert len(shared) < len(apart)
    assert tk.Lexicon(np.asarray(tk.Lexicon.compile([]))).find(b"a") is None


def test_documents(rows, public):
    texts = samples()
    docs = rows(DOCS, *[(i, t, "s", "w", 1) for i, t in enumerate(texts)], (9000, None, None, None, None), (1, texts[1], "s", "w", 1), (None, "x", "s", "w", 1))
    got = tk.encode(docs, lexicon=tk.build_lexicon(docs, FOLDER, words=40)).collect()
    assert len(got) == len(texts) + 3
    by = {r.doc_id: list(r.ids) for r in got}
    assert [by[i] for i in range(len(texts))] == public(texts)
    assert by[9000] == [] and by[0] == []
    counts = {r.doc_id: r.n_tokens for r in tk.encode(docs, counts_only=True).collect()}
    assert counts == {k: len(v) for k, v in by.items()}
    assert tk.encode(rows(DOCS)).count() == 0


def test_words_are_those_of_the_pattern():
    rng = random.Random(5)
    some = list("abs'dmtlverx  \n\t.,09-_é中  \x1c\x85²Ⅷ́\U0001f600") + ["'ll", "'s", "'re", "n't", "  ", "''"]
    split = tk.regex.compile(tk.WORD_PATTERN).findall
    for _ in range(1500):
        texts = ["".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(6))]
        data, ends, many = tk.words_of(texts)
        raw = data.tobytes()
        words = [w for t in texts for w in split(t)]
        assert [raw[a:b].decode() for a, b in zip([0, *ends.tolist()], ends.tolist())] == words
        assert many.tolist() == [len(split(t)) for t in texts]
        found, n = tk.counted_words(texts)
        assert dict(zip([w.decode() for w in found], n.tolist())) == dict(Counter(words))


def test_known_words_come_from_the_lexicon_alone(monkeypatch):
    ranks = tk.load_ranks(FOLDER)
    words = sorted({w.encode() for w in ["the", " the", " unusualness", "\n", " é", "'s"]})
    encoder = tk.Encoder(FOLDER, tk.Lexicon(tk.Lexicon.compile([(w, tk.merge(w, ranks)) for w in words])))
    want = [tk.Encoder(FOLDER)(t) for t in ("the the\n é", "", "the's unusualness")]
    monkeypatch.setattr(tk, "merge", None)
    many, ids = encoder.encode(["the the\n é", "", "the's unusualness"])
    assert many.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
