import random

import numpy as np

from siltstone.llm import subjects

DOCS, LABELS, AREAS = "doc_id long, text string, label string, share double", "doc_id long, subject string, annotator string, posterior double", "subject string, seed_terms array<string>, label int"
TERMS = {s: [f"{s}{w}" for w in ("ford", "mint", "lask", "pern", "dool", "vask", "charge")] for s in ("law", "sport", "health", "energy")}
FRAMES = ["The {} was checked against the {} before noon.", "What happened to the {}? Nobody at the {} could say.", "In short: {}, {}.", "Ohne {} gibt es auch kein Wort von {}."]


def corpus(n, rng):
    docs, truth = [], {}
    for i in range(n):
        chosen = rng.sample(sorted(TERMS), rng.choice([1, 1, 2, 3]))
        lines = [s for s in chosen for _ in range(12 // len(chosen))]
        passing = rng.choice(sorted(TERMS))
        text = [rng.choice(FRAMES).format(rng.choice(TERMS[s]), rng.choice(TERMS[s])) for s in [*lines, passing]]
        rng.shuffle(text)
        docs.append((i, rng.choice([" ", "\n"]).join(text), "x", 0.5))
        truth[i] = set(chosen)
    return docs, truth


def test_held_out_accuracy(rows):
    rng = random.Random(8)
    docs, truth = corpus(400, rng)
    labels = [(i, rng.choice(sorted(truth[i])) if rng.random() < 0.95 else "sport", rng.choice([None, "a"]), 0.1) for i in range(0, 400, 8)]
    odd = [(1000, None, "x", 0.5), (1001, "", "x", 0.5), (1002, " \n", "x", 0.5), (1003, "12 345 6789 " * 40, "x", 0.5), (1004, "=" * 200, "x", 0.5), (1005, "<|endoftext|> [PAD]", "x", 0.5), (1006, docs[3][1] * 300, "x", 0.5)]
    areas = rows(AREAS, *[(s, [t[0]], 1) for s, t in TERMS.items()], (None, ["x"], 1))
    labelled = rows(LABELS, *labels, *labels[:5], (77777, "law", "a", 0.1), (3, "unknown", "a", 0.1), (None, "law", "a", 0.1), (4, None, "a", 0.1))
    got = {}
    for r in subjects.found(subjects.posteriors(rows(DOCS, *docs, *odd), labelled, areas)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i % 8]
    right = sum(len(got.get(i, set()) & truth[i]) for i in held)
    assert right / sum(len(truth[i]) for i in held) > 0.95
    assert right / sum(len(got.get(i, set())) for i in held) > 0.95
    assert not set(got) & {1000, 1001, 1002, 1003, 1004, 1005}
    assert got[1006] == got[3]


def test_empty_tables(rows):
    areas = rows(AREAS, ("law", ["court"], 1))
    assert subjects.posteriors(rows(DOCS), rows(LABELS), areas).count() == 0
    assert subjects.posteriors(rows(DOCS, (1, "a court", "x", 0.1)), rows(LABELS), rows(AREAS)).count() == 0
    assert subjects.posteriors(rows(DOCS, (1, "the court. a court", "x", 0.1)), rows(LABELS), rows(AREAS, ("law", ["court"], 1), ("art", None, 1))).count() > 0


def test_curves_follow_the_labels():
    rng = np.random.default_rng(2)
    shares = rng.dirichlet(np.full(6, 0.5), 5000)
    for edge in (0.08, 0.2, 0.5):
        label = np.zeros_like(shares)
        for i, x in enumerate(shares):
            there = np.flatnonzero(x > edge)
            if len(there):
                label[i, rng.choice(there) if rng.random() > 0.05 else rng.integers(6)] = 1
        assert all(abs(m - edge) < 0.04 for m, _ in subjects.calibration(shares, label))
        few = [m for m, _ in subjects.calibration(shares[:20], label[:20])]
        assert all(abs(m - subjects.MIDDLE) < 0.12 for m in few)
    assert subjects.calibration(np.zeros((0, 3)), np.zeros((0, 3))) == [(subjects.MIDDLE, subjects.STEEP)] * 3


def test_held_out_labels_do_not_train(rows):
    rng = random.Random(3)
    docs, truth = corpus(60, rng)
    areas = rows(AREAS, *[(s, [t[0]], 1) for s, t in TERMS.items()])
    table = subjects.featurized(rows(DOCS, *docs), rows(LABELS, *[(i, sorted(truth[i])[0], "a", 0.1) for i in truth]), sorted(TERMS))
    held = table.filter("held").count()
    assert 0 < held < 60
    assert subjects._counts(table.filter("held"), len(TERMS), None).sum() == 0 and subjects._counts(table, len(TERMS), None).sum() > 0
    assert areas.count() == len(TERMS)


def test_counts_do_not_depend_on_the_parts(rows):
    docs, truth = corpus(80, random.Random(4))
    labels = rows(LABELS, *[(i, sorted(truth[i])[0], "a", 0.1) for i in truth])
    table = subjects.featurized(rows(DOCS, *docs), labels, sorted(TERMS))
    weights = subjects.complement_weights(subjects._counts(table, len(TERMS), None))
    sent = table.sparkSession.sparkContext.broadcast(weights)
    once, more = (subjects._counts(t, len(TERMS), sent) for t in (table.coalesce(1), table.repartition(7)))
    assert (once == more).all() and once.sum() > 0


def test_neutral_words_have_no_weight():
    counts = np.zeros((subjects.BUCKETS, 3))
    counts[1], counts[2] = [100, 100, 100], [50, 0, 0]
    w = subjects.complement_weights(counts)
    assert abs(w[1]).max() < 0.5 and w[2, 0] > 1 and w[3].tolist() == [0, 0, 0]
