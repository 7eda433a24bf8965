"""Subject areas of documents.

Complement naive Bayes is trained on labelled documents and the areas' seed terms, then refined by
expectation-maximization over all documents: every sentence is shared out among the subjects and a
neutral class, given its words and the subjects of its document, and the shares are the next counts.
A document's share of a subject is the part of its characters in that subject's sentences; each subject's
posterior is a logistic curve of that share, calibrated on labelled documents that the model was not trained on.

Words and word pairs are hashed into BUCKETS features, so the model has a fixed size whatever the corpus;
counts are whole numbers, so their sums do not depend on how the corpus is parted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import small_enough, stored

#: Features; words have the first half, word pairs the second.
BUCKETS = 1 << 18
ROUNDS = 3
#: Score of the neutral class, pseudo-counts of a seed term and of a feature, and the bound of a feature's weight.
NEUTRAL, SEED_COUNT, SMOOTHING, BOUND = 2.5, 5.0, 0.3, 4.0
#: Sentences a document's label and its uniform prior are worth.
LABEL_WORTH, PRIOR_WORTH = 0.3, 0.1
#: A label without annotator counts half.
UNSIGNED = 0.5
#: One labelled document of so many is held out of training, for calibration, and so many of these are looked at.
HELD_OUT, CALIBRATED_ON = 5, 50_000
#: Where calibration starts, how steep a curve may be, the share of labels that are wrong, and the labels that the
#: starting point is worth, for all subjects and for each.
MIDDLE, STEEP, STEEPEST, WRONG, COMMON_WORTH, OWN_WORTH = 0.2, 40.0, 80.0, 0.1, 20.0, 50.0
#: A label whose subject has less of the text than this is wrong wherever the curve lies.
TRACE = 0.02
#: The most areas a model may have.
MOST_AREAS = 256
#: A count of one, as a whole number.
UNIT = 1 << 20
#: Words whose hashes a worker remembers.
MEMORY = 1 << 18

_SENTENCE = regex.compile(r"[\r\n]+|(?<!\b\p{L})[.!?]+[\"')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*")


class _Hashes(dict):
    """32-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return found


_hashes = _Hashes()


def featurize(sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, terms): the number of features of each sentence, and the features, one sentence after another: the
    distinct hashed words and pairs of neighbouring words, in order."""
    said, sizes = [], []
    for sentence in sentences:
        words = [_hashes[w] for w in _WORD.findall(sentence.lower())]
        said += words
        sizes.append(len(words))
    half = BUCKETS // 2
    h, owner = np.array(said, np.uint64), np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    together = owner[:-1] == owner[1:]
    keys = np.concatenate([owner * BUCKETS + (h % np.uint64(half)).astype(np.int64), (owner[:-1] * BUCKETS + half + (mixed % np.uint64(half)).astype(np.int64))[together]])
    keys.sort()
    keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
    return np.bincount(keys // BUCKETS, minlength=len(sizes)), (keys % BUCKETS).astype(np.int32)


def features(text: str) -> list[int]:
    """The features of one sentence."""
    return featurize([text])[1].tolist()


def area_name(column: str) -> Column:
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def subjects_of(areas: DataFrame) -> list[tuple[str, list[str]]]:
    """(subject, seed terms) in order of name; the table of areas has a bounded size, which is checked."""
    rows = areas.filter(F.col("subject").isNotNull()).groupBy("subject").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("seed_terms", F.array().cast("array<string>")))))).alias("t")).limit(MOST_AREAS + 1).collect()
    if len(rows) > MOST_AREAS:
        raise ValueError(f"at most {MOST_AREAS} subject areas")
    return sorted((r[0], [t for t in r[1] if t]) for r in rows)


def featurized(documents: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, chars, sizes, terms, label, held): of every document that has a sentence, the characters and the number
    of features of each sentence, the features one after another (all packed 32-bit numbers), the weight of each label,
    and whether these are held out of training; written, as every round reads it."""
    number = {n.strip().lower(): i for i, n in enumerate(names)}
    known = labels.select("doc_id", area_name("subject").alias("subject"), F.when(F.trim("annotator") != "", 1.0).otherwise(UNSIGNED).alias("w")).filter(F.col("subject").isin(*number) & F.col("doc_id").isNotNull())
    by_subject = known.groupBy("doc_id", "subject").agg(F.max("w").alias("w"))
    by_document = by_subject.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("subject", "w"))).alias("label"))
    by_document = stored(by_document, "document-labels")
    if small_enough(by_document.count(), 64):
        by_document = F.broadcast(by_document)
    texts = documents.select("doc_id", "text").filter(F.length("text") > 0).join(by_document, "doc_id", "left")
    texts = texts.select("doc_id", "text", F.array(*[F.coalesce(F.try_element_at("label", F.lit(n)), F.lit(0.0)).cast("float") for n in number]).alias("label"), (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held"))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keep, many, sentences = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    found = [s for x in _SENTENCE.split(text) if (s := x.strip())]
                    if found:
                        keep.append(i)
                        many.append(len(found))
                        sentences += found
                sizes, terms = featurize(sentences)
                by_document = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
                rows = pa.array(keep, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(rows), _packed(by_document, np.array([len(x) for x in sentences], np.int32)), _packed(by_document, sizes),
                        _packed(np.concatenate([[0], np.cumsum(sizes)])[by_document], terms), part.column("label").take(rows), part.column("held").take(rows),
                    ],
                    names=["doc_id", "chars", "sizes", "terms", "label", "held"],
                )

    return stored(texts.mapInArrow(stage, f"doc_id {kind}, chars binary, sizes binary, terms binary, label array<float>, held boolean"), "document-features")


def _packed(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """Numbers of each document as bytes: one value to pass on, not one for each number."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(values.astype(np.int32))])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(how many numbers each document has, the numbers)."""
    _, ends, values = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    numbers = np.frombuffer(values, np.int32, (ends[-1] - ends[0]) // 4, ends[0]) if len(column) and values is not None else np.zeros(0, np.int32)
    return np.diff(ends) // 4, numbers


class _Batch:
    """The arrays of some documents: sentence and document of every feature, labels by document. Held-out labels are
    not seen, nor are any where labelled is false."""

    def __init__(self, batch: pa.RecordBatch, areas: int, labelled: bool = True):
        self.documents = batch.num_rows
        (_, self.terms), (sentences, sizes), (_, self.chars) = (_unpacked(batch.column(c)) for c in ("terms", "sizes", "chars"))
        self.owner = np.repeat(np.arange(batch.num_rows), sentences)
        self.sentence = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.some = sizes > 0
        self.starts = (np.cumsum(sizes) - sizes)[self.some]
        label = np.asarray(batch.column("label").flatten()).reshape(batch.num_rows, areas).astype(np.float32)
        self.label = np.where(np.asarray(batch.column("held").to_numpy(zero_copy_only=False), bool)[:, None], 0, label) if labelled else np.zeros_like(label)
        self.firsts = np.flatnonzero(np.r_[True, self.owner[1:] != self.owner[:-1]]) if len(self.owner) else np.zeros(0, int)
        self.areas = areas

    def by_document(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.firsts, axis=0)  # every document has a sentence

    def posteriors(self, weights: np.ndarray) -> np.ndarray:
        """Of each sentence, the share of every area; what is left is the neutral class."""
        score = np.zeros((len(self.owner), self.areas), np.float32)
        if len(self.starts):
            score[self.some] = np.add.reduceat(weights[self.terms], self.starts, axis=0)
        likely = np.exp(score - score.max(1, keepdims=True)) if self.areas else score
        neutral = np.exp(NEUTRAL - score.max(1)) if self.areas else np.ones(len(score))
        prior = np.full((self.documents, self.areas), 1 / max(self.areas, 1), np.float32)
        for _ in range(4):
            z = likely * (prior * self.areas)[self.owner]
            share = z / (z.sum(1) + neutral)[:, None]
            mass = self.by_document(share) + LABEL_WORTH * self.label + PRIOR_WORTH
            prior = mass / mass.sum(1, keepdims=True)
        return share

    def shares(self, weights: np.ndarray) -> np.ndarray:
        """Of each document, the part of its characters that each area has."""
        mass = self.by_document(self.posteriors(weights) * self.chars[:, None].astype(np.float64))
        return mass / np.maximum(self.by_document(self.chars), 1)[:, None]


def _parts(batch: pa.RecordBatch, size: int = 128) -> Iterator[pa.RecordBatch]:
    """Slices whose arrays stay in a core's own cache."""
    for at in range(0, batch.num_rows, size):
        yield batch.slice(at, size)


class _Counts:
    """Sparse counts: a row of values for each feature that a task meets."""

    def __init__(self, areas: int):
        self.place = np.full(BUCKETS, -1, np.int32)
        self.terms, self.values, self.met = np.zeros(1 << 12, np.int32), np.zeros((1 << 12, areas), np.int64), 0

    def add(self, batch: _Batch, share: np.ndarray) -> None:
        packed = (batch.terms.astype(np.int64) << 32) | batch.sentence
        packed.sort()
        terms = packed >> 32
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        if not len(starts):
            return
        terms = terms[starts]
        sums = np.add.reduceat(np.rint(share * UNIT).astype(np.int64)[packed & 0xFFFFFFFF], starts, axis=0)
        new = terms[self.place[terms] < 0]
        if self.met + len(new) > len(self.terms):
            room = max(self.met + len(new) - len(self.terms), len(self.terms))
            self.terms, self.values = np.pad(self.terms, (0, room)), np.pad(self.values, ((0, room), (0, 0)))
        self.place[new] = np.arange(self.met, self.met + len(new))
        self.terms[self.met : self.met + len(new)] = new
        self.met += len(new)
        self.values[self.place[terms]] += sums

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[: self.met], self.values[: self.met]


def _counts(table: DataFrame, areas: int, weights) -> np.ndarray:
    """Expected counts, BUCKETS x areas: by the labels where weights is None, else by the posteriors under them."""
    names = [f"c{k}" for k in range(areas)]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(areas)
        for batch in batches:
            for part in _parts(batch):
                b = _Batch(part, areas)
                share = b.posteriors(weights.value) if weights is not None else (b.label / np.maximum(b.label.sum(1, keepdims=True), 1e-9))[b.owner]
                counts.add(b, share)
        terms, values = counts.total()
        some = values.any(1)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some]), *[pa.array(values[some, k]) for k in range(areas)]], names=["bucket", *names])

    used = table if weights is not None else table.filter(F.exists("label", lambda x: x > 0) & ~F.col("held"))
    sums = used.mapInArrow(stage, f"bucket int, {', '.join(f'{n} long' for n in names)}").groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    rows = sums.toArrow()  # at most BUCKETS rows
    counts = np.zeros((BUCKETS, areas))
    at = rows.column("bucket").to_numpy()
    for k, n in enumerate(names):
        counts[at, k] = rows.column(n).to_numpy() / UNIT
    return counts


def complement_weights(counts: np.ndarray) -> np.ndarray:
    """Complement naive Bayes: how much rarer a feature is outside an area than on average over the areas."""
    total = counts.sum(0)
    outside, size = counts.sum(1, keepdims=True) - counts, np.maximum(total.sum() - total, 1e-9)
    weights = np.log(size) - np.log(outside + SMOOTHING * size / size.mean())
    weights -= weights.mean(1, keepdims=True)
    weights[counts.sum(1) == 0] = 0
    return np.clip(weights, -BOUND, BOUND).astype(np.float32)


def _with_seeds(counts: np.ndarray, areas: list[tuple[str, list[str]]]) -> np.ndarray:
    for k, (_, terms) in enumerate(areas):
        for term in terms:
            counts[features(term), k] += SEED_COUNT
    return counts


def train(table: DataFrame, areas: list[tuple[str, list[str]]], rounds: int = ROUNDS) -> np.ndarray:
    """The weights after `rounds` rounds of expectation-maximization over all documents."""
    context = table.sparkSession.sparkContext
    weights = complement_weights(_with_seeds(_counts(table, len(areas), None), areas))
    for _ in range(rounds):
        sent = context.broadcast(weights)
        weights = complement_weights(_with_seeds(_counts(table, len(areas), sent), areas))
        sent.destroy()
    return weights


def _shares(table: DataFrame, areas: int, weights) -> DataFrame:
    """(doc_id, shares, label, held): every document judged by its text alone, without its labels."""
    kind = table.schema["doc_id"].dataType.simpleString()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                share = _Batch(part, areas, labelled=False).shares(weights.value)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(share.ravel()), areas).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows, part.column("label"), part.column("held")], names=["doc_id", "shares", "label", "held"])

    return table.mapInArrow(stage, f"doc_id {kind}, shares array<double>, label array<float>, held boolean")


def _named(q: np.ndarray, whole: np.ndarray, areas: int) -> np.ndarray:
    """How likely a label is: it names one of the subjects that are there, each alike, or, WRONG of the time, any."""
    return (1 - WRONG) * q / np.maximum(whole, 1e-9) + WRONG / areas


def calibration(shares: np.ndarray, label: np.ndarray) -> list[tuple[float, float]]:
    """(middle, steepness) of every area's logistic curve, fitted to labelled documents that training has not seen.

    A document rarely carries all its labels, so what has no label is not taken for a negative: a label is the choice
    of one of the subjects present, and the curves say how likely each is present. The likelihood of the labels given
    is maximized, for one middle and steepness first, then for each area's own middle. Few labels leave both near
    where they start (COMMON_WORTH, OWN_WORTH); many move them wherever they point. Labels of which the text has
    next to nothing (TRACE) say nothing about the curve.
    """
    areas = shares.shape[1]
    middles = np.round(np.arange(0.02, 0.981, 0.01), 2)
    curve = lambda x, m, b: 1 / (1 + np.exp(-np.clip(b * (x - m), -30, 30))) + 1e-9
    label = np.where(shares > TRACE, label, 0)
    keep = label.any(1) if len(label) else np.zeros(0, bool)
    shares, label = shares[keep], label[keep]

    def fit(m, b):
        q = curve(shares, m, b)
        return float((np.log(_named(q, q.sum(1, keepdims=True), areas)) * label).sum()) - 10 * COMMON_WORTH * (m - MIDDLE) ** 2 - COMMON_WORTH * np.log(b / STEEP) ** 2

    middle, steep = MIDDLE, STEEP
    for _ in range(2):
        middle = float(max(middles, key=lambda m: fit(m, steep)))
        steep = float(max((STEEP / 4, STEEP / 2, STEEP, STEEPEST), key=lambda b: fit(middle, b)))
    found = np.full(areas, middle)
    q = curve(shares, middle, steep)
    for k in range(areas):
        others = q.sum(1) - q[:, k]
        rest = label.copy()
        rest[:, k] = 0
        some = (shares[:, k] > 0.01) | (label[:, k] > 0)  # elsewhere the curve is flat
        x, mine, left, given = shares[some, k], label[some, k], q[some], rest[some]

        def own(m):
            now = curve(x, m, steep)
            whole = others[some] + now
            fit = (np.log(_named(now, whole, areas)) * mine).sum() + (np.log(_named(left, whole[:, None], areas)) * given).sum()
            return float(fit) - 10 * OWN_WORTH * (m - middle) ** 2

        found[k] = max(middles[np.abs(middles - middle) <= 0.3], key=own)
        q[:, k] = curve(shares[:, k], found[k], steep)
    return [(float(m), steep) for m in found]


def posteriors(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, share, posterior): of every document and each area it has some text of.

    Null, empty and blank texts have no rows, nor do texts without prose reach a posterior worth the name.
    Labels that name no area or no document don't count, repeated ones count once, unsigned ones half, and
    wrong ones are outweighed by the text. Repeated rows are judged as they come; an empty table gives an
    empty one, and without areas there are no subjects.
    """
    known = subjects_of(areas)
    spark = documents.sparkSession
    if not known:
        return documents.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("share"), F.lit(0.0).alias("posterior")).limit(0)
    names = [n for n, _ in known]
    table = featurized(documents, labels, names)
    weights = spark.sparkContext.broadcast(train(table, known))
    shares = stored(_shares(table, len(names), weights), "subject-shares")
    sample = shares.filter(F.col("held") & F.exists("label", lambda x: x > 0)).orderBy(F.xxhash64("doc_id")).limit(CALIBRATED_ON).select("shares", "label").toArrow()
    flat = lambda c: np.asarray(sample.column(c).combine_chunks().flatten()).reshape(-1, len(names))
    curves = calibration(flat("shares"), flat("label"))
    per = F.array(*[F.struct(F.lit(n).alias("subject"), F.lit(m).alias("middle"), F.lit(s).alias("steep")) for n, (m, s) in zip(names, curves)])
    each = shares.select("doc_id", F.explode(F.arrays_zip(per.alias("area"), "shares")).alias("x")).select("doc_id", "x.area.*", F.col("x.shares").alias("share")).filter("share > 0.01")
    return each.select("doc_id", "subject", "share", (1 / (1 + F.exp(-F.col("steep") * (F.col("share") - F.col("middle"))))).alias("posterior"))


def found(judged: DataFrame) -> DataFrame:
    """(doc_id, subject) with a posterior of one half or more."""
    return judged.filter(F.col("posterior") >= 0.5).select("doc_id", "subject")


def composition(judged: DataFrame, documents: DataFrame) -> DataFrame:
    """The corpus by subject: documents that deal with it, and the characters their shares come to."""
    dealt = judged.filter(F.col("posterior") >= 0.5).join(documents.select("doc_id", F.length("text").alias("_chars")), "doc_id")
    return dealt.groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.sum(F.col("share") * F.col("_chars"))).cast("long").alias("chars"))
