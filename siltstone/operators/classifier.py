"""Classifier scores over distinct texts: batching of a model, softmax, labels, flags, and fan-out to every source."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LABELS = ("BENIGN", "INJECTION", "JAILBREAK")
THRESHOLD, MOST_TOKENS, BATCH = 0.75, 512, 16


class LabelError(ValueError):
    """A model's labels aren't those that are known, each at one place."""


def label_places(names: Mapping[object, str]) -> tuple[int, ...]:
    """Where each of LABELS stands in a model's logits. names: label by place, the place a number or its digits, labels
    without case and surrounding blanks; anything but each label once is refused, never guessed."""
    places: dict[str, list[int]] = {n: [] for n in LABELS}
    for place, label in names.items():
        if not isinstance(label, str) or label.strip().upper() not in places or not str(place).isdigit():
            raise LabelError(f"{place!r}: {label!r} is no label")
        places[label.strip().upper()].append(int(place))
    if sorted(p for ps in places.values() for p in ps) != list(range(len(LABELS))) or not all(places.values()):
        raise LabelError(f"the labels are {dict(names)!r}")
    return tuple(p[0] for p in places.values())


class Backend(Protocol):
    """A model: the labels of its logits, and logits and token count of each text."""

    def labels(self) -> Mapping[object, str]: ...

    def run(self, texts: list[str], max_length: int) -> tuple[list[list[float]], list[int]]: ...


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits; null for null, empty or not finite."""
    top = F.array_max(logits)
    grown = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(grown, F.lit(0.0), lambda a, x: a + x)
    fine = (F.size(logits) > 0) & F.forall(logits, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(fine, F.transform(grown, lambda x: x / total))


def scored(predictions: DataFrame, keys: list[str], places: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """keys with p_benign, p_injection, p_jailbreak, label (the first of equal ones), adversarial and truncated.
    places: where each of LABELS stands in the logits, see label_places()."""
    p = predictions.filter(F.size("logits") == len(LABELS)).withColumn("_p", softmax(F.col("logits"))).filter(F.col("_p").isNotNull())
    b, i, j = (F.col("_p")[k] for k in places)
    label = F.when((b >= i) & (b >= j), LABELS[0]).when(i >= j, LABELS[1]).otherwise(LABELS[2])
    return p.select(*keys, b.alias("p_benign"), i.alias("p_injection"), j.alias("p_jailbreak"), label.alias("label"), ((i >= THRESHOLD) | (j >= THRESHOLD)).alias("adversarial"), F.coalesce(F.col("token_count") > MOST_TOKENS, F.lit(False)).alias("truncated"))


def technique(label: Column) -> Column:
    return F.when(label == "JAILBREAK", "AML.T0054").otherwise("AML.T0051.001")


def classify(texts: DataFrame, text: str, factory: Callable[[], Backend]) -> DataFrame:
    """(text, logits, token_count, error) of each distinct text, scored in batches by one model per task.

    A batch that fails has its error and no logits; nothing else is lost.
    """

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for batch in batches:
            values = batch.column(0).to_pylist()
            logits, counts, errors = [], [], []
            for i in range(0, len(values), BATCH):
                part = values[i : i + BATCH]
                try:
                    found, tokens = backend.run(part, MOST_TOKENS)
                    bad = None
                    if len(found) != len(part) or len(tokens) != len(part):
                        raise ValueError("the model returned another number of rows")
                except Exception as error:  # noqa: BLE001
                    found, tokens, bad = [None] * len(part), [None] * len(part), f"{type(error).__name__}: {error}"
                logits += found
                counts += tokens
                errors += [bad] * len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(logits, pa.list_(pa.float64())), pa.array(counts, pa.int32()), pa.array(errors, pa.string())], names=[text, "logits", "token_count", "error"])

    distinct = texts.select(text).filter(F.col(text).isNotNull()).distinct()
    return distinct.mapInArrow(stage, f"`{text}` string, logits array<double>, token_count int, error string")


def fan_out(sources: DataFrame, scores: DataFrame, text: str) -> DataFrame:
    """Scores of distinct texts back on every row that has the text. The join is on a digest and the text."""
    a, b = sources.withColumn("_t", F.xxhash64(text)), scores.withColumn("_t", F.xxhash64(text))
    return a.join(b, ["_t", text]).drop("_t")


def coverage(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state, errored): PARTIAL where a text was cut at the model's length, FAILED where a batch has an error
    (so the detector is errored, not negative), else COMPLETE. scores: as from classify(), with keys."""
    bad, cut = F.max(F.col("error").isNotNull()).alias("errored"), F.max(F.coalesce(F.col("token_count") > MOST_TOKENS, F.lit(False))).alias("_cut")
    rows = scores.groupBy(*keys).agg(bad, cut)
    return rows.select(*keys, F.when(F.col("errored"), "FAILED").when(F.col("_cut"), "PARTIAL").otherwise("COMPLETE").alias("state"), "errored")


def best_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, adversarial) of scored() rows: the greatest probability of an attack, 0 for none."""
    attack = F.max(F.greatest("p_injection", "p_jailbreak"))
    return scores.groupBy(*keys).agg(F.coalesce(attack, F.lit(0.0)).alias("score"), F.max("adversarial").alias("adversarial"))


def promptware(sources: DataFrame, findings: DataFrame, group: str, text: str, provenance: str, target_is_llm: bool = False) -> DataFrame:
    """sources (with adversarial) with promptware: a text that the model flags, and whose target is a language model or
    that a rule has flagged. A text counts as flagged by rules wherever it occurs in its group, if one of the places it
    comes from is the place of a finding.

    findings (group, provenance) are those before any are merged. Places are compared whole, nulls included; texts move
    as digests only.
    """
    place, said = F.md5(F.to_json(F.struct(provenance))), F.md5(text)
    marked = sources.withColumn("_place", place).withColumn("_said", said)
    met = marked.select(group, "_place", "_said").distinct().join(findings.select(group, place.alias("_place")).distinct(), [group, "_place"], "left_semi")
    flagged = met.select(group, "_said").distinct().withColumn("_flagged", F.lit(True))
    context = F.lit(target_is_llm) | F.coalesce("_flagged", F.lit(False))
    return marked.join(flagged, [group, "_said"], "left").withColumn("promptware", F.coalesce("adversarial", F.lit(False)) & context).drop("_place", "_said", "_flagged")
