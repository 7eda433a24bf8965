"""Sources combined to target weights.

Every document gets a hash-random key; within each source documents are range-sorted by it, token counts
are summed up by distributed prefix sums, and the order is cut where the source's exact budget is
reached, after as many whole epochs as the budget asks for and its cap allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tokenizing import _encoder, build_lexicon, encoded, tokenizer_folder
from siltstone.operators.prefix_sums import prefix_sums
from siltstone.runtime import stored

SEED = 20


def source_name(column: str):
    """A source without case and surrounding blanks."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def sized(documents: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document; no tokens for null and empty texts."""
    folder = folder or tokenizer_folder()
    lexicon = build_lexicon(documents, folder)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(folder, lexicon)
        for batch in batches:
            for part, many, _ in encoded(batch, encoder):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(many, pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = documents.select("doc_id", source_name("source").alias("source"), "text")
    return stored(rows.mapInArrow(stage, f"doc_id {kind}, source string, n_tokens long"), "sized-documents")


def _targets(targets: DataFrame) -> DataFrame:
    """One row per source: repeated rows of a target add their shares and take the larger cap."""
    read = targets.select(source_name("source").alias("source"), F.greatest(F.col("target_share"), F.lit(0.0)).alias("share"), F.greatest(F.col("max_repeats"), F.lit(0)).alias("cap"))
    return read.filter(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("cap"), F.lit(0)).alias("max_repeats"))


def plan(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """A row per target: available tokens, budget, whole epochs, and the tokens of the last, partial epoch.

    documents as from sized(). The total aimed at is that of all documents. A source that cannot fill its
    budget within its cap gives all it has, max_repeats times; what it lacks is not given to others.
    """
    if total is None:
        total = documents.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    have = documents.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("documents"))
    wanted = _targets(targets).join(have, "source", "left").na.fill(0, ["available", "documents"])
    budget = F.floor(F.col("target_share") * F.lit(total)).cast("long")
    full = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")
    wanted = wanted.withColumn("budget", budget).withColumn("epochs", F.least(full, F.col("max_repeats")))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0)
    return wanted.withColumn("rest", F.when(F.col("available") > 0, rest).otherwise(0).cast("long"))


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mixed, plan): (doc_id, source, n_tokens, repeats) of every document taken, and the plan.

    The document on the edge of the partial epoch is taken if that comes nearer to the budget; so a source
    misses its budget by at most half a document. Null sources,
    sources that aren't targets and documents without tokens are not taken. Ties of the key are broken by
    doc_id, repeated rows count as documents of their own, an empty table gives an empty mix.
    """
    total, rows = documents.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    steps = stored(plan(documents, targets, total), "mix-plan")
    keyed = documents.filter(F.col("n_tokens") > 0).join(F.broadcast(steps.select("source")) if steps.count() <= 100_000 else steps.select("source"), "source", "left_semi")
    keyed = keyed.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id"))
    summed = prefix_sums(keyed, ["source"], ["_key", "doc_id"], "n_tokens", rows, "_before")
    taken = summed.join(steps.select("source", "epochs", "rest"), "source")
    repeats = F.col("epochs") + F.when(2 * F.col("_before") + F.col("n_tokens") <= 2 * F.col("rest"), 1).otherwise(0)
    mixed = taken.select("doc_id", "source", "n_tokens", repeats.cast("int").alias("repeats"))
    return mixed.filter(F.col("repeats") > 0), steps


def share_report(mixed: DataFrame, steps: DataFrame) -> DataFrame:
    """Per target source: what it should and does contribute; actual_share is its share of the total aimed at,
    mix_share its share of the mix."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("taken"), F.max("repeats").alias("most_repeats"))
    both = steps.join(got, "source", "left").na.fill(0, ["tokens", "taken", "most_repeats"])
    whole = both.agg(F.sum("tokens").alias("_mix"))
    aimed = F.when(F.col("budget") > 0, F.col("tokens") / F.col("budget") * F.col("target_share")).otherwise(F.lit(0.0))
    return both.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "documents", "available", "budget", "tokens", "taken", "most_repeats",
        F.round(aimed, 6).alias("actual_share"), F.round(F.try_divide("tokens", "_mix"), 6).alias("mix_share"),
    )
