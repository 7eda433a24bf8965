"""Sources: tables, JSON documents, JSON lines, bytes and manifests as DataFrames, each with what went wrong."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.rules import RULES, jvm_pattern

#: Largest settings file that the driver reads.
SETTINGS_BYTES = 16 << 20


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, report): every file of a folder or pattern as one JSON text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("report"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, report): every line of JSON-lines files."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("report"))


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, artifact_sha256, size, data): files as bytes, named by their digest."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("artifact_sha256"), F.col("length").alias("size"), F.col("content").alias("data"))


def status(documents: DataFrame, column: str = "report") -> DataFrame:
    """documents with status: MISSING, BROKEN, NOT_AN_OBJECT or READ."""
    parsed = F.try_parse_json(column)
    kind = F.schema_of_variant(parsed)
    return documents.withColumn("status", F.when(F.col(column).isNull(), "MISSING").when(parsed.isNull(), "BROKEN").when(kind.startswith("OBJECT"), "READ").otherwise("NOT_AN_OBJECT"))


def settings(spark: SparkSession, path: str) -> tuple[dict, str]:
    """(object, sha256) of a small JSON file; repeated keys and anything but an object are refused."""
    row = spark.read.format("binaryFile").load(path).select("length", F.sha2("content", 256).alias("digest"), "content").first()
    if row is None or row["length"] > SETTINGS_BYTES:
        raise ValueError(f"{path} is missing or larger than {SETTINGS_BYTES} bytes")

    def unique(pairs):
        found = dict(pairs)
        if len(found) != len(pairs):
            raise ValueError(f"{path} repeats a key")
        return found

    found = json.loads(bytes(row["content"]).decode("utf-8"), object_pairs_hook=unique)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found, row["digest"]


def letter_table(spark: SparkSession, path: str, key: str = "confusables") -> DataFrame:
    """(glyph, ascii_char) of a look-alike file; each pair must lead from one character to one printable ASCII one."""
    pairs = settings(spark, path)[0].get(key, {})
    for glyph, letter in pairs.items():
        if len(glyph) != 1 or not isinstance(letter, str) or len(letter) != 1 or not " " <= letter <= "~":
            raise ValueError(f"{glyph!r} to {letter!r} is no pair of characters")
    return spark.createDataFrame(sorted(pairs.items()), "glyph string, ascii_char string")


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The pairs of a manifest file: one object with a list `pairs`."""
    return spark.read.schema(f"pairs array<struct<{schema}>>").json(path, multiLine=True).select(F.explode("pairs").alias("p")).select("p.*")


def checked_rules(spark: SparkSession, rules: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """(rule, identifier, pattern, status): whether each pattern compiles where it will run."""
    compile_: Callable = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    rows = []
    for rule, patterns in (RULES if rules is None else rules).items():
        for name, pattern in patterns.items():
            try:
                compile_(jvm_pattern(pattern))
                rows.append((rule, name, pattern, "READ"))
            except Exception:  # noqa: BLE001
                rows.append((rule, name, pattern, "FAILED"))
    return spark.createDataFrame(rows, "rule string, identifier string, pattern string, status string")
