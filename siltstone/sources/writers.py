"""Sinks: parquet, JSON lines with sorted keys, and small Markdown tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a Markdown table may have; it is made on the driver.
MARKDOWN_ROWS = 10_000


def parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One object a row, its top-level keys sorted, nulls written."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    df.select(row.alias("value")).write.mode("errorifexists").text(path)


def markdown(df: DataFrame, order: Sequence[str]) -> str:
    """A report's rows as a Markdown table, in order; larger tables are refused."""
    rows = df.orderBy(*order).limit(MARKDOWN_ROWS + 1).collect()
    if len(rows) > MARKDOWN_ROWS:
        raise ValueError(f"a Markdown table may have at most {MARKDOWN_ROWS} rows")
    cell = lambda x: "N/A" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *[f"| {' | '.join(map(cell, r))} |" for r in rows]]) + "\n"
