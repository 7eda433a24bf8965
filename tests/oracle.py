"""Rows of a query beside the rows of its SQL."""

from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def _rows(frame):
    columns = sorted(frame.columns)
    text = lambda x: "NULL" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x)
    return columns, Counter(tuple(map(text, r)) for r in frame[columns].astype(object).itertuples(index=False))


def compare(spark, query, sql, data=DATA):
    base = duckdb.connect()
    for file in data.glob("*.parquet"):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got, want = _rows(query(spark, str(data)).toPandas()), _rows(base.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
