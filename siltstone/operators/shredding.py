"""Columnar shredding of nested JSON and reassembly of one flat table per repeated ancestor.

Every leaf path of a layout becomes a column of (repetition level, definition level, value)
triples. A repeated node adds one repetition level and two definition levels: the slot exists,
and the slot holds an object. Slots that hold something else keep their place, so positions in
the flat tables are positions in the original lists. Tables are rebuilt from the level
sequences alone, a batch at a time, and no stage shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.json_text import as_text, entries, parse_object
from siltstone.runtime import stored

#: Documents go through Python in slices of about this many characters.
SLICE_CHARS = 4 << 20

LEVELS = T.StructType([T.StructField("rep", T.ArrayType(T.ByteType())), T.StructField("def", T.ArrayType(T.ByteType())), T.StructField("val", T.ArrayType(T.StringType()))])


@dataclass
class Node:
    """A nested object. repeated: the field holds a list of objects, and a lone object counts as a list
    of one; entry_keys=(key, value): a lone object is instead a list of its entries, in order."""

    name: str
    leaves: tuple[str, ...] = ()
    children: tuple[Node, ...] = ()
    repeated: bool = False
    entry_keys: tuple[str, str] | None = None
    path: str = ""
    rep: int = 0
    def_: int = 0
    first: int = 0
    columns: list[int] = field(default_factory=list)

    def number(self, path: str = "", rep: int = 0, def_: int = 0, names: list[str] | None = None) -> list[str]:
        """Set paths and levels below this node; the leaf paths in column order."""
        names = [] if names is None else names
        self.path = (f"{path}/{self.name}" if path else self.name) + ("[]" if self.repeated else "")
        self.rep, self.def_, self.first = rep + self.repeated, def_ + (2 if self.repeated else 1 if self.name else 0), len(names)
        names += [f"{self.path}/{x}" if self.path else x for x in self.leaves]
        for child in self.children:
            child.number(self.path, self.rep, self.def_, names)
        self.columns = list(range(self.first, len(names)))
        return names

    def find(self, path: str) -> Node:
        if self.path == path:
            return self
        for child in self.children:
            if path == child.path or path.startswith(f"{child.path}/"):
                return child.find(path)
        raise KeyError(path)


def _shred_one(root: Node, document, columns) -> None:
    def absent(node, r, d):
        for c in node.columns:
            rep, def_, val = columns[c]
            rep.append(r)
            def_.append(d)
            val.append(None)

    def present(node, value, r):
        d = node.def_
        for c, leaf in enumerate(node.leaves, node.first):
            rep, def_, val = columns[c]
            text = as_text(value.get(leaf))
            rep.append(r)
            def_.append(d + (text is not None))
            val.append(text)
        for child in node.children:
            below = value.get(child.name)
            if not child.repeated:
                if isinstance(below, dict):
                    present(child, below, r)
                else:
                    absent(child, r, d)
                continue
            if isinstance(below, dict):
                k = child.entry_keys
                below = [{k[0]: key, k[1]: x} for key, x in entries(below)] if k else [below]
            if not isinstance(below, list) or not below:
                absent(child, r, d)
                continue
            at = r
            for item in below:
                if isinstance(item, dict):
                    present(child, item, at)
                else:
                    absent(child, at, d + 1)
                at = child.rep

    if document is None:
        absent(root, 0, -1)
    else:
        present(root, document, 0)


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = [len(x) if x is not None else 0 for x in batch.column(text).to_pylist()]
    start = room = 0
    for i, n in enumerate(sizes):
        if room and room + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, room = i, 0
        room += n
    if start < len(sizes):
        yield batch.slice(start)


def shred(df: DataFrame, id_column: str, json_column: str, root: Node) -> DataFrame:
    """One row per record: its id and, by leaf path, the levels and values of that leaf.

    Null, broken and non-object documents keep a row whose columns hold the single definition level -1.
    Ids may be null or repeat; other columns of df are not looked at. An empty table gives an empty one.
    """
    names = root.number()
    schema = T.StructType([T.StructField("record", df.schema[id_column].dataType), *[T.StructField(n, LEVELS) for n in names]])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = pa.struct([("rep", pa.list_(pa.int8())), ("def", pa.list_(pa.int8())), ("val", pa.list_(pa.string()))])
        for batch in batches:
            for part in _slices(batch, "text"):
                rows = [[] for _ in names]
                for text in part.column("text").to_pylist():
                    columns = [([], [], []) for _ in names]
                    _shred_one(root, parse_object(text), columns)
                    for out, (rep, def_, val) in zip(rows, columns):
                        out.append({"rep": rep, "def": def_, "val": val})
                yield pa.RecordBatch.from_arrays([part.column("record"), *[pa.array(x, levels) for x in rows]], names=["record", *names])

    return df.select(F.col(id_column).alias("record"), F.col(json_column).cast("string").alias("text")).mapInArrow(stage, schema)


def positions(rep: np.ndarray, depth: int) -> list[np.ndarray]:
    """Of each entry of a level sequence, its place in the list of every repeated ancestor, outermost first."""
    index = np.arange(len(rep))
    found = []
    for level in range(1, depth + 1):
        begun = np.cumsum(rep <= level)
        outer = np.maximum.accumulate(np.where(rep < level, index, 0))
        found.append((begun - begun[outer]).astype(np.int32))
    return found


def assemble(shredded: DataFrame, root: Node, path: str, position_names: list[str], columns: dict[str, str], id_name: str) -> DataFrame:
    """The flat table of the repeated node at path: record id, place in the list of every repeated ancestor
    (the link to the parent rows), and the leaves named in columns ({output name: leaf})."""
    root.number()
    node = root.find(path)
    leaves = {out: f"{path}/{leaf}" for out, leaf in columns.items()}
    some = next(iter(leaves.values()))
    schema = T.StructType([
        T.StructField(id_name, shredded.schema["record"].dataType),
        *[T.StructField(n, T.IntegerType()) for n in position_names],
        *[T.StructField(n, T.StringType()) for n in leaves],
    ])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = batch.column(some).flatten()
            rep, def_ = (np.asarray(x.flatten()) for x in lead[:2])
            keep = np.flatnonzero(def_ >= node.def_)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lead[0].offsets)))
            arrays = [batch.column("record").take(pa.array(owner[keep])), *[pa.array(p[keep]) for p in positions(rep, node.rep)]]
            arrays += [batch.column(leaf).flatten()[2].flatten().take(pa.array(keep)) for leaf in leaves.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return shredded.select("record", *leaves.values()).mapInArrow(stage, schema)


def behaviour_layout(processes: tuple[str, ...] = (), calls: tuple[str, ...] = (), arguments: tuple[str, ...] = ()) -> Node:
    """behavior.processes[].calls[].arguments[] of a sandbox report with the leaves asked for; an object of
    arguments lists its entries."""
    nested = Node("arguments", arguments, repeated=True, entry_keys=("name", "value"))
    nested = Node("calls", calls, (nested,), repeated=True)
    nested = Node("processes", processes, (nested,), repeated=True)
    return Node("", (), (Node("behavior", (), (nested,)),))


PROCESS_PATH = "behavior/processes[]"
CALL_PATH = f"{PROCESS_PATH}/calls[]"
ARGUMENT_PATH = f"{CALL_PATH}/arguments[]"


def _table(reports: DataFrame, root: Node, path: str, places: list[str], columns: dict[str, str]) -> DataFrame:
    return assemble(shred(reports, "report_id", "report", root), root, path, places, columns, "report_id")


PROCESS_LEAVES = {"process_id": "process_id", "process_name": "process_name", "parent_id": "parent_id"}
CALL_LEAVES = {"api": "api", "category": "category", "status": "status", "return_value": "return", "called_at": "timestamp", "thread_id": "thread_id"}
ARGUMENT_LEAVES = {"argument_name": "name", "argument_value": "value", "pretty_value": "pretty_value"}


def processes_table(reports: DataFrame) -> DataFrame:
    """One row per usable process: report_id, process_pos, process_id, process_name, parent_id."""
    return _table(reports, behaviour_layout(processes=tuple(PROCESS_LEAVES.values())), PROCESS_PATH, ["process_pos"], PROCESS_LEAVES)


def calls_table(reports: DataFrame) -> DataFrame:
    """One row per usable call, linked to its process by (report_id, process_pos)."""
    return _table(reports, behaviour_layout(calls=tuple(CALL_LEAVES.values())), CALL_PATH, ["process_pos", "call_pos"], CALL_LEAVES)


def arguments_table(reports: DataFrame, values: bool = True) -> DataFrame:
    """One row per argument, linked to its call by (report_id, process_pos, call_pos).

    A missing or null name is ''; a name that is no string is its JSON text. Values are text or null and
    are shredded only if asked for. Null ids, repeated rows and reports without usable parts are kept,
    counted or left out as the lists say; an empty table gives an empty table.
    """
    leaves = ARGUMENT_LEAVES if values else {"argument_name": "name"}
    found = _table(reports, behaviour_layout(arguments=tuple(leaves.values())), ARGUMENT_PATH, ["process_pos", "call_pos", "argument_pos"], leaves)
    return found.withColumn("argument_name", F.coalesce("argument_name", F.lit("")))


def behaviour_tables(reports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(processes, calls, arguments) out of one shredding, whose levels are written to the shared folder: the way to take
    when more than one of the tables is needed."""
    root = behaviour_layout(*(tuple(x.values()) for x in (PROCESS_LEAVES, CALL_LEAVES, ARGUMENT_LEAVES)))
    levels = stored(shred(reports, "report_id", "report", root), "shredded-reports")
    processes = assemble(levels, root, PROCESS_PATH, ["process_pos"], PROCESS_LEAVES, "report_id")
    calls = assemble(levels, root, CALL_PATH, ["process_pos", "call_pos"], CALL_LEAVES, "report_id")
    arguments = assemble(levels, root, ARGUMENT_PATH, ["process_pos", "call_pos", "argument_pos"], ARGUMENT_LEAVES, "report_id")
    return processes, calls, arguments.withColumn("argument_name", F.coalesce("argument_name", F.lit("")))


def summary(processes: DataFrame, calls: DataFrame, arguments: DataFrame) -> DataFrame:
    """(report_id, processes, calls, arguments, orphans): how many rows of each table a report has, and how many calls
    lack their process or arguments their call; report ids are taken to be unique."""
    have = [
        processes.groupBy("report_id", "process_pos").agg(F.count("*").alias("p"), F.lit(0).alias("c"), F.lit(0).alias("a")),
        calls.groupBy("report_id", "process_pos").agg(F.lit(0).alias("p"), F.count("*").alias("c"), F.lit(0).alias("a")),
    ]
    by_call = calls.groupBy("report_id", "process_pos", "call_pos").agg(F.count("*").alias("c"), F.lit(0).alias("a")).unionByName(arguments.groupBy("report_id", "process_pos", "call_pos").agg(F.lit(0).alias("c"), F.count("*").alias("a")))
    of_call = by_call.groupBy("report_id", "process_pos", "call_pos").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))
    lost = of_call.groupBy("report_id", "process_pos").agg(F.lit(0).alias("p"), F.lit(0).alias("c"), F.sum("a").alias("a"), F.sum(F.when(F.col("c") == 0, F.col("a")).otherwise(0)).alias("lost"))
    rows = have[0].unionByName(have[1]).withColumn("lost", F.lit(0)).unionByName(lost)
    of_process = rows.groupBy("report_id", "process_pos").agg(*[F.sum(x).alias(x) for x in ("p", "c", "a", "lost")])
    orphans = F.col("lost") + F.when(F.col("p") == 0, F.col("c")).otherwise(0)
    return of_process.groupBy("report_id").agg(F.sum("p").alias("processes"), F.sum("c").alias("calls"), F.sum("a").alias("arguments"), F.sum(orphans).cast("int").alias("orphans"))
