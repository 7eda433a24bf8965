"""Schemas that drift between the files of a feed: fingerprints, versions, migration steps, one consistent table.

A file's schema is every path of its valid records with the set of JSON types seen there. Schemas are
fingerprinted; a feed's file opens a new version when its fingerprint differs from its predecessor's,
and only such pairs of files are compared. The differences are the migration steps: every file is routed
through its feed's chain of renames, then through defaults and casts, into one table. Steps and rules are
tables of their own.

Paths are kept as nodes of a tree, each with the digest of its path and of its parent's, so that a schema grows
with its paths and not with their lengths, however deep they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from siltstone.functions.json_text import as_text, clean, parse_object, type_of
from siltstone.runtime import small_enough, stored

#: JSON types by their bit in a type set.
TYPES = ("string", "integer", "fraction", "boolean", "object", "array")
_BIT = {name: 1 << i for i, name in enumerate(TYPES)}

#: Files a task looks at in order when predecessors are sought, so that no feed is one task.
FILE_BLOCK = 4096
#: Steps up to which a node carries its path as text; below, paths are put together only where they change.
NAMED_DEPTH = 64

_ROOT = b""
_NODES = "array<struct<id:binary,parent:binary,step:string,path:string,types:int>>"


class _Tree:
    """The paths of some documents: node numbers by (parent, step), with the types seen at each."""

    def __init__(self):
        self.below: dict[tuple[int, str], int] = {}
        self.parent, self.step, self.types, self.depth = [-1], [""], [0], [0]

    def _node(self, parent: int, step: str) -> int:
        found = self.below.setdefault((parent, step), len(self.step))
        if found == len(self.step):
            self.parent.append(parent)
            self.step.append(step)
            self.types.append(0)
            self.depth.append(self.depth[parent] + 1)
        return found

    def add(self, document: dict) -> None:
        due = [(document, 0, False)]
        while due:
            value, at, under_rules = due.pop()
            if isinstance(value, dict):
                children = ((x, ".*" if under_rules else f".{key}", key) for key, x in value.items())
            else:
                children = ((x, "[]", None) for x in value)
            for x, step, key in children:
                node = self._node(at, step)
                kind = type_of(x)
                if kind:
                    self.types[node] |= _BIT[kind]
                    if kind in ("object", "array") and x:
                        due.append((x, node, at == 0 and key == "rules"))

    def rows(self) -> list[tuple]:
        """(id, parent, step, path, types) of every node but the root; a node comes after its parent."""
        ids, paths = [_ROOT], [None]
        for parent, step, depth in zip(self.parent[1:], self.step[1:], self.depth[1:]):
            ids.append(blake2b(b"\0".join((ids[parent], step.encode("utf-8", "surrogatepass"))), digest_size=16).digest())
            paths.append(_join(paths[parent], clean(step)) if depth <= NAMED_DEPTH else None)  # the root has no path
        return [(ids[i], ids[self.parent[i]], clean(self.step[i]), paths[i], self.types[i]) for i in range(1, len(ids))]


def _join(path: str | None, step: str) -> str:
    """The path one step ('.key' or '[]') below a path; below the root the dot is left out."""
    return step.removeprefix(".") if path is None else path + step


def record_schemas(records: DataFrame) -> DataFrame:
    """(feed, file_no, id, parent, step, path, types): the paths of the valid records, added up within each task's
    batches, and a row without id for every file. types is a bit set over TYPES; null is no type."""
    fields = "id binary, parent binary, step string, path string, types int"
    schema = T.StructType([records.schema["feed"], records.schema["file_no"], *T.StructType.fromDDL(fields)])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, _Tree] = {}
            for feed, file_no, text in zip(*(batch.column(c).to_pylist() for c in ("feed", "file_no", "report"))):
                tree = seen.setdefault((feed, file_no), _Tree())
                document = parse_object(text, keep_entries=False)
                if document is not None:
                    tree.add(document)
            rows = [(*file, *r) for file, tree in seen.items() for r in ((None,) * 5, *tree.rows())]
            kinds = (batch.schema.field("feed").type, batch.schema.field("file_no").type, pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=schema.names)

    known = records.filter(F.col("feed").isNotNull() & F.col("file_no").isNotNull())
    return known.select("feed", "file_no", F.col("report").cast("string").alias("report")).mapInArrow(stage, schema)


def file_schemas(records: DataFrame) -> DataFrame:
    """(feed, file_no, paths): of every file its nodes in order of their ids; empty if no record is valid."""
    paths = record_schemas(records).groupBy("feed", "file_no", "id").agg(F.bit_or("types").alias("types"), *[F.min(c).alias(c) for c in ("parent", "step", "path")])
    node = F.when(F.col("id").isNotNull(), F.struct("id", "parent", "step", "path", "types"))
    return paths.groupBy("feed", "file_no").agg(F.sort_array(F.collect_list(node)).cast(_NODES).alias("paths"))


def versions(schemas: DataFrame) -> DataFrame:
    """(feed, file_no, fingerprint, previous_no, previous_fingerprint, version): a file beside the preceding one of its
    feed; versions count from 1, and a file opens one if its fingerprint differs from the preceding file's.

    Predecessors are sought and versions are counted within blocks of FILE_BLOCK file numbers; a block's first file
    takes the last file of the block before it, so a feed of any length is spread over tasks.
    """
    digest = F.sha2(F.array_join(F.array_sort(F.transform("paths", lambda p: F.concat_ws("=", F.coalesce(p["path"], F.hex(p["id"])), p["types"].cast("string")))), ","), 256)
    prints = schemas.select("feed", "file_no", digest.alias("fingerprint")).withColumn("_block", F.floor(F.col("file_no") / FILE_BLOCK))
    within = Window.partitionBy("feed", "_block").orderBy("file_no")
    own = prints.withColumn("_own", F.lag(F.struct("file_no", "fingerprint")).over(within))
    opens = (F.col("_own").isNotNull() & (F.col("_own.fingerprint") != F.col("fingerprint"))).cast("int")
    own = own.withColumn("_opened", F.sum(opens).over(within))
    blocks = own.groupBy("feed", "_block").agg(F.max(F.struct("file_no", "fingerprint")).alias("last"), F.min(F.struct("file_no", "fingerprint")).alias("first"), F.max("_opened").alias("opened"))
    by_block = Window.partitionBy("feed").orderBy("_block")
    blocks = blocks.withColumn("_before", F.lag("last").over(by_block)).withColumn("_edge", F.when(F.col("_before").isNull() | (F.col("_before.fingerprint") != F.col("first.fingerprint")), 1).otherwise(0))
    blocks = blocks.withColumn("_from", F.sum(F.col("opened") + F.col("_edge")).over(by_block) - F.col("opened"))
    both = own.join(blocks.select("feed", "_block", "_before", "_from"), ["feed", "_block"]).withColumn("_previous", F.coalesce("_own", "_before"))
    return both.select("feed", "file_no", "fingerprint", F.col("_previous.file_no").alias("previous_no"), F.col("_previous.fingerprint").alias("previous_fingerprint"), (F.col("_from") + F.col("_opened")).cast("int").alias("version"))


def schema_versions(schemas: DataFrame) -> DataFrame:
    """(feed, version, fingerprint, first_file, last_file, files, paths): one row per version of a feed. A fingerprint
    that returns after another one is a version of its own."""
    counted = versions(schemas).join(schemas.select("feed", "file_no", F.size("paths").alias("paths")), ["feed", "file_no"])
    return counted.groupBy("feed", "version", "fingerprint").agg(F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"), F.count("*").alias("files"), F.max("paths").alias("paths"))


def _differences(old: list[dict], new: list[dict]) -> list[tuple]:
    """(change_kind, field_path, old_path, old_types, new_types, parent) between two schemas.

    Only the upper ends of changed parts are listed. Of what vanished and appeared under one parent with one type set,
    the paths are paired in order of their names.
    """
    nodes = {n["id"]: n for n in (*old, *new)}
    before, after = ({n["id"]: n["types"] for n in side} for side in (old, new))
    changed = {i for i in nodes if before.get(i) != after.get(i)}

    def above(i):
        """The nodes on the way up, the parent first."""
        while (i := nodes[i]["parent"]) != _ROOT:
            yield i

    covered: dict[bytes, bool] = {}
    for i in changed:
        way = []
        for j in above(i):
            if j in covered or j in changed:
                hit = covered.get(j, False) or j in changed
                break
            way.append(j)
        else:
            hit = False
        covered.update(dict.fromkeys(way, hit))
        if hit:
            covered[i] = True
    texts: dict[bytes, str] = {_ROOT: ""}

    def text(i):
        if i not in texts:
            way = []
            for j in (i, *above(i)):
                way.append(j)
                if nodes[j]["path"] is not None:
                    break
            path = nodes[way[-1]]["path"]
            for j in reversed(way[:-1]):
                path = _join(path, nodes[j]["step"])
            texts[i] = path
        return texts[i]

    found, gone, come = [], {}, {}
    for i in changed:
        if covered.get(i):
            continue
        a, b, parent = before.get(i), after.get(i), nodes[i]["parent"]
        if a is None:
            come.setdefault((parent, b), []).append(text(i))
        elif b is None:
            gone.setdefault((parent, a), []).append(text(i))
        else:
            found.append(("type_changed", text(i), text(i), a, b, text(parent)))
    for key in gone.keys() | come.keys():
        parent, types = key
        left, right = sorted(gone.get(key, ())), sorted(come.get(key, ()))
        pairs = min(len(left), len(right))
        found += [("renamed", n, o, types, types, text(parent)) for o, n in zip(left, right)]
        found += [("removed", o, o, types, None, text(parent)) for o in left[pairs:]]
        found += [("added", n, None, None, types, text(parent)) for n in right[pairs:]]
    return found


def migration_steps(schemas: DataFrame) -> DataFrame:
    """Every change of a file against the preceding one: feed, file_no, previous_no, version, change_kind, field_path,
    old_path, old_types, new_types, parent.

    Only files that open a version are compared, each pair of schemas in one place, so nothing is shuffled by path.
    Paths below a changed one are left out. Where several paths of one parent and type set vanish and appear
    at once, they are paired in order of their names, and what is left over is removed or added.
    """
    moved = versions(schemas).filter(F.col("previous_no").isNotNull() & (F.col("fingerprint") != F.col("previous_fingerprint"))).select("feed", "file_no", "previous_no", "version")
    pairs = moved.join(schemas.select("feed", "file_no", F.col("paths").alias("new")), ["feed", "file_no"]).join(schemas.select("feed", F.col("file_no").alias("previous_no"), F.col("paths").alias("old")), ["feed", "previous_no"])
    pairs = pairs.select("feed", "file_no", "previous_no", "version", "old", "new")
    fields = "change_kind string, field_path string, old_path string, old_types int, new_types int, parent string"
    schema = T.StructType([*list(pairs.schema)[:4], *T.StructType.fromDDL(fields)])
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                owner, rows = [], []
                for i, (old, new) in enumerate(zip(part.column("old"), part.column("new"))):
                    met = _differences(old.as_py(), new.as_py())
                    owner += [i] * len(met)
                    rows += met
                keys = [part.column(c).take(pa.array(owner, pa.int32())) for c in schema.names[:4]]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)]], names=schema.names)

    return pairs.mapInArrow(stage, schema)


@dataclass(frozen=True)
class Target:
    """A column of the consistent table: the path it is read from, its type there, and what stands for a missing value.

    cast: string, timestamp, double, bigint or boolean, or array<...> of one of them, which collects all values at the
    path. An object is cast to text by the fields of the first group of `objects` that it has all of, joined by dots,
    else to its JSON text.
    """

    column: str
    path: str
    cast: str = "string"
    default: object = None
    objects: tuple[tuple[str, ...], ...] = ()

    @property
    def many(self) -> bool:
        return self.cast.startswith("array<")

    @property
    def item(self) -> str:
        return self.cast[6:-1] if self.many else self.cast


#: The consistent table of capability reports.
CAPABILITY_TARGETS = (
    Target("meta_version", "meta.version", objects=(("label",), ("major", "minor"))),
    Target("analysed_at", "meta.timestamp", "timestamp"),
    Target("sample_sha256", "meta.sample.sha256"),
    Target("sample_path", "meta.sample.path"),
    Target("flavor", "meta.flavor", default="unknown"),
    Target("technique_ids", "rules.*.meta.attack[].id", "array<string>"),
    Target("namespaces", "rules.*.meta.namespace", "array<string>"),
    Target("rule_names", "rules.*.meta.name", "array<string>"),
    Target("subscope", "rules.*.meta.is_subscope_rule", "array<boolean>"),
    Target("scores", "rules.*.meta.score", "array<double>"),
)
#: JSON types that a cast takes as they are.
NATURAL = {"string": ("string",), "timestamp": ("string",), "double": ("fraction", "integer"), "bigint": ("integer",), "boolean": ("boolean",)}


def _stems(targets) -> list[str]:
    """Every path on the way to a target, without the '[]' at its end, enclosing paths first."""
    return sorted({p for t in targets for p in _prefixes(t.path)}, key=lambda p: (p.count("."), p))


def _prefixes(path: str) -> list[str]:
    parts, found = path.split("."), []
    for i, part in enumerate(parts):
        stem = ".".join(parts[:i] + [part.removesuffix("[]")])
        found.append(stem)
    return found


def _split(stem: str) -> tuple[str, str, str]:
    """(stem of the enclosing path, its '[]' if it is a list, key)."""
    parent, _, key = stem.rpartition(".")
    above = parent.removesuffix("[]")
    return above, parent[len(above) :], key


def _below(parent: str, key: str) -> str:
    return f"{parent}.{key}" if parent else key


def _closure(first: str, links) -> list[str]:
    found = [first]
    for name in found:
        found += sorted({b for a, b in links if a == name} - {*found})
    return found


def _linked(steps: DataFrame, schemas: DataFrame, targets) -> tuple[dict[str, list[str]], dict[str, list[str]], list[str]]:
    """(keys by stem, keys by stem with doubtful ones, paths they may form): the keys that a chain of renames, in
    either direction, links to the key of a stem, that key first.

    Renames below a renamed path count for the path's stem. A link is doubtful if some file has both names side
    by side. Only names are gathered: their number is that of distinct renames under the parents of the targets,
    which the schema bounds, not the rows.
    """
    sure, every, paths = {}, {}, {"": [""]}
    renames = steps.filter(F.col("change_kind") == "renamed").select("parent", F.col("old_path").alias("a"), F.col("field_path").alias("b"))
    seen = schemas.select(F.transform("paths", lambda p: p["path"]).alias("has"))
    stems = _stems(targets)
    for depth in sorted({s.count(".") for s in stems}):
        level = [(s, *_split(s)) for s in stems if s.count(".") == depth]
        parents = sorted({p + suffix for _, above, suffix, _ in level for p in paths[above]})
        met = renames.filter(F.col("parent").isin(parents)).distinct()
        pairs = {(r.parent, r.a, r.b) for r in met.collect()}
        beside = {(r.parent, r.a, r.b) for r in met.join(seen, F.array_contains("has", F.col("a")) & F.array_contains("has", F.col("b")), "left_semi").collect()} if pairs else set()
        for stem, above, suffix, key in level:
            own = {p + suffix for p in paths[above]}
            keys = lambda rows: {x for p, a, b in rows if p in own for k in [len(_below(p, ""))] for x in ((a[k:], b[k:]), (b[k:], a[k:]))}  # noqa: B023, E731
            links = keys(pairs)
            sure[stem], every[stem] = _closure(key, links - keys(beside)), _closure(key, links)
            paths[stem] = [_below(p, k) for p in sorted(own) for k in every[stem]]
    return sure, every, sorted({p for some in paths.values() for p in some})


def known_names(steps: DataFrame, schemas: DataFrame, targets=CAPABILITY_TARGETS) -> dict[str, list[str]]:
    """Of each path on the way to a target, the other names it has had under the same parent, over all feeds."""
    return _names(_linked(steps, schemas, targets)[0])


def _names(keys: dict[str, list[str]]) -> dict[str, list[str]]:
    return {s: [_below(s.rpartition(".")[0], k) for k in found[1:]] for s, found in keys.items() if len(found) > 1}


def _hops(track: list[str], at: int, key: str) -> list[tuple[str, str, int | None]]:
    """The renames, each with the place of the file that brought it, that lead from a name to the key along a feed; the
    nearest file that has the key counts. Without one, a single rename that no step of the feed has."""
    there = [j for j, name in enumerate(track) if name == key]
    if not there:
        return [(track[at], key, None)]
    goal = min(there, key=lambda j: (abs(j - at), -j))
    way = range(at, goal) if goal > at else range(at, goal, -1)
    step = 1 if goal > at else -1
    return [(track[j], track[j + step], max(j, j + step)) for j in way if track[j] != track[j + step]]


def _feed_routes(files, stems, sure, every) -> tuple[list[dict[str, str]], dict[str, list[str]], dict[str, list[str]]]:
    """(routes, own, tracks): of each file of a feed the key of every stem where it differs from the stem's own, and
    of each stem the path it has and the key it is followed by in every file.

    files: (paths, renames) in order. A key is followed from file to file through the renames; of the keys it may
    have in the first file, the one counts that is the stem's own in some file and is there in most files. Where a
    file lacks the followed key, it may have another known one.
    """
    own, tracks, routes = {"": [""] * len(files)}, {}, [{} for _ in files]
    for stem in stems:
        above, suffix, key = _split(stem)
        parents = [p + suffix for p in own[above]]
        best, followed = (False, -1), [key] * len(files)
        for start in dict.fromkeys([*sure[stem], *every[stem]]):
            name, track = start, []
            for (_, renames), parent in zip(files, parents):
                name = next((new[len(_below(parent, "")) :] for old, new in renames if old == _below(parent, name)), name)
                track.append(name)
            there = [_below(p, n) in has for (has, _), p, n in zip(files, parents, track)]
            score = any(x and n == key for x, n in zip(there, track)), sum(there)
            if score > best and (score[0] or start in sure[stem]):
                best, followed = score, track
        own[stem], tracks[stem] = [], followed
        for (has, _), parent, name, route in zip(files, parents, followed, routes):
            found = next((n for n in (name, *sure[stem]) if _below(parent, n) in has), key)
            own[stem].append(_below(parent, found))
            if found != key:
                route[stem] = found
    return routes, own, tracks


def _file_rules(at: int, numbers, has: dict[str, int], route, own, tracks, targets) -> list[dict]:
    """What the records of a file go through, in order: a rename for every hop of a key, then for each target its
    default, if the file lacks it, or its cast, if the types met there are not those of the target."""
    rules = []
    for stem, found in route.items():
        hops = _hops(tracks[stem], at, _split(stem)[2]) if tracks[stem][at] == found else [(found, _split(stem)[2], None)]
        rules += [{"rule": "rename", "target": stem, "old": a, "new": b, "step_no": None if j is None else numbers[j]} for a, b, j in hops]
    for t in targets:
        stem, suffix = t.path.removesuffix("[]"), "[]" if t.path.endswith("[]") else ""
        path = own[stem][at] + suffix
        types = {n for n, bit in _BIT.items() if has.get(path, 0) & bit}
        above, listed, _ = _split(stem)
        if not types:
            line = has.get(own[above][at] + listed, 0) & _BIT["string"]
            rules.append({"rule": "cast" if line else "default", "target": t.column, "old": "string" if line else None, "new": t.cast if line else None if t.default is None else str(t.default), "step_no": None})
        elif other := types - {*NATURAL[t.item], *(("array",) if t.many else ())}:
            rules.append({"rule": "cast", "target": t.column, "old": "|".join(sorted(other)), "new": t.cast, "step_no": None})
    return rules


def file_routes(steps: DataFrame, schemas: DataFrame, targets=CAPABILITY_TARGETS) -> tuple[dict[str, list[str]], DataFrame]:
    """(known names, (feed, file_no, route, rules)): of every file the keys that lead to the targets in it, as JSON, and
    the rules its records go through: rename (target: the path whose key is renamed from old to new, step_no: the file
    that brought it), default (new: what stands for the missing value) and cast (old: the types met, new: the cast).

    The route follows the feed's own migration steps from file to file. A feed is one group, of which only the
    paths and renames on the way to the targets are moved.
    """
    sure, every, paths = _linked(steps, schemas, targets)
    stems = _stems(targets)
    wanted = sorted({*paths, *(p + "[]" for p in paths)})
    has = F.transform(F.filter("paths", lambda p: p["path"].isin(wanted) & (p["types"] != 0)), lambda p: F.struct(p["path"].alias("path"), p["types"].alias("types")))
    renames = steps.filter((F.col("change_kind") == "renamed") & F.col("old_path").isin(paths) & F.col("field_path").isin(paths))
    by_file = renames.groupBy("feed", "file_no").agg(F.collect_list(F.struct("old_path", "field_path")).alias("renames"))
    files = schemas.select("feed", "file_no", has.alias("has")).join(by_file, ["feed", "file_no"], "left")
    number = schemas.schema["file_no"].dataType.simpleString()
    rules = f"array<struct<rule:string,target:string,old:string,new:string,step_no:{number}>>"
    schema = T.StructType([schemas.schema["feed"], schemas.schema["file_no"], T.StructField("route", T.StringType()), *T.StructType.fromDDL(f"rules {rules}")])
    kind = to_arrow_schema(schema).field("rules").type

    def stage(feed: pa.Table) -> pa.Table:
        feed = feed.sort_by("file_no")
        numbers = feed["file_no"].to_pylist()
        rows = [({x["path"]: x["types"] for x in h}, [(r["old_path"], r["field_path"]) for r in m or []]) for h, m in zip(feed["has"].to_pylist(), feed["renames"].to_pylist())]
        routes, own, tracks = _feed_routes(rows, stems, sure, every)
        made = [_file_rules(i, numbers, h, r, own, tracks, targets) for i, ((h, _), r) in enumerate(zip(rows, routes))]
        return pa.table([feed["feed"], feed["file_no"], pa.array([json.dumps(r, sort_keys=True) for r in routes], pa.string()), pa.array(made, kind)], names=schema.names)

    return _names(sure), files.groupBy("feed").applyInArrow(stage, schema)


def _reader(target: Target, keys):
    """The keys that lead to a target, each with the names it may have (keys: by stem); '*' takes all, '[]' goes into a list."""
    steps = []
    for part, stem in zip(target.path.split("."), _prefixes(target.path)):
        steps.append(keys(stem))
        if part.endswith("[]"):
            steps.append(None)
    return steps


class Uncast(ValueError):
    """A value that its target's cast has no rule for."""


def _boolean(value):
    if isinstance(value, str):
        value = {"true": True, "false": False, "1": True, "0": False}.get(value.strip().lower())
    if isinstance(value, bool) or value in (0, 1):
        return bool(value)
    raise Uncast


def _timestamp(value):
    """ISO text, of UTC where it names no zone, or seconds since 1970."""
    try:
        if isinstance(value, str):
            found = datetime.fromisoformat(value.strip())
            return found.replace(tzinfo=UTC) if found.tzinfo is None else found.astimezone(UTC)
        if not isinstance(value, (bool, dict, list)):
            return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=float(value))
    except (ValueError, OverflowError):
        pass
    raise Uncast


def _number(kind):
    def read(value):
        try:
            if not isinstance(value, (bool, dict, list)):
                return kind(value)
        except (ValueError, OverflowError):
            pass
        raise Uncast

    return read


def _whole(value):
    found = int(value) if isinstance(value, (str, int)) else int(value) if float(value).is_integer() else None
    if found is None or not -(1 << 63) <= found < 1 << 63:
        raise ValueError("no 64-bit integer")
    return found


def _as_string(value, target: Target) -> str:
    if isinstance(value, dict):
        for fields in target.objects:
            parts = [value.get(f) for f in fields]
            if not any(p is None or isinstance(p, (dict, list)) for p in parts):
                return ".".join(map(as_text, parts))
    return as_text(value)


_CASTS = {"timestamp": _timestamp, "double": _number(float), "bigint": _number(_whole), "boolean": _boolean}
_ARROW = {"string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _cast(value, target: Target):
    return _as_string(value, target) if target.item == "string" else _CASTS[target.item](value)


def _collect(value, steps, at, out):
    if at == len(steps):
        if value is not None:
            out.append(value)
        return
    keys = steps[at]
    if keys is None:
        for item in value if isinstance(value, list) else [value]:
            _collect(item, steps, at + 1, out)
    elif isinstance(value, dict):
        if keys[0] == "*":
            for item in value.values():
                _collect(item, steps, at + 1, out)
        else:
            for key in keys:
                if value.get(key) is not None:
                    _collect(value[key], steps, at + 1, out)
                    break
    elif isinstance(value, str) and at == len(steps) - 1 and value.endswith("]") and " [" in value:
        out.append(value.rpartition(" [")[2][:-1])  # an entry written as one line: tactic::technique [id]


def consistent_table(records: DataFrame, names: dict[str, list[str]], targets=CAPABILITY_TARGETS, routes: DataFrame | None = None) -> DataFrame:
    """Every valid record in one shape: record_id, feed, file_no, the targets, found by the route of the record's file
    (without routes, and for records of no file, under any of their names), and uncast.

    A missing value is the target's default, a missing list is empty. At a list target a list adds its items. What a
    cast has no rule for comes out as null, or not at all in a list, and is written to uncast as 'column=text', so no
    value is lost. Null, broken and non-object reports give no row.
    """
    schema = T.StructType([records.schema["record_id"], records.schema["feed"], records.schema["file_no"], *T.StructType.fromDDL(", ".join(f"`{t.column}` {t.cast}" for t in targets)), T.StructField("uncast", T.ArrayType(T.StringType()))])
    key = lambda stem: stem.rpartition(".")[2]
    readers = {None: [_reader(t, lambda s: [key(s), *[n[len(s) - len(key(s)) :] for n in names.get(s, [])]]) for t in targets]}

    def readers_of(route):
        if route not in readers:
            keys = json.loads(route)
            readers[route] = [_reader(t, lambda s: [keys.get(s, key(s))]) for t in targets]
        return readers[route]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, columns, uncast = [], [[] for _ in targets], []
            for i, (text, route) in enumerate(zip(batch.column("report").to_pylist(), batch.column("route").to_pylist())):
                document = parse_object(text, keep_entries=False)
                if document is None:
                    continue
                keep.append(i)
                bad = []
                for t, steps, column in zip(targets, readers_of(route), columns):
                    values: list = []
                    _collect(document, steps, 0, values)
                    if t.many:
                        values = [x for v in values for x in (v if isinstance(v, list) else [v]) if x is not None]
                    done = []
                    for x in values if t.many else values[:1]:
                        try:
                            done.append(_cast(x, t))
                        except Uncast:
                            bad.append(f"{t.column}={as_text(x)}")
                    column.append(done if t.many else done[0] if done else None if values else t.default)
                uncast.append(bad)
            ids = [batch.column(c).take(pa.array(keep, pa.int32())) for c in ("record_id", "feed", "file_no")]
            made = [pa.array(c, pa.list_(_ARROW[t.item]) if t.many else _ARROW[t.item]) for t, c in zip(targets, columns)]
            yield pa.RecordBatch.from_arrays([*ids, *made, pa.array(uncast, pa.list_(pa.string()))], names=schema.names)

    rows = records.select("record_id", "feed", "file_no", F.col("report").cast("string").alias("report"))
    if routes is None:
        rows = rows.withColumn("route", F.lit(None).cast("string"))
    else:
        routes = stored(routes.select("feed", "file_no", "route"), "file-routes")
        rows = rows.join(F.broadcast(routes) if small_enough(routes.count(), 200) else routes, ["feed", "file_no"], "left")
    return rows.select("record_id", "feed", "file_no", "report", "route").mapInArrow(stage, schema)


def type_names(column: str) -> F.Column:
    """A bit set over TYPES as text: 'array|string'."""
    return F.array_join(F.array_sort(F.filter(F.array(*[F.when(F.col(column).bitwiseAND(b) != 0, F.lit(n)) for n, b in _BIT.items()]), lambda x: x.isNotNull())), "|")


def drift(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file schemas, migration steps), the schemas written to the shared folder as several stages read them.

    Rows without feed or file_no belong to no file; null, broken and non-object reports add no path, and a file
    without a valid record has the empty schema. Repeated and late rows change nothing. An empty table gives
    empty results.
    """
    schemas = stored(file_schemas(records), "file-schemas")
    return schemas, migration_steps(schemas)
