"""Splits that keep related records together.

Records and the entities they name form a graph. Borůvka rounds contract it: every component takes its
least outgoing edge, the taken edges are written as part of a spanning forest, and the components they
join become one. Each round at least halves the components that have an edge left. The roots of the
forest are the groups; they are stratified by size band and dealt systematically to the splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.manifest_names import family_name, split_bit
from siltstone.operators.prefix_sums import prefix_sums
from siltstone.runtime import Stored, lookup, stored

SHARES = {"train": 0.7, "validation": 0.1, "test": 0.2}


def _entity(kind: str, value):
    """A 16-byte node of the graph; null stays null."""
    return F.when(value.isNotNull(), F.unhex(F.md5(F.concat(F.lit(f"{kind}\u0001"), value))))


def entities(manifest: DataFrame) -> DataFrame:
    """Rows with pair_id, the bits of their splits, and the nodes they touch (a row with none touches nothing)."""
    pair = F.when(F.trim(F.col("pair_id")) != "", F.col("pair_id"))
    nodes = F.array(_entity("p", pair), _entity("m", family_name(F.col("malware_family"))), _entity("f", family_name(F.col("payload_family"))))
    bits = split_bit("split").bitwiseOR(split_bit("clean.split")).bitwiseOR(split_bit("injected.split"))
    return manifest.select("pair_id", bits.alias("bits"), F.array_compact(nodes).alias("nodes"))


def edges(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(a, b): each row's first node with its others, and each family alias with its canonical name; a < b."""
    own = rows.select(F.get("nodes", F.lit(0)).alias("x"), F.explode(F.slice("nodes", 2, 8)).alias("y"))
    alias = aliases.select(_entity("m", family_name(F.col("alias_name"))).alias("x"), _entity("m", family_name(F.col("canonical_name"))).alias("y"))
    both = own.unionByName(alias).filter(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("x") != F.col("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _roots(taken: DataFrame) -> Stored:
    """Pointers (node, root) from each component's chosen neighbour: of two that chose each other the smaller
    is the root, and pointers are doubled until they end there."""
    back = taken.select(F.col("c").alias("o"), F.col("o").alias("_again"))
    joined = taken.join(back, "o", "left")
    at_root = (F.col("_again") == F.col("c")) & (F.col("c") < F.col("o"))
    now = Stored(joined.select(F.col("c").alias("node"), F.when(at_root, F.col("c")).otherwise(F.col("o")).alias("root")), "pointers")
    total = now.df.count()
    while True:
        up = now.df.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        ahead = Stored(lookup(now.df, up, "root", total).select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")), "pointers")
        moved = ahead.df.filter("_moved").limit(1).count()
        now.drop()
        ahead.df = ahead.df.drop("_moved")
        now = ahead
        if not moved:
            return now


def spanning_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, labels): the edges taken (a, b), and (node, root) of every node that has an edge.

    Edges are ordered by a hash and then by their ends, so that a round's choices form no cycle but pairs.
    """
    live = Stored(links.select(F.xxhash64("a", "b").alias("w"), "a", "b", F.col("a").alias("u"), F.col("b").alias("v")), "live-edges")
    forest, steps = [], []
    while total := live.df.count():
        edge = F.struct("w", "a", "b")
        ends = F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("v").alias("o")), F.struct(F.col("v").alias("c"), F.col("u").alias("o"))))
        least = live.df.select(edge.alias("e"), ends.alias("s")).groupBy("s.c").agg(F.min(F.struct("e", "s.o")).alias("m"))
        taken = Stored(least.select("c", "m.o", "m.e.a", "m.e.b"), "taken-edges")
        forest.append(taken.df.select("a", "b"))
        step = _roots(taken.df.select("c", "o"))
        steps.append(step.df)
        near = step.df.select(F.col("node").alias("u"), F.col("root").alias("_u"))
        far = step.df.select(F.col("node").alias("v"), F.col("root").alias("_v"))
        moved = lookup(lookup(live.df, near, "u", total), far, "v", total).filter(F.col("_u") != F.col("_v"))
        sides = moved.select("w", "a", "b", F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
        kept = Stored(sides.groupBy("u", "v").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.w", "e.a", "e.b", "u", "v"), "live-edges")
        live.drop()
        live = kept
    spark = links.sparkSession
    if not steps:
        none = spark.createDataFrame([], "node binary, root binary")
        return links.select("a", "b").limit(0), none
    labels = steps[-1]
    for step in reversed(steps[:-1]):  # from the few roots of the last round down to all nodes
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        labels = lookup(step, above, "root", step.count(), "left").select("node", F.coalesce("_top", "root").alias("root"))
    taken = forest[0]
    for more in forest[1:]:
        taken = taken.unionByName(more)
    return taken.distinct(), stored(labels, "forest-labels")


def grouped(manifest: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, forest): each row with its group (null for a row that names nothing), and the spanning forest."""
    rows = stored(entities(manifest).withColumn("node", F.get("nodes", F.lit(0))), "manifest-entities")
    forest, labels = spanning_forest(edges(rows, aliases))
    alone = F.coalesce("root", "node")
    return lookup(rows, labels, "node", rows.count(), "left").select("pair_id", "bits", alone.alias("grp")), forest


def torn_pairs(manifest: DataFrame, aliases: DataFrame) -> DataFrame:
    """(pair_id): every pair_id in a related group whose rows declare more than one split.

    Null and blank names share nothing; a null pair_id is not listed but still ties its families together.
    Unknown splits are no splits. Repeated rows give a pair_id once. Empty tables give an empty one.
    """
    rows, _ = grouped(manifest, aliases)
    rows = stored(rows, "manifest-groups").filter(F.col("grp").isNotNull())
    torn = rows.groupBy("grp").agg(F.bit_or("bits").alias("_bits")).filter(F.bit_count("_bits") > 1).select("grp")
    pairs = rows.filter(F.col("pair_id").isNotNull()).select("pair_id", "grp").distinct()  # a pair_id has one group, so it stays distinct
    return lookup(pairs, torn, "grp", rows.count()).select("pair_id")


def _deal(bands: list, shares: dict[str, float]) -> dict[int, dict[str, int]]:
    """How many groups of each size band go to each split, from the largest band down: what a split still
    lacks of its share decides, and rests go to the largest lack. bands: (band, groups, records)."""
    total = sum(b["records"] for b in bands)
    lack = {s: total * x for s, x in shares.items()}
    counts = {}
    for b in sorted(bands, key=lambda b: -b["band"]):
        wish = {s: max(0.0, x) for s, x in lack.items()}
        whole = sum(wish.values()) or 1.0
        exact = {s: b["groups"] * x / whole for s, x in wish.items()}
        given = {s: int(x) for s, x in exact.items()}
        mean = b["records"] / b["groups"]
        for _ in range(b["groups"] - sum(given.values())):
            s = max(lack, key=lambda s: lack[s] - given[s] * mean)
            given[s] += 1
        for s in given:
            lack[s] -= given[s] * mean
        counts[b["band"]] = given
    return counts


def assign(manifest: DataFrame, aliases: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(pair_id, grp, group_rows, split): the split of every pair_id, one for all rows of a related group.

    Groups are stratified by size band (powers of two). The number of groups of each band that go to each
    split is set from the bands' totals (at most 64 rows), from the largest band down; within a band the
    groups, in order of a hash, are dealt systematically: every so manieth to a split. A group larger than
    a share goes to the split that lacks most. Rows without pair_id count in their group and are not listed.
    """
    shares = shares or SHARES
    rows, _ = grouped(manifest, aliases)
    rows = stored(rows.filter(F.col("grp").isNotNull()), "manifest-groups")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("group_rows")).withColumn("band", F.floor(F.log2("group_rows")).cast("int")).withColumn("one", F.lit(1)).withColumn("_h", F.xxhash64("grp"))
    sizes = stored(sizes, "group-sizes")
    bands = sizes.groupBy("band").agg(F.count("*").alias("groups"), F.sum("group_rows").alias("records")).collect()
    counts = _deal(bands, shares)
    ranked = prefix_sums(sizes, ["band"], ["_h", "grp"], "one", sum(b["groups"] for b in bands), "k")
    names = list(shares)
    plan = rows.sparkSession.createDataFrame([(b["band"], b["groups"], *[counts[b["band"]][s] for s in names]) for b in bands] or [(-1, 0, *[0] * len(names))], f"band int, n long, {', '.join(f'n{i} long' for i in range(len(names)))}")
    dealt = ranked.join(F.broadcast(plan), "band").withColumn("_k", F.col("k")).withColumn("_n", F.col("n")).withColumn("split", F.lit(None).cast("string"))
    for i in reversed(range(1, len(names))):  # nested systematic samples: the last split first, the first one takes the rest
        hit = F.col("split").isNull() & (F.floor((F.col("_k") + 1) * F.col(f"n{i}") / F.col("_n")) > F.floor(F.col("_k") * F.col(f"n{i}") / F.col("_n")))
        before = F.floor(F.col("_k") * F.col(f"n{i}") / F.col("_n"))
        dealt = dealt.withColumn("split", F.when(hit, F.lit(names[i])).otherwise(F.col("split"))).withColumn("_k", F.col("_k") - before).withColumn("_n", F.greatest(F.col("_n") - F.col(f"n{i}"), F.lit(1)))
    dealt = dealt.select("grp", "group_rows", F.coalesce("split", F.lit(names[0])).alias("split"))
    pairs = rows.filter(F.col("pair_id").isNotNull()).select("pair_id", "grp").distinct()
    return lookup(pairs, dealt, "grp", rows.count()).select("pair_id", F.lower(F.hex("grp")).alias("grp"), "group_rows", "split")


def share_report(assigned: DataFrame) -> DataFrame:
    """(split, pair_ids, share, records, record_share) of an assignment: records are the rows of its groups, which the
    deal balances."""
    groups = assigned.groupBy("split", "grp").agg(F.count("*").alias("p"), F.max("group_rows").alias("r"))
    by = groups.groupBy("split").agg(F.sum("p").alias("pair_ids"), F.sum("r").alias("records"))
    whole = Window.partitionBy()  # three rows
    return by.select("split", "pair_ids", F.round(F.col("pair_ids") / F.sum("pair_ids").over(whole), 6).alias("share"), "records", F.round(F.col("records") / F.sum("records").over(whole), 6).alias("record_share"))


def forest(manifest: DataFrame, aliases: DataFrame) -> DataFrame:
    """(a, b): the spanning forest of the related groups, an edge for every two nodes it first joins; nodes are digests
    of pair_ids and names. Groups with n nodes have n - 1 edges."""
    _, found = grouped(manifest, aliases)
    return found.select(F.lower(F.hex("a")).alias("a"), F.lower(F.hex("b")).alias("b"))
