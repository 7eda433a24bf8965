"""Records of evaluation splits that also lie, exactly or almost, in the training split.

Texts are taken together into classes of equal word sequences. Over one member of each class runs an
exact prefix-filter join: shingles are ranked from rare to frequent over all classes, the evaluation
classes are indexed by the shingles of their prefix, and the training classes probe that index under
length, position and bitmap filters, none of which can lose a pair. What is left is verified on the
shingles themselves and expanded by class membership. Equal hashes are found by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.manifest_names import EVALUATION, TRAIN, split_name, usable_hash
from siltstone.runtime import lookup, stored

#: The stated problem: three words, similarity one half (num/den keeps the filters in whole numbers).
WORDS, NUM, DEN = 3, 1, 2
#: 64-bit lanes of the bitmap filter.
LANES = 4
#: Pairs of classes that one part of a hot prefix shingle brings together, and the most parts of one.
PART_PAIRS, MOST_PARTS = 1_000_000, 4096


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(w: Column, n: int = WORDS) -> Column:
    """The distinct runs of n words, joined by blanks; empty for fewer words."""
    runs = w
    for k in range(1, n):  # no lambda holds w, which would be made anew for each word
        runs = F.zip_with(runs, F.slice(w, k + 1, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    runs = F.slice(runs, F.lit(1), F.size(w) - (n - 1))
    return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def sides(manifest: DataFrame) -> DataFrame:
    """The rows of a training (side T) or evaluation (side E) split with a pair_id; rows of no split fall away."""
    split = split_name("split")
    side = F.when(split == TRAIN, "T").when(split.isin(*EVALUATION), "E")
    return manifest.select("pair_id", "source", split.alias("split"), side.alias("side"), usable_hash("clean.sha256").alias("file_hash"), usable_hash("clean.code_region_sha256").alias("code_hash"), "payload_text").filter(
        F.col("side").isNotNull() & F.col("pair_id").isNotNull()
    )


def _hot_from(total: int) -> int:
    return max(5000, total // 1000)


def _ranked(classes: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(classes with their shingle hashes from rare to frequent and a bitmap of them, shingles that may be hot: fewer
    than 1000 rows)."""
    each = classes.select("cls", F.explode("hashes").alias("sh"))
    frequency = stored(each.groupBy("sh").agg(F.count("*").alias("n")), "shingle-counts")
    counted = lookup(each, frequency, "sh", total, counts="n")
    lane, bit = F.pmod(F.col("sh"), F.lit(LANES)), F.pmod(F.shiftright("sh", 8), F.lit(64)).cast("int")
    lanes = [F.bit_or(F.when(lane == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).otherwise(F.lit(0).cast("bigint"))).alias(f"m{k}") for k in range(LANES)]
    ranked = counted.groupBy("cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "sh"))), lambda x: x["sh"]).alias("ranked"), *lanes)
    return ranked, frequency.filter(F.col("n") > _hot_from(total)).select("sh")


def _prefixes(ranked: DataFrame, sized: Column, tag: str) -> DataFrame:
    """A row for each shingle of the prefix |x| - ceil(t|x|) + 1, with its place from 0."""
    length = F.size("ranked")
    kept = length - F.ceil(length * NUM / DEN).cast("int") + 1
    return ranked.filter(sized).select(
        F.col("cls").alias(f"cls_{tag}"), length.alias(f"len_{tag}"), *[F.col(f"m{k}").alias(f"m{k}_{tag}") for k in range(LANES)], F.posexplode(F.slice("ranked", F.lit(1), kept)).alias(f"at_{tag}", "sh")
    )


def _dealt(index: DataFrame, probe: DataFrame, frequent: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with _part. Of a shingle that is hot on either side, the larger side is dealt to as many parts as its
    pairs ask for, and the other side is copied to each; so neither side of it is ever one task."""
    sides = index.select("sh", F.lit(1).alias("e"), F.lit(0).alias("t")).unionByName(probe.select("sh", F.lit(0).alias("e"), F.lit(1).alias("t")))
    sides = sides.join(F.broadcast(frequent), "sh", "left_semi")
    counts = sides.groupBy("sh").agg(F.sum("e").alias("e"), F.sum("t").alias("t")).filter((F.col("e") > 0) & (F.col("t") > 0) & (F.greatest("e", "t") > _hot_from(total)))  # fewer than 2000 rows
    parts = F.least(F.lit(MOST_PARTS), F.greatest("e", "t"), F.ceil(F.col("e") * F.col("t") / PART_PAIRS)).cast("int")
    hot = F.broadcast(stored(counts.select("sh", parts.alias("_parts"), (F.col("t") >= F.col("e")).alias("_deal_t")), "hot-shingles"))
    made = []
    for side, key, dealt in ((index, "cls_e", ~F.col("_deal_t")), (probe, "cls_t", F.col("_deal_t"))):
        one = F.array(F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
        part = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(dealt, one).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        made.append(side.join(hot, "sh", "left").withColumn("_part", F.explode(part)).drop("_parts", "_deal_t"))
    return made[0], made[1]


def similar_classes(classes: DataFrame) -> DataFrame:
    """(cls_e, cls_t): classes on the two sides whose shingle sets have a Jaccard similarity of NUM/DEN or more.

    classes has cls, text (the words joined by blanks), hashes (of its shingles), on_e and on_t. Classes without shingles are similar
    to nothing; a class on both sides is similar to itself.
    """
    total = classes.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    ranked, frequent = _ranked(classes, total)
    ranked = stored(ranked.join(classes.select("cls", "on_e", "on_t"), "cls"), "ranked-shingles")
    index, probe = _prefixes(ranked, F.col("on_e"), "e"), _prefixes(ranked, F.col("on_t"), "t")
    if frequent.isEmpty():  # no shingle has rows enough to be hot on any side
        index, probe = (x.withColumn("_part", F.lit(0)) for x in (index, probe))
    else:
        index, probe = _dealt(index, probe, frequent, total)
    e, t = F.col("len_e"), F.col("len_t")
    least = F.ceil((e + t) * NUM / (NUM + DEN))
    differ = sum((F.bit_count(F.col(f"m{k}_e").bitwiseXOR(F.col(f"m{k}_t"))) for k in range(1, LANES)), F.bit_count(F.col("m0_e").bitwiseXOR(F.col("m0_t"))))
    near = (
        (e * DEN >= t * NUM) & (t * DEN >= e * NUM)  # length
        & (1 + F.least(e - F.col("at_e") - 1, t - F.col("at_t") - 1) >= least)  # position
        & ((e + t - differ) >= 2 * least)  # bitmap
        & (F.col("cls_e") != F.col("cls_t"))
    )
    met = index.join(probe, ["sh", "_part"]).filter(near).select("cls_e", "cls_t").distinct()
    text = classes.select("cls", "text")
    pairs = met.join(text.withColumnsRenamed({"cls": "cls_e", "text": "text_e"}), "cls_e").join(text.withColumnsRenamed({"cls": "cls_t", "text": "text_t"}), "cls_t")
    pairs = pairs.withColumn("_e", shingles(F.split("text_e", " "))).withColumn("_t", shingles(F.split("text_t", " "))).withColumn("_both", F.size(F.array_intersect("_e", "_t")))
    verified = pairs.filter(F.col("_both") * DEN >= (F.size("_e") + F.size("_t") - F.col("_both")) * NUM).select("cls_e", "cls_t")
    same = ranked.filter(F.col("on_e") & F.col("on_t")).select(F.col("cls").alias("cls_e"), F.col("cls").alias("cls_t"))
    return verified.unionByName(same)


def text_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes): (pair_id, side, source, split, cls) of rows with at least WORDS words, and one row for each class."""
    said = rows.select("pair_id", "side", "source", "split", F.array_join(words(F.col("payload_text")), " ").alias("text")).filter(F.size(F.split("text", " ")) >= WORDS)
    said = stored(said.withColumn("cls", F.unhex(F.md5("text"))), "said-words")  # words are found once, for both tables
    members = said.select("pair_id", "side", "source", "split", "cls").distinct()
    classes = said.groupBy("cls").agg(F.first("text").alias("text"), F.max(F.col("side") == "E").alias("on_e"), F.max(F.col("side") == "T").alias("on_t"))
    return members, classes.withColumn("hashes", F.transform(shingles(F.split("text", " ")), lambda s: F.xxhash64(s)))


def _hash_matches(rows: DataFrame, *columns: str) -> DataFrame:
    keyed = rows.select(*columns, "side", F.explode(F.array(F.struct(F.lit("f").alias("kind"), F.col("file_hash").alias("hash")), F.struct(F.lit("c").alias("kind"), F.col("code_hash").alias("hash")))).alias("k"))
    return keyed.filter(F.col("k.hash").isNotNull()).select(*columns, "side", "k.kind", "k.hash").distinct()


def _linked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links between classes), both written."""
    members, classes = text_classes(rows)
    classes, members = stored(classes, "text-classes"), stored(members, "class-members")
    return members, stored(similar_classes(classes), "class-links")


def class_links(manifest: DataFrame) -> DataFrame:
    """(cls_e, cls_t, e_pairs, t_pairs): the classes of equal texts that overlap across training and evaluation, and how
    many pair_ids each holds on its side."""
    members, linked = _linked(stored(sides(manifest), "manifest-sides"))
    held = members.groupBy("cls", "side").agg(F.countDistinct("pair_id").alias("n"))
    of = lambda side, tag: held.filter(F.col("side") == side).select(F.col("cls").alias(f"cls_{tag}"), F.col("n").alias(f"{tag}_pairs"))
    met = linked.join(of("E", "e"), "cls_e").join(of("T", "t"), "cls_t")
    return met.select(F.lower(F.hex("cls_e")).alias("cls_e"), F.lower(F.hex("cls_t")).alias("cls_t"), "e_pairs", "t_pairs")


def class_members(manifest: DataFrame) -> DataFrame:
    """(pair_id, split, cls, links): the class of every pair_id's text in each split, and how many classes of the other
    side overlap with it. With class_links() this is all that overlaps() expands from texts."""
    members, linked = _linked(stored(sides(manifest), "manifest-sides"))
    links = linked.groupBy(F.col("cls_e").alias("cls"), F.lit("E").alias("side")).agg(F.count("*").alias("links")).unionByName(linked.groupBy(F.col("cls_t").alias("cls"), F.lit("T").alias("side")).agg(F.count("*").alias("links")))
    found = members.select("pair_id", "side", "split", "cls").distinct().join(links, ["cls", "side"], "left")
    return found.select("pair_id", "split", F.lower(F.hex("cls")).alias("cls"), F.coalesce("links", F.lit(0)).alias("links"))


def overlaps(manifest: DataFrame) -> DataFrame:
    """(pair_id_a, pair_id_b): pair_ids, the smaller first, that overlap across training and evaluation.

    Null or unusable hashes and null, empty or shorter texts match nothing. Rows without pair_id or without a
    known split are no records of a split. Reissued rows give a pair once. Other columns are not looked at;
    an empty table gives an empty one.
    """
    rows = stored(sides(manifest), "manifest-sides")
    hashed = _hash_matches(rows, "pair_id")
    e, t = (hashed.filter(F.col("side") == x).select("kind", "hash", F.col("pair_id").alias(x.lower())) for x in ("E", "T"))
    by_hash = e.join(t, ["kind", "hash"]).select("e", "t")
    members, linked = _linked(rows)
    of = members.select("cls", "pair_id", "side").distinct()
    e, t = (of.filter(F.col("side") == x).select(F.col("cls").alias(f"cls_{x.lower()}"), F.col("pair_id").alias(x.lower())) for x in ("E", "T"))
    by_text = linked.join(e, "cls_e").join(t, "cls_t").select("e", "t")
    both = by_hash.unionByName(by_text).filter(F.col("e") != F.col("t"))
    return both.select(F.least("e", "t").alias("pair_id_a"), F.greatest("e", "t").alias("pair_id_b")).distinct()


def overlap_report(manifest: DataFrame) -> DataFrame:
    """Per evaluation split and source: rows' distinct pair_ids, and how many of them overlap with training by each way.

    A pair_id that only meets itself in training is not an overlap. No pair is expanded: a pair_id overlaps by
    a key or class if training holds it under another pair_id, which its smallest and greatest training pair_id tell.
    """
    rows = stored(sides(manifest), "manifest-sides")
    source = F.coalesce("source", F.lit(""))
    base = rows.filter(F.col("side") == "E").groupBy("split", source.alias("source")).agg(F.countDistinct("pair_id").alias("pair_ids"))
    ends = [F.min("pair_id").alias("lo"), F.max("pair_id").alias("hi")]
    other = (F.col("lo") != F.col("pair_id")) | (F.col("hi") != F.col("pair_id"))
    hashed = _hash_matches(rows, "pair_id", "split", "source")
    in_train = hashed.filter(F.col("side") == "T").groupBy("kind", "hash").agg(*ends)
    by_hash = hashed.filter(F.col("side") == "E").join(in_train, ["kind", "hash"]).filter(other).select("split", "source", "pair_id", F.when(F.col("kind") == "f", "file").otherwise("code").alias("way"))
    members, linked = _linked(rows)
    reached = linked.join(members.filter(F.col("side") == "T").groupBy(F.col("cls").alias("cls_t")).agg(*ends), "cls_t").groupBy(F.col("cls_e").alias("cls")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by_text = members.filter(F.col("side") == "E").join(reached, "cls").filter(other).select("split", "source", "pair_id", F.lit("text").alias("way"))
    found = by_hash.unionByName(by_text).withColumn("source", source).groupBy("split", "source")
    ways = [F.countDistinct(F.when(F.col("way") == w, F.col("pair_id"))).alias(f"by_{w}") for w in ("file", "code", "text")]
    counted = found.agg(F.countDistinct("pair_id").alias("overlapping"), *ways)
    return base.join(counted, ["split", "source"], "left").na.fill(0, ["overlapping", "by_file", "by_code", "by_text"])
