"""The queries of the text-corpus operators, and SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import canonical_text, mixing, overlap, related_splits, splitting, subjects, tokenizing
from siltstone.runtime import read


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(read(spark, sf_dir, "manifest_pair"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(read(spark, sf_dir, "manifest_pair"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.class_members(read(spark, sf_dir, "manifest_pair"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.class_links(read(spark, sf_dir, "manifest_pair"))


def p4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_splits.forest(read(spark, sf_dir, "manifest_pair"), read(spark, sf_dir, "family_alias"))


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.form_members(read(spark, sf_dir, "raw_string"), read(spark, sf_dir, "confusable"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_splits.torn_pairs(read(spark, sf_dir, "manifest_pair"), read(spark, sf_dir, "family_alias"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_splits.assign(read(spark, sf_dir, "manifest_pair"), read(spark, sf_dir, "family_alias"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_splits.share_report(p4_splits(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).filter(F.col("piece_no") == 0).select("string_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(read(spark, sf_dir, "raw_string"), read(spark, sf_dir, "backend_prediction"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.lookalikes(read(spark, sf_dir, "raw_string"), read(spark, sf_dir, "confusable"))


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.canonical_strings(read(spark, sf_dir, "raw_string"), read(spark, sf_dir, "confusable"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode(read(spark, sf_dir, "documents"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(mixing.sized(read(spark, sf_dir, "documents")), read(spark, sf_dir, "mix_target"))
    return mixed


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(*mixing.mix(mixing.sized(read(spark, sf_dir, "documents")), read(spark, sf_dir, "mix_target")))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.posteriors(read(spark, sf_dir, "documents"), read(spark, sf_dir, "subject_label"), read(spark, sf_dir, "subject_area"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.found(_judged(spark, sf_dir))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(_judged(spark, sf_dir), read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_members": p2_members,
    "p2_links": p2_links,
    "p4_forest": p4_forest,
    "p6_members": p6_members,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_shares": p4_shares,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p6_canonical": p6_canonical,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_SPLIT = "CASE WHEN lower(trim({0}, E' \t\r\n')) IN ('train', 'calibration', 'test') THEN lower(trim({0}, E' \t\r\n')) END"
_HASH = "regexp_replace(lower(trim({0}, E' \t\r\n')), '^sha256:\\s*', '')"
_USABLE = "regexp_full_match({0}, '[0-9a-f]{{64}}') AND {0} <> repeat(left({0}, 1), 64) AND {0} <> 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855'"
_OVERLAPS = f"""
    sided AS (SELECT pair_id, source, {_SPLIT.format('split')} AS split, {_HASH.format('clean.sha256')} AS f, {_HASH.format('clean.code_region_sha256')} AS c, regexp_extract_all(lower(payload_text), '[a-z0-9]+') AS w FROM manifest_pair WHERE pair_id IS NOT NULL),
    records AS (SELECT row_number() OVER () AS n, *, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM sided WHERE split IS NOT NULL),
    keys AS (SELECT n, pair_id, source, split, 'file' AS way, f AS k FROM records WHERE {_USABLE.format('f')} UNION ALL SELECT n, pair_id, source, split, 'code', c FROM records WHERE {_USABLE.format('c')}),
    grams AS (SELECT n, split, unnest(g) AS k FROM records),
    shared AS (SELECT e.n AS e, t.n AS t, count(*) AS n_both FROM grams e JOIN grams t USING (k) WHERE e.split <> 'train' AND t.split = 'train' GROUP BY 1, 2),
    met AS (SELECT e.pair_id AS e, t.pair_id AS t, e.split, e.source, e.way FROM keys e JOIN keys t USING (way, k) WHERE e.split <> 'train' AND t.split = 'train'
        UNION ALL SELECT e.pair_id, t.pair_id, e.split, e.source, 'text' FROM shared s JOIN records e ON e.n = s.e JOIN records t ON t.n = s.t WHERE 2 * n_both >= len(e.g) + len(t.g) - n_both)
"""
_NAME = "nullif(regexp_replace(lower({0}), '[\\s_-]+', '', 'g'), '')"

ORACLES: dict[str, str] = {
    "p2_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(e, t) AS pair_id_a, greatest(e, t) AS pair_id_b FROM met WHERE e <> t",
    "p2_report": f"""WITH {_OVERLAPS}, base AS (SELECT split, coalesce(source, '') AS source, count(DISTINCT pair_id) AS pair_ids FROM records WHERE split <> 'train' GROUP BY 1, 2),
        hit AS (SELECT split, coalesce(source, '') AS source, count(DISTINCT e) AS overlapping, count(DISTINCT e) FILTER (way = 'file') AS by_file, count(DISTINCT e) FILTER (way = 'code') AS by_code, count(DISTINCT e) FILTER (way = 'text') AS by_text FROM met WHERE e <> t GROUP BY 1, 2)
        SELECT split, source, pair_ids, coalesce(overlapping, 0) AS overlapping, coalesce(by_file, 0) AS by_file, coalesce(by_code, 0) AS by_code, coalesce(by_text, 0) AS by_text FROM base LEFT JOIN hit USING (split, source)""",
    "p4_found": f"""WITH RECURSIVE named AS (SELECT pair_id, {_NAME.format('malware_family')} AS m0, {_NAME.format('payload_family')} AS f, [{_SPLIT.format('split')}, {_SPLIT.format('clean.split')}, {_SPLIT.format('injected.split')}] AS splits FROM manifest_pair),
        alias AS (SELECT {_NAME.format('alias_name')} AS a, min({_NAME.format('canonical_name')}) AS canonical FROM family_alias GROUP BY 1),
        records AS (SELECT 'p:' || pair_id AS p, pair_id, 'm:' || coalesce(canonical, m0) AS m, 'f:' || f AS f, splits FROM named LEFT JOIN alias ON m0 = a),
        link AS (SELECT p AS x, m AS y FROM records WHERE p || m IS NOT NULL UNION SELECT p, f FROM records WHERE p || f IS NOT NULL UNION SELECT m, f FROM records WHERE m || f IS NOT NULL),
        edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
        node AS (SELECT p AS x FROM records WHERE p IS NOT NULL UNION SELECT x FROM edge),
        reach AS (SELECT x, x AS y FROM node UNION SELECT r.x, e.y FROM reach r JOIN edge e ON e.x = r.y),
        root AS (SELECT x, min(y) AS grp FROM reach GROUP BY x),
        placed AS (SELECT r.pair_id, t.grp, r.splits FROM records r JOIN root t ON t.x = coalesce(r.p, r.m, r.f)),
        torn AS (SELECT grp FROM (SELECT grp, unnest(splits) AS s FROM placed) GROUP BY grp HAVING count(DISTINCT s) > 1)
        SELECT DISTINCT pair_id FROM placed WHERE pair_id IS NOT NULL AND grp IN (SELECT grp FROM torn)""",
    "p5_found": """WITH m AS (SELECT string_id, max(token_count) AS t FROM backend_prediction WHERE token_count > 0 GROUP BY string_id)
        SELECT r.string_id FROM raw_string r LEFT JOIN m USING (string_id) WHERE length(raw_string) > 0 AND (t > 512 OR t IS NULL AND length(raw_string) > 2048)""",
}
