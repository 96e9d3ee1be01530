"""Queries and SQL of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import abuse, components, cross_split, leaks, near_duplicates, packing
from tidegraph.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    p = cross_split.cross_split_pairs(table(spark, d, "reviews"), table(spark, d, "splits"))
    return p.select(F.col("id_a").alias("node_key_a"), F.col("id_b").alias("node_key_b"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    r, s = table(spark, d, "reviews"), table(spark, d, "splits")
    return cross_split.overlap_counts(cross_split.cross_split_pairs(r, s), r, s)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = near_duplicates.near_duplicate_pairs(table(spark, d, "reviews"), "review_id", "text")
    return p.select(F.col("id_a").alias("review_id_a"), F.col("id_b").alias("review_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, d, "reviews"), "review_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.reviewer_groups(table(spark, d, "account_links"), table(spark, d, "ring_candidates"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return components.group_summary(table(spark, d, "account_links"), table(spark, d, "ring_candidates"))


#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p8_packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("leaked").select("doc_id", "item_id")


def p9_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).filter("overlap >= least(13, n_words)")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leaks.leak_report(leaks.find_leaks(table(spark, d, "documents"), items), items)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    slots = abuse.slot_table(table(spark, d, "documents"), keep=("source",))
    return abuse.score_documents(slots, abuse.fit(slots, table(spark, d, "doc_labels")), keep=("source",))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "score", "n_tokens", "n_passages", "flagged")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(_scored(spark, d))


_ALL = (p4_found, p4_counts, p5_found, p5_groups, p6_found, p6_groups, p8_packed, p8_report, p9_found, p9_overlaps, p9_report, p10_found, p10_scores, p10_rates)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: The smallest reviewer that can be reached, over links from pairs and from each list's first member.
_GROUPS = """m AS (SELECT list_sort(list_distinct(list_filter(members, lambda x: x IS NOT NULL))) AS m FROM ring_candidates WHERE members IS NOT NULL),
    l AS (SELECT reviewer_a AS a, reviewer_b AS b FROM account_links WHERE shared_targets >= 2 AND reviewer_a <> reviewer_b
      UNION SELECT m[1], unnest(m[2:]) FROM m WHERE len(m) > 1),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r(v, u) AS (SELECT a, a FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
    g AS (SELECT v AS reviewer_id, min(u) AS group_id FROM r GROUP BY 1)"""


def _near(texts: str) -> str:
    """Pairs (x, y) of texts (id, side, text) that are near-duplicates: word sets by class, rarest words first, the first
    words of each up to the place at which the first shared one must stand, then the exact overlap."""
    return f"""t AS (SELECT DISTINCT id, side, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM ({texts})),
    k AS (SELECT w, min(id) AS c, len(w) AS n FROM t WHERE len(w) >= 12 GROUP BY 1), v AS (SELECT c, n, unnest(w) AS word FROM k), f AS (SELECT word, count(*) AS f FROM v GROUP BY 1),
    p AS (SELECT c, n, word, row_number() OVER (PARTITION BY c ORDER BY f, word) AS rn FROM v JOIN f USING (word)), q AS (SELECT c, n, word FROM p WHERE rn <= n - ceil(0.7 * n - 1e-9) + 1),
    m AS (SELECT DISTINCT a.c AS a, b.c AS b FROM q a JOIN q b ON a.word = b.word AND a.c < b.c AND least(a.n, b.n) >= 0.7 * greatest(a.n, b.n) - 1e-9),
    o AS (SELECT a, b, x.n + y.n AS n, len(list_intersect(x.w, y.w)) AS i FROM m JOIN k x ON x.c = a JOIN k y ON y.c = b),
    z AS (SELECT a, b FROM o WHERE i >= 0.7 * (n - i) - 1e-9), every AS (SELECT a, b FROM z UNION ALL SELECT b, a FROM z UNION ALL SELECT c, c FROM k)
    SELECT DISTINCT i.id AS x, j.id AS y, i.side AS sx, j.side AS sy FROM every JOIN k p ON p.c = a JOIN t i ON i.w = p.w JOIN k q ON q.c = b JOIN t j ON j.w = q.w WHERE i.id < j.id"""


_SPLIT_TEXTS = "SELECT review_id AS id, side, text FROM reviews JOIN (SELECT node_key, bit_or(CASE WHEN role = 'train' THEN 1 ELSE 2 END) AS side FROM splits WHERE role IN ('train', 'validation', 'calibration', 'test') GROUP BY 1) ON node_key = review_id WHERE text IS NOT NULL"
_P4 = f"WITH pr AS (WITH {_near(_SPLIT_TEXTS)}), f AS (SELECT DISTINCT x, y FROM pr WHERE (sx & 1 = 1 AND sy & 2 = 2) OR (sx & 2 = 2 AND sy & 1 = 1))"

#: SQL that takes minutes on larger tables; only tests run it.
SLOW_SQL: dict[str, str] = {
    "p5_found": f"WITH pr AS (WITH {_near('SELECT review_id AS id, 3 AS side, text FROM reviews WHERE text IS NOT NULL AND review_id IS NOT NULL')}) SELECT DISTINCT x AS review_id_a, y AS review_id_b FROM pr",
}
SQL: dict[str, str] = {
    "p4_found": f"{_P4} SELECT x AS node_key_a, y AS node_key_b FROM f",
    "p4_counts": f"""{_P4}, n AS (SELECT x AS id, x, y FROM f UNION ALL SELECT y, x, y FROM f), r AS (SELECT DISTINCT node_key AS id, role FROM splits WHERE role IN ('validation', 'calibration', 'test')), s AS (SELECT review_id AS id, min(source) AS source FROM reviews GROUP BY 1)
    SELECT role, source, count(DISTINCT id) AS n_records, count(DISTINCT (x, y)) AS n_pairs FROM n JOIN r USING (id) LEFT JOIN s USING (id) GROUP BY 1, 2""",
    "p6_found": f"WITH RECURSIVE {_GROUPS} SELECT reviewer_id, group_id FROM g",
    "p6_groups": f"""WITH RECURSIVE {_GROUPS}, c AS (SELECT DISTINCT candidate_id, unnest(members) AS reviewer_id FROM ring_candidates), k AS (SELECT group_id, count(DISTINCT candidate_id) AS n FROM c JOIN g USING (reviewer_id) GROUP BY 1)
    SELECT g.group_id, count(*) AS n_reviewers, cast(coalesce(max(k.n), 0) AS BIGINT) AS components_merged FROM g LEFT JOIN k USING (group_id) GROUP BY 1""",
}
