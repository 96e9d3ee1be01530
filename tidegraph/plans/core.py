"""Queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import asof, eager, evaluation, fusion, graph, history, ingest, rings, rolling
from tidegraph.sources.tables import event_reviews, micros, order_reviews, scored_events, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where it has one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return ingest.rejected_lines(table(spark, d, "raw_feed"))


@query()
def p1_audit(spark: SparkSession, d: str) -> DataFrame:
    return ingest.reconcile(table(spark, d, "raw_feed"), table(spark, d, "ingest_audits"))


@query()
def p1_accepted(spark: SparkSession, d: str) -> DataFrame:
    return ingest.accepted_reviews(table(spark, d, "raw_feed"))


@query(
    """WITH r AS (SELECT DISTINCT review_id, reviewer_id, epoch_us(timestamp) us FROM reviews),
    e AS (SELECT DISTINCT e.src, e.dst, d.us, s.reviewer_id FROM edges e JOIN r d ON d.review_id = e.dst JOIN r s ON s.review_id = e.src
          WHERE e.available_at IS NOT NULL AND d.us IS NOT NULL AND e.available_at * 1000000 <= d.us),
    m AS (SELECT e.src, e.dst, p.version_id, row_number() OVER (PARTITION BY e.src, e.dst ORDER BY p.valid_from DESC, p.available_at DESC, p.version_id DESC) rn
          FROM e JOIN reviewer_profiles p ON p.reviewer_id = e.reviewer_id AND epoch_us(p.valid_from) <= e.us AND p.available_at * 1000000 <= e.us)
    SELECT src, dst, version_id FROM m WHERE rn = 1"""
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    j = asof.edges_as_known(table(spark, d, "edges"), table(spark, d, "reviews"), table(spark, d, "reviewer_profiles"))
    return j.select("src", "dst", "version_id").distinct()


@query(
    """WITH k AS (SELECT 'reviewer_id' AS key_field, reviewer_id AS key_value FROM reviews UNION ALL SELECT 'target_id', target_id FROM reviews)
    SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM reviews)"""
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return eager.heavy_keys(table(spark, d, "reviews"), ["reviewer_id", "target_id"], 0.02)


@query(
    """WITH k AS (SELECT 'reviewer_id' AS key_field, reviewer_id AS key_value, rating FROM reviews UNION ALL SELECT 'target_id', target_id, rating FROM reviews)
    SELECT key_field, key_value, count(*) AS n_rows, count(rating) AS n_measured, round(avg(rating), 6) AS mean_rating FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2"""
)
def p3_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return eager.key_stats(table(spark, d, "reviews"), ["reviewer_id", "target_id"], "rating")


@query(
    """WITH k AS (SELECT 'reviewer_id' AS key_field, reviewer_id AS key_value, strftime(timestamp AT TIME ZONE 'UTC', '%Y-%m') AS month, rating FROM reviews WHERE timestamp IS NOT NULL
      UNION ALL SELECT 'target_id', target_id, strftime(timestamp AT TIME ZONE 'UTC', '%Y-%m'), rating FROM reviews WHERE timestamp IS NOT NULL),
    s AS (SELECT key_field, key_value, month, count(*) AS n_rows, round(avg(rating), 6) AS mean_rating FROM k WHERE key_value IS NOT NULL GROUP BY 1, 2, 3)
    SELECT *, cast(sum(n_rows) OVER (PARTITION BY key_field, key_value ORDER BY month) AS BIGINT) AS n_so_far FROM s"""
)
def p3_key_history(spark: SparkSession, d: str) -> DataFrame:
    return eager.key_history(table(spark, d, "reviews"), ["reviewer_id", "target_id"], "timestamp", "rating")


@query(
    """SELECT r.target_id, s.role, count(*) AS n_rows, count(r.rating) AS n_measured, round(avg(r.rating), 6) AS mean_rating
    FROM reviews r JOIN splits s ON s.node_key = r.review_id WHERE r.target_id IS NOT NULL AND s.role IS NOT NULL GROUP BY 1, 2"""
)
def p3_target_roles(spark: SparkSession, d: str) -> DataFrame:
    return eager.eager_join_aggregate(table(spark, d, "reviews"), table(spark, d, "splits"), "review_id", "node_key", ["target_id"], ["role"], "rating")


@query(
    """SELECT x.source, cast(sum(k.n) AS BIGINT) AS n_rows, cast(sum(CASE WHEN x.rating IS NOT NULL THEN k.n ELSE 0 END) AS BIGINT) AS n_measured, round(sum(x.rating * k.n) / sum(CASE WHEN x.rating IS NOT NULL THEN k.n END), 6) AS mean_rating
    FROM reviews x JOIN (SELECT reviewer_id, count(*) AS n FROM reviews WHERE reviewer_id IS NOT NULL GROUP BY 1) k USING (reviewer_id) WHERE x.source IS NOT NULL GROUP BY 1"""
)
def p3_hot_join(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of reviews of one reviewer, counted and averaged by source: a join whose key is hot on both sides."""
    return eager.target_pairs(table(spark, d, "reviews"), "reviewer_id", "source", "rating")


_ROLLING = """r AS (SELECT review_id, reviewer_id, cast(timestamp AT TIME ZONE 'UTC' AS date) AS day, max(rating) AS rating FROM reviews WHERE reviewer_id IS NOT NULL AND timestamp IS NOT NULL GROUP BY 1, 2, 3),
    f AS (SELECT reviewer_id, min(day) AS a FROM r GROUP BY 1),
    g AS (SELECT reviewer_id, cast(unnest(generate_series(a, DATE '2024-12-31', INTERVAL 1 DAY)) AS date) AS day FROM f),
    y AS (SELECT reviewer_id, day, count(*) AS n, count(rating) AS m, sum(rating) AS t FROM r GROUP BY 1, 2),
    z AS (SELECT g.reviewer_id, g.day, coalesce(y.n, 0) AS n, coalesce(y.m, 0) AS m, coalesce(y.t, 0) AS t FROM g LEFT JOIN y USING (reviewer_id, day)),
    w AS (SELECT reviewer_id, day, sum(n) OVER a AS n7, sum(m) OVER a AS m7, sum(t) OVER a AS t7, sum(n) OVER b AS n30, sum(m) OVER b AS m30, sum(t) OVER b AS t30 FROM z
      WINDOW a AS (PARTITION BY reviewer_id ORDER BY day ROWS 6 PRECEDING), b AS (PARTITION BY reviewer_id ORDER BY day ROWS 29 PRECEDING))"""


@query(f"WITH {_ROLLING} SELECT reviewer_id, strftime(day, '%Y-%m-%d') AS day FROM w WHERE day >= DATE '2023-02-01' AND n7 >= 5 AND n7 >= 0.75 * n30")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.burst_days(table(spark, d, "reviews"), "reviewer_id", "timestamp", "review_id", "rating")


@query(
    f"""WITH {_ROLLING} SELECT reviewer_id, strftime(day, '%Y-%m-%d') AS day, cast(n7 AS BIGINT) AS n_7d, round(t7, 6) AS total_7d, round(t7 / nullif(m7, 0), 6) AS mean_7d,
    cast(n30 AS BIGINT) AS n_30d, round(t30, 6) AS total_30d, round(t30 / nullif(m30, 0), 6) AS mean_30d FROM w"""
)
def p7_daily(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_daily(table(spark, d, "reviews"), "reviewer_id", "timestamp", "review_id", "rating", last_day="2024-12-31")


def top_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Ten reviewers with most events within 24 hours before one of theirs."""
    from pyspark.sql import Window

    w = Window.partitionBy("reviewer_id").orderBy("us").rangeBetween(-86_400_000_000, -1)
    e = event_reviews(spark, d).select("reviewer_id", F.count("*").over(w).alias("n"))
    return e.groupBy("reviewer_id").agg(F.max("n").alias("largest_burst_24h")).orderBy(F.desc("largest_burst_24h"), "reviewer_id").limit(10)


# -- the operators of the review engine, over events (dense), orders (many ties) and reviews -----------------------------

_EV = "ev AS (SELECT event_id AS review_id, user_id AS reviewer_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS target_id, epoch_us(ts) AS us, cast(1 + event_id % 5 AS DOUBLE) AS rating, event_type, value FROM events)"
_OR = "orr AS (SELECT o_orderkey AS review_id, o_custkey AS reviewer_id, p AS target_id, epoch_us(cast(o_orderdate AS TIMESTAMP)) AS us, cast(1 + o_orderkey % 5 AS DOUBLE) AS rating FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
_SC = f"{_EV}, sc AS (SELECT review_id, reviewer_id, target_id, us, (cast(floor(value * 100) AS BIGINT) % 1000 + 1000) % 1000 / 1000.0 AS score, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN NULL ELSE 0 END AS label FROM ev)"
_MEMBERS = "mem AS (SELECT concat('c', target_id % 10) AS campaign_id, review_id FROM sc WHERE label = 1 AND score >= 0.5)"
_D = 86_400_000_000
_BOUNDS = "n AS (SELECT count(*) AS n FROM ev), k_ AS (SELECT review_id, us, row_number() OVER (ORDER BY us, review_id) AS rn, cast(floor(n * 0.6::DOUBLE) AS BIGINT) AS a, cast(floor(n * 0.15::DOUBLE) AS BIGINT) AS b, cast(floor(n * 0.1::DOUBLE) AS BIGINT) AS c FROM ev, n), sp AS (SELECT review_id, us, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'validation' WHEN rn <= a + b + c THEN 'calibration' ELSE 'test' END AS role FROM k_)"


def _past(view: str, key: str) -> str:
    return f"SELECT b.review_id AS id, b.us AS t, a.*, row_number() OVER (PARTITION BY b.review_id ORDER BY a.us DESC, a.review_id DESC) AS rn FROM x b JOIN {view} a ON a.{key} = b.{key} AND a.us < b.us"


#: Every pair of an event and an earlier one of its key, ranked from the latest; aggregates over the ranks up to 512.
_HIST = f"""g AS (SELECT *, CASE WHEN lag(us) OVER o >= us - {30 * _D} THEN (us - lag(us) OVER o) / 1e6 END AS gap_s FROM x WINDOW o AS (PARTITION BY reviewer_id ORDER BY us, review_id)),
    u AS (SELECT id, count_if(us >= t - {_D}) AS c1, count_if(us >= t - {7 * _D}) AS c7, count_if(us >= t - {30 * _D}) AS c30, count(DISTINCT target_id) FILTER (rn <= 512) AS d, avg(rating) FILTER (rn <= 512) AS m, least(count(*), 512) AS n, max(us) AS last FROM ({_past('x', 'reviewer_id')}) GROUP BY 1),
    v AS (SELECT id, count_if(us >= t - {_D}) AS c1, count_if(us >= t - {30 * _D}) AS c30, count(DISTINCT reviewer_id) FILTER (rn <= 512) AS d, avg(rating) FILTER (rn <= 512) AS m, max(us) FILTER (us >= t - {30 * _D}) AS last FROM ({_past('x', 'target_id')}) GROUP BY 1),
    k AS (SELECT id, count(*) AS n, avg(gap_s) FILTER (rn <= 512) AS m, stddev_pop(gap_s) FILTER (rn <= 512) AS s, max(gap_s) FILTER (rn = 1) AS last FROM ({_past('(SELECT * FROM g WHERE gap_s IS NOT NULL)', 'reviewer_id')}) GROUP BY 1),
    h AS (SELECT x.review_id, cast(coalesce(u.c1, 0) AS BIGINT) AS rev_count_1d, cast(coalesce(u.c7, 0) AS BIGINT) AS rev_count_7d, cast(coalesce(u.c30, 0) AS BIGINT) AS rev_count_30d, k.last AS last_gap_s,
      CASE WHEN k.n >= 2 THEN k.s END AS interarrival_std_s, CASE WHEN k.n >= 2 THEN k.m END AS interarrival_mean_s, coalesce(u.d, 0) AS prior_unique_targets, cast(coalesce(u.c30, 0) AS BIGINT) AS prior_reviews_31d,
      cast(coalesce(v.c30, 0) AS BIGINT) AS target_volume_prior, coalesce(v.d, 0) AS target_reviewer_volume_prior, (x.us - v.last) / 1e6 AS time_since_target_prev_s, x.rating - u.m AS rating_minus_reviewer_prior_mean,
      u.n AS reviewer_prior_rating_count, v.m AS target_prior_mean_rating, cast(coalesce(v.c1, 0) AS BIGINT) AS target_burst_24h, cast(coalesce(u.c1, 0) AS BIGINT) AS reviewer_burst_24h, (x.us - u.last) / 1e6 AS time_since_prev_s
      FROM x LEFT JOIN u ON u.id = x.review_id LEFT JOIN v ON v.id = x.review_id LEFT JOIN k ON k.id = x.review_id)"""
_DIGITS = {"last_gap_s": 3, "time_since_target_prev_s": 3, "time_since_prev_s": 3, "rating_minus_reviewer_prior_mean": 6, "target_prior_mean_rating": 6, "interarrival_std_s": 2}
_WHOLE = "review_id rev_count_1d rev_count_7d rev_count_30d prior_unique_targets prior_reviews_31d target_volume_prior target_reviewer_volume_prior reviewer_prior_rating_count target_burst_24h reviewer_burst_24h".split()
_HIST_OUT = f"SELECT {', '.join(_WHOLE)}, {', '.join(f'round({c}, {n}) AS {c}' for c, n in _DIGITS.items())}, floor(interarrival_mean_s * 1000 + 1e-4) / 1000 AS interarrival_mean_s FROM h"
_RV = "rv AS (SELECT review_id, reviewer_id, target_id, epoch_us(timestamp) AS us, max(rating) AS rating FROM reviews WHERE reviewer_id IS NOT NULL AND target_id IS NOT NULL AND timestamp IS NOT NULL AND review_id IS NOT NULL GROUP BY 1, 2, 3, 4)"


def _rounded_history(reviews: DataFrame) -> DataFrame:
    # means lie on halves of the last digit too often to round them alike in two engines
    mean = F.floor(F.col("interarrival_mean_s") * 1000 + 1e-4) / 1000
    return history.history(reviews).select(*_WHOLE, *(F.round(c, n).alias(c) for c, n in _DIGITS.items()), mean.alias("interarrival_mean_s"))


def log_reviews(spark: SparkSession, d: str) -> DataFrame:
    """The reviews as a log: one row for each review with author, target and time."""
    r = table(spark, d, "reviews").select("review_id", "reviewer_id", "target_id", micros("timestamp").alias("us"), "rating").filter("review_id is not null and reviewer_id is not null and target_id is not null and us is not null")
    return r.groupBy("review_id", "reviewer_id", "target_id", "us").agg(F.max("rating").alias("rating"))


@query(f"WITH {_EV}, x AS (SELECT * FROM ev), {_HIST} {_HIST_OUT}")
def hist_features(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_history(event_reviews(spark, d))


@query(f"WITH {_OR}, x AS (SELECT * FROM orr), {_HIST} {_HIST_OUT}")
def hist_features_ties(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_history(order_reviews(spark, d))


@query(f"WITH {_RV}, x AS (SELECT * FROM rv), {_HIST} {_HIST_OUT}")
def hist_features_reviews(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_history(log_reviews(spark, d))


_NAMES = history.COUNTS + history.SECONDS + history.SIGNED
def scaled_column(n: str) -> str:
    return f"round(CASE WHEN c_{n} < 2 THEN coalesce(z.{n}, 0) ELSE coalesce((z.{n} - m_{n}) / greatest(CASE WHEN w_{n} > 0 THEN w_{n} / 1.349 ELSE s_{n} END, 1e-6), 0) END, 5) AS {n}"


_SCALED = ", ".join(map(scaled_column, _NAMES))


def _scaled_sql(columns: str) -> str:
    logged = ", ".join(f"ln(1 + greatest(cast({n} AS DOUBLE), 0)) AS {n}" if n not in history.SIGNED else n for n in _NAMES)
    stats = ", ".join(f"quantile_cont({n}, 0.5) AS m_{n}, quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25) AS w_{n}, stddev_pop({n}) AS s_{n}, count({n}) AS c_{n}" for n in _NAMES)
    return f"WITH {_EV}, x AS (SELECT * FROM ev), {_HIST}, {_BOUNDS}, z AS (SELECT review_id, {logged} FROM h), q AS (SELECT {stats} FROM z JOIN sp USING (review_id) WHERE role = 'train') SELECT z.review_id, {columns} FROM z, q"


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    r = event_reviews(spark, d)
    return history.scale(history.history(r), evaluation.chronological_split(r).filter("role = 'train'"))


@query(_scaled_sql(_SCALED))
def hist_scaled(spark: SparkSession, d: str) -> DataFrame:
    s = _scaled(spark, d)
    return s.select("review_id", *(F.round(n, 5).alias(n) for n in _NAMES))


def _edges_sql(view: str, key: str, days: int, most: int, relation: str) -> str:
    return f"""SELECT src, dst, relation, available_at FROM (SELECT a.review_id AS src, b.review_id AS dst, '{relation}' AS relation, a.us // 1000000 AS available_at,
    row_number() OVER (PARTITION BY b.review_id ORDER BY a.us // 1000000 DESC, a.review_id DESC) AS rn FROM {view} a JOIN {view} b ON a.{key} = b.{key} AND a.us // 1000000 < b.us // 1000000 AND a.us // 1000000 >= b.us // 1000000 - {days * 86400}) WHERE rn <= {most}"""


@query(f"WITH {_EV} {_edges_sql('ev', 'reviewer_id', 30, 10, 'same_reviewer')}")
def edges_same_reviewer(spark: SparkSession, d: str) -> DataFrame:
    return graph.same_reviewer_edges(event_reviews(spark, d))


@query(f"WITH {_EV} {_edges_sql('ev', 'target_id', 7, 20, 'same_target')}")
def edges_same_target(spark: SparkSession, d: str) -> DataFrame:
    return graph.same_target_edges(event_reviews(spark, d))


@query(
    f"""WITH {_RV}, s AS (SELECT review_id, reviewer_id, target_id, us // 1000000 AS sec FROM rv),
    t AS (SELECT b.review_id AS dst, b.reviewer_id, b.sec AS t, a.target_id, max(a.sec) AS l FROM s a JOIN s b ON a.reviewer_id = b.reviewer_id AND a.sec < b.sec GROUP BY 1, 2, 3, 4),
    m AS (SELECT * FROM t WHERE l >= t - 2592000),
    o AS (SELECT m.dst, m.t, m.target_id, a.reviewer_id AS other, max(a.sec) AS l FROM m JOIN s a ON a.target_id = m.target_id AND a.sec < m.t AND a.reviewer_id <> m.reviewer_id GROUP BY 1, 2, 3, 4),
    k AS (SELECT dst, t, other, count(*) AS c FROM o WHERE l >= t - 2592000 GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY c DESC, other) AS rn FROM k)
    SELECT arg_max(s.review_id, struct_pack(a := s.sec, b := s.review_id)) AS src, r.dst, 'co_target' AS relation, max(s.sec) AS available_at FROM r JOIN s ON s.reviewer_id = r.other AND s.sec < r.t WHERE rn <= 10 GROUP BY r.dst, r.other"""
)
def edges_co_target(spark: SparkSession, d: str) -> DataFrame:
    return graph.co_target_edges(log_reviews(spark, d))


@query("SELECT relation, count(*) AS n_edges, count(DISTINCT dst) AS n_dst, min(available_at) AS first_at, max(available_at) AS last_at FROM edges GROUP BY 1")
def edge_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_stats(table(spark, d, "edges"))


@query("SELECT review_id, coalesce(n, 0) AS in_degree, coalesce(n, 0) > 0 AS available FROM (SELECT DISTINCT review_id FROM reviews) LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) ON dst = review_id")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.in_degree(table(spark, d, "reviews").select("review_id").distinct(), table(spark, d, "edges"))


@query("SELECT DISTINCT relation, src, dst FROM (SELECT relation, src, dst FROM edges UNION ALL SELECT relation, dst, src FROM edges)")
def binary_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return graph.binary_adjacency(table(spark, d, "edges"))


@query(
    """WITH s AS (SELECT DISTINCT node_key FROM splits WHERE role = 'test'), e AS (SELECT DISTINCT src, dst, relation FROM edges),
    a AS (SELECT e.*, 1 AS hop FROM e WHERE dst IN (SELECT node_key FROM s)), b AS (SELECT e.*, 2 AS hop FROM e WHERE dst IN (SELECT src FROM a WHERE src IS NOT NULL))
    SELECT src, dst, relation, min(hop) AS hop FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3"""
)
def two_hop_field(spark: SparkSession, d: str) -> DataFrame:
    return graph.upstream(table(spark, d, "edges"), table(spark, d, "splits").filter("role = 'test'").select(F.col("node_key").alias("review_id")))


@query(
    f"""WITH {_EV}, e AS ({_edges_sql('ev', 'target_id', 7, 20, 'same_target')}), p AS (SELECT relation, src, dst, row_number() OVER (PARTITION BY relation, dst ORDER BY src) - 1 AS pos, count(*) OVER (PARTITION BY relation, dst) AS deg FROM (SELECT DISTINCT relation, src, dst FROM e)),
    w AS (SELECT DISTINCT relation, dst, cast(concat('0x', substr(md5(concat_ws('|', '42', relation, cast(dst AS VARCHAR), cast(i AS VARCHAR))), 1, 8)) AS BIGINT) % deg AS pos FROM (SELECT DISTINCT relation, dst, deg FROM p WHERE deg > 10), range(1, 11) r(i))
    SELECT relation, src, dst FROM p WHERE deg <= 10 UNION ALL SELECT relation, src, dst FROM p JOIN w USING (relation, dst, pos) WHERE deg > 10"""
)
def sampled_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.sample_neighbours(graph.same_target_edges(event_reviews(spark, d)))


_SEM = """SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(cast(a.embedding AS DOUBLE[]), cast(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id"""


@query(f"SELECT src, dst, cosine FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY cosine DESC, src) AS rn FROM ({_SEM}) WHERE cosine >= 0.2) WHERE rn <= 5")
def edges_semantic(spark: SparkSession, d: str) -> DataFrame:
    return graph.semantic_edges(table(spark, d, "embeddings"), "vec_id", "label", "vec_id", "embedding", 0.2, 5)


@query("WITH p AS (SELECT DISTINCT reviewer_id, target_id FROM reviews WHERE reviewer_id IS NOT NULL AND target_id IS NOT NULL) SELECT x.reviewer_id AS a, y.reviewer_id AS b, count(*) AS shared, 2 * count(*) - 1 AS weight FROM p x JOIN p y ON x.target_id = y.target_id AND x.reviewer_id < y.reviewer_id GROUP BY 1, 2 HAVING count(*) >= 2")
def ring_projection(spark: SparkSession, d: str) -> DataFrame:
    return graph.shared_target_pairs(table(spark, d, "reviews"))


@query()
def ring_candidates_scored(spark: SparkSession, d: str) -> DataFrame:
    return rings.ring_table(scored_events(spark, d)).select("component", F.size("members").alias("n_members"), F.size("targets").alias("n_targets"), "mean_top_score", "raw_overlap", "size_ref_mean", "adjusted_overlap", "synchrony", "priority")


@query(f"WITH {_EV}, d AS (SELECT target_id, us // {_D} AS day, count(*) AS n FROM ev GROUP BY 1, 2), w AS (SELECT target_id, n, sum(n) OVER (PARTITION BY target_id ORDER BY day RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING) AS s FROM d) SELECT target_id, round(max(s) / sum(n), 6) AS synchrony FROM w GROUP BY 1")
def ring_synchrony(spark: SparkSession, d: str) -> DataFrame:
    return rings.synchrony(event_reviews(spark, d), "target_id")




@query(f"WITH {_EV}, {_BOUNDS} SELECT review_id, us, role FROM sp")
def split_chrono(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.chronological_split(event_reviews(spark, d))


@query(f"WITH {_EV}, {_BOUNDS} SELECT role, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM sp GROUP BY 1")
def split_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.split_cutoffs(evaluation.chronological_split(event_reviews(spark, d)))


@query(f"WITH {_SC}, u AS (SELECT review_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', cast(label AS VARCHAR), cast(review_id AS VARCHAR))), review_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM sc) SELECT review_id, label, CASE WHEN label IS NULL THEN 'excluded' WHEN rn <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.6::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation' WHEN rn <= floor(n * 0.6::DOUBLE) + floor(n * 0.15::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'calibration' ELSE 'test' END AS role FROM u")
def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.stratified_split(scored_events(spark, d), "review_id", "label")


def _members(s: DataFrame) -> DataFrame:
    return s.filter("label = 1 and score >= 0.5").select(F.concat(F.lit("c"), (F.col("target_id") % 10).cast("string")).alias("campaign_id"), "review_id")


@query(f"WITH {_SC}, {_MEMBERS}, {_BOUNDS} SELECT campaign_id, count(DISTINCT role) AS n_roles, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM mem JOIN sp USING (review_id) GROUP BY 1 HAVING count(DISTINCT role) > 1")
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.leak_check(_members(scored_events(spark, d)), evaluation.chronological_split(event_reviews(spark, d)))


_CURVE = f"{_SC}, g AS (SELECT score, sum(label) AS p, count(*) AS n FROM sc WHERE label IS NOT NULL GROUP BY 1), cu AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS m, sum(p) OVER () AS pos, sum(n) OVER () AS al FROM g WINDOW o AS (ORDER BY score DESC))"


@query(f"WITH {_CURVE} SELECT score, cast(tp AS BIGINT) AS tp, cast(m - tp AS BIGINT) AS fp, round(tp / m, 6) AS precision, round(tp / pos, 6) AS recall FROM cu")
def pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.curve(scored_events(spark, d)).select("score", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(
    f"""WITH {_CURVE} SELECT cast(max(al) AS BIGINT) AS n, cast(max(pos) AS BIGINT) AS n_positive, round(sum(p * tp / m) / max(pos), 6) AS average_precision,
    round(sum((n - p) * (tp - p) + (n - p) * p / 2) / (max(pos) * (max(al) - max(pos))), 6) AS roc_auc, round(sum(p * (1 - score) ^ 2 + (n - p) * score ^ 2) / max(al), 6) AS brier,
    round(max(CASE WHEN score >= 0.5 THEN m END) * 0 + 2 * max(CASE WHEN score >= 0.5 THEN tp END) / (max(CASE WHEN score >= 0.5 THEN m END) + max(pos)), 6) AS f1_at_half, round(max(2 * tp / (m + pos)), 6) AS best_f1,
    arg_min(score, struct_pack(a := -round(2 * tp / (m + pos), 12), b := score)) AS best_threshold, round(max(pos) / max(al), 6) AS prevalence FROM cu"""
)
def metric_ranking(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.ranking_summary(scored_events(spark, d))


@query(f"WITH {_SC}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, review_id) AS rn FROM sc WHERE label IS NOT NULL) SELECT k, round(sum(label) / count(*), 6) AS precision, round(sum(label) / (SELECT sum(label) FROM r), 6) AS recall FROM r, (VALUES (10), (100), (500)) v(k) WHERE rn <= k GROUP BY k")
def metric_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.at_k(scored_events(spark, d), (10, 100, 500))


@query(f"WITH {_SC}, b AS (SELECT least(cast(floor(score * 10) AS INT), 9) AS bin, score, label FROM sc WHERE label IS NOT NULL) SELECT cast(range AS INT) AS bin, count(score) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS rate FROM range(10) LEFT JOIN b ON b.bin = range GROUP BY 1")
def metric_reliability(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.reliability(scored_events(spark, d))


@query("WITH a AS (SELECT DISTINCT candidate_id AS p, unnest(members) AS member FROM ring_candidates), b AS (SELECT DISTINCT run_id AS t, reviewer_a AS member FROM account_links), s AS (SELECT p, t, count(*) AS c FROM a JOIN b USING (member) GROUP BY 1, 2) SELECT p, t, round(c / (na + nb - c), 6) AS iou FROM s JOIN (SELECT p, count(*) AS na FROM a GROUP BY 1) USING (p) JOIN (SELECT t, count(*) AS nb FROM b GROUP BY 1) USING (t)")
def iou_matrix(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "ring_candidates").select(F.col("candidate_id").alias("p"), F.explode("members").alias("member"))
    return evaluation.iou_pairs(p, table(spark, d, "account_links").select(F.col("run_id").alias("t"), F.col("reviewer_a").alias("member")))


_RP = f"{_SC}, {_MEMBERS}, s AS (SELECT review_id, strftime(make_timestamp(us), '%Y-%m-%d') AS day, score FROM sc)"


@query(f"WITH {_RP}, p AS (SELECT day, count(*) AS a, count_if(score >= 0.9) AS b FROM s JOIN mem USING (review_id) GROUP BY 1) SELECT day, count(*) AS n_scored, cast(count_if(score >= 0.9) AS BIGINT) AS alerts, coalesce(max(a), 0) AS planted_scored, cast(coalesce(max(b), 0) AS BIGINT) AS planted_alerted FROM s LEFT JOIN p USING (day) GROUP BY 1")
def replay_daily(spark: SparkSession, d: str) -> DataFrame:
    s = scored_events(spark, d)
    return evaluation.replay_daily(s, _members(s), 0.9)


_DELAY = f"{_RP}, dl AS (SELECT campaign_id, min(day) AS first_day, min(CASE WHEN score >= 0.9 THEN day END) AS alert_day FROM s JOIN mem USING (review_id) GROUP BY 1)"


@query(f"WITH {_DELAY} SELECT *, date_diff('day', cast(first_day AS DATE), cast(alert_day AS DATE)) AS delay_days FROM dl")
def replay_delay(spark: SparkSession, d: str) -> DataFrame:
    s = scored_events(spark, d)
    return evaluation.replay_delay(s, _members(s), 0.9)


@query(f"WITH {_DELAY} SELECT h AS horizon, round(count_if(date_diff('day', cast(first_day AS DATE), cast(alert_day AS DATE)) <= h) / count(*), 6) AS recall FROM dl, (VALUES (1), (7), (30)) v(h) GROUP BY 1")
def replay_horizons(spark: SparkSession, d: str) -> DataFrame:
    s = scored_events(spark, d)
    return evaluation.replay_horizons(evaluation.replay_delay(s, _members(s), 0.9))


@query(f"WITH {_SC} SELECT cast(count_if(label = 1) AS BIGINT) AS n_positive, cast(count_if(label = 0) AS BIGINT) AS n_negative, round(least(count_if(label = 0) / count_if(label = 1), 100), 6) AS pos_weight FROM sc")
def pos_weight(spark: SparkSession, d: str) -> DataFrame:
    return fusion.class_weight(scored_events(spark, d))


def _experts(spark: SparkSession, d: str) -> DataFrame:
    s = scored_events(spark, d)
    return s.select("review_id", F.when(F.col("review_id") % 3 > 0, F.col("score")).alias("a"), F.when(F.col("review_id") % 4 > 0, 1 - F.col("score")).alias("b"), F.when(F.col("review_id") % 5 > 0, F.lit(0.5)).alias("c"))


@query(f"WITH {_SC}, x AS (SELECT review_id, CASE WHEN review_id % 3 > 0 THEN score END AS a, CASE WHEN review_id % 4 > 0 THEN 1 - score END AS b, CASE WHEN review_id % 5 > 0 THEN 0.5 END AS c FROM sc) SELECT review_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS fused FROM x")
def fixed_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _experts(spark, d).select("review_id", F.round(fusion.mean_available(["a", "b", "c"]), 6).alias("fused"))


@query(f"WITH {_SC}, x AS (SELECT review_id, CASE WHEN review_id % 3 > 0 THEN exp(score) ELSE 0 END AS a, CASE WHEN review_id % 4 > 0 THEN exp(1 - score) ELSE 0 END AS b, CASE WHEN review_id % 5 > 0 THEN exp(0.5) ELSE 0 END AS c FROM sc) SELECT review_id, round(a / nullif(a + b + c, 0), 6) AS wa, round(b / nullif(a + b + c, 0), 6) AS wb, round(c / nullif(a + b + c, 0), 6) AS wc FROM x")
def masked_softmax(spark: SparkSession, d: str) -> DataFrame:
    e = _experts(spark, d)
    w = fusion.masked_softmax(["a", "b", "c"], [F.col(x).isNotNull() for x in "abc"])
    return e.select("review_id", *(F.round(x, 6).alias(n) for x, n in zip(w, ("wa", "wb", "wc"))))


@query()
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    s = scored_events(spark, d)
    return fusion.calibrate(s, *fusion.fit_platt(s)).select("review_id", F.round("calibrated", 6).alias("calibrated"))


@query(
    """WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents WHERE text IS NOT NULL),
    t AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS term FROM w), tf AS (SELECT id, term, count(*) AS tf FROM t GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term))
    SELECT id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS weight FROM x"""
)
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return fusion.tfidf(table(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


@query("SELECT sha256(coalesce(text, '')) AS fingerprint, count(DISTINCT review_id) AS n_reviews, count(*) AS n_rows FROM reviews GROUP BY 1")
def content_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reviews").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), "review_id")
    return r.groupBy("fingerprint").agg(F.count_distinct("review_id").alias("n_reviews"), F.count("*").alias("n_rows"))


@query("SELECT count(*) AS n_rows, count(DISTINCT review_id) AS n_reviews, count(DISTINCT reviewer_id) AS n_reviewers, count(DISTINCT target_id) AS n_targets, epoch_us(min(timestamp)) AS first_us, epoch_us(max(timestamp)) AS last_us FROM reviews")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").agg(F.count("*").alias("n_rows"), F.count_distinct("review_id").alias("n_reviews"), F.count_distinct("reviewer_id").alias("n_reviewers"), F.count_distinct("target_id").alias("n_targets"), F.unix_micros(F.min("timestamp")).alias("first_us"), F.unix_micros(F.max("timestamp")).alias("last_us"))


@query(
    """SELECT cast(count_if(review_id IS NULL) AS BIGINT) AS null_ids, count(*) - count(DISTINCT review_id) AS repeated_ids, cast(count_if(rating < 1 OR rating > 5) AS BIGINT) AS bad_ratings,
    cast(count_if((text IS NULL OR trim(text) = '') <> coalesce(text_missing, false)) AS BIGINT) AS wrong_flags FROM reviews"""
)
def validation_report(spark: SparkSession, d: str) -> DataFrame:
    blank = F.col("text").isNull() | (F.trim("text") == "")
    return table(spark, d, "reviews").agg(F.count_if(F.col("review_id").isNull()).alias("null_ids"), (F.count("*") - F.count_distinct("review_id")).alias("repeated_ids"), F.count_if((F.col("rating") < 1) | (F.col("rating") > 5)).alias("bad_ratings"), F.count_if(blank != F.coalesce("text_missing", F.lit(False))).alias("wrong_flags"))
