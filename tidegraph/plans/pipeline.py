"""Queries over the tables between the engine's operators, with their SQL twins: roles, labels, runs, rings, fusion, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import campaigns, evaluation, experts, explain, fusion, graph, history, records, rings, simulate
from tidegraph.plans.core import _BOUNDS, _D, _DELAY, _EV, _HIST, _MEMBERS, _SC, _members, _scaled, _scaled_sql, event_reviews, log_reviews, query, scaled_column
from tidegraph.sources.tables import scored_events, table

_ROLES = "CASE role WHEN 'train' THEN 1 WHEN 'validation' THEN 2 WHEN 'calibration' THEN 3 WHEN 'test' THEN 4 END"


# -- roles, labels, runs -----------------------------------------------------------------------------------------------


@query("SELECT r.review_id, coalesce(s.role, 'train') AS role FROM (SELECT DISTINCT review_id FROM reviews) r LEFT JOIN (SELECT node_key, min(role) AS role FROM splits GROUP BY 1) s ON s.node_key = r.review_id")
def review_roles(spark: SparkSession, d: str) -> DataFrame:
    return records.with_roles(table(spark, d, "reviews").select("review_id").distinct(), table(spark, d, "splits"))


@query("SELECT role, count(*) AS n_rows, count(DISTINCT node_key) AS n_nodes FROM splits GROUP BY 1")
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.role_counts(table(spark, d, "splits"))


@query("SELECT DISTINCT node_key AS review_id FROM splits WHERE role = 'test' AND node_key IS NOT NULL")
def test_nodes(spark: SparkSession, d: str) -> DataFrame:
    return records.role_nodes(table(spark, d, "splits"), "test")


_AL = "a AS (SELECT DISTINCT review_id AS k FROM reviews), b AS (SELECT DISTINCT node_key AS k FROM splits), j AS (SELECT a.k AS l, b.k AS r FROM a FULL JOIN b ON a.k = b.k)"


@query(f"WITH {_AL} SELECT count_if(r IS NULL) AS left_only, count_if(l IS NULL) AS right_only, count_if(l IS NOT NULL AND r IS NOT NULL) AS both FROM j".replace("count_if(r IS NULL)", "cast(count_if(r IS NULL) AS BIGINT)").replace("count_if(l IS NULL)", "cast(count_if(l IS NULL) AS BIGINT)").replace("count_if(l IS NOT NULL AND r IS NOT NULL)", "cast(count_if(l IS NOT NULL AND r IS NOT NULL) AS BIGINT)"))
def aligned_tables(spark: SparkSession, d: str) -> DataFrame:
    return records.aligned(table(spark, d, "reviews"), table(spark, d, "splits").withColumnRenamed("node_key", "review_id"), "review_id")


@query(f"WITH {_AL} SELECT count(*) AS n_union, cast(count_if(l IS NOT NULL AND r IS NOT NULL) AS BIGINT) AS n_intersection, cast(count_if(r IS NULL) AS BIGINT) AS n_minus, cast(count_if(l IS NULL) AS BIGINT) AS n_reverse_minus FROM j")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    return records.id_sets(table(spark, d, "reviews"), table(spark, d, "splits").withColumnRenamed("node_key", "review_id"), "review_id")


@query("SELECT count(doc_id) - count(DISTINCT doc_id) AS repeated_ids, cast(count_if(coalesce(labeller, '') NOT IN ('unknown', 'human', 'platform', 'synthetic', 'benchmark')) AS BIGINT) AS bad_sources, cast(count_if(toxic IS NOT NULL AND toxic NOT IN (0, 1)) AS BIGINT) AS bad_labels FROM doc_labels")
def label_faults(spark: SparkSession, d: str) -> DataFrame:
    return records.label_faults(table(spark, d, "doc_labels").select(F.col("doc_id").alias("review_id"), F.col("toxic").alias("label"), F.col("labeller").alias("label_source")))


@query("SELECT count(review_id) - count(DISTINCT review_id) AS repeated_ids, count(*) - 1000 AS surplus_rows FROM reviews")
def prediction_faults(spark: SparkSession, d: str) -> DataFrame:
    return records.prediction_faults(table(spark, d, "reviews"), 1000)


@query("SELECT DISTINCT review_id, cast(NULL AS INTEGER) AS label, 'unknown' AS label_source, cast(NULL AS VARCHAR) AS campaign_id, false AS is_synthetic FROM reviews")
def background_labels(spark: SparkSession, d: str) -> DataFrame:
    return records.background_labels(table(spark, d, "reviews"))


@query(f"WITH {_SC} SELECT e.event_id AS review_id, s.label FROM events e LEFT JOIN (SELECT * FROM sc WHERE score >= 0.3) s ON s.review_id = e.event_id")
def joined_labels(spark: SparkSession, d: str) -> DataFrame:
    return records.with_labels(event_reviews(spark, d), scored_events(spark, d).filter("score >= 0.3")).select("review_id", "label")


@query(f"WITH {_SC}, {_MEMBERS}, {_BOUNDS} SELECT campaign_id, coalesce(arg_max(role, {_ROLES}), 'train') AS partition, count(DISTINCT role) AS n_roles, count(DISTINCT role) > 1 AS spanning FROM mem JOIN sp USING (review_id) GROUP BY 1")
def campaign_partitions(spark: SparkSession, d: str) -> DataFrame:
    split = evaluation.chronological_split(event_reviews(spark, d)).withColumnRenamed("review_id", "node_key")
    return records.campaign_partitions(_members(scored_events(spark, d)), split)


@query(f"WITH {_SC}, {_MEMBERS} SELECT campaign_id, array_to_string(list_sort(list(DISTINCT reviewer_id)), ',') AS reviewers FROM mem JOIN sc USING (review_id) GROUP BY 1")
def campaign_reviewers(spark: SparkSession, d: str) -> DataFrame:
    s = scored_events(spark, d)
    return records.campaign_reviewers(_members(s), s).select("campaign_id", F.array_join(F.transform("reviewers", lambda x: x.cast("string")), ",").alias("reviewers"))


_RUNS = "runs AS (SELECT concat('t-', event_type, '-s', cast(user_id % 5 AS VARCHAR), '-', lpad(cast(event_id AS VARCHAR), 9, '0')) AS run_id, 't' AS track, event_type AS model, user_id % 5 AS seed, value / 1000 AS metric FROM events), latest AS (SELECT track, model, seed, arg_max(metric, run_id) AS metric FROM runs GROUP BY 1, 2, 3)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    seed = F.col("user_id") % 5
    return table(spark, d, "events").select(F.concat_ws("-", F.lit("t"), "event_type", F.concat(F.lit("s"), seed.cast("string")), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("run_id"), F.lit("t").alias("track"), F.col("event_type").alias("model"), seed.alias("seed"), (F.col("value") / 1000).alias("metric"))


@query(f"WITH {_RUNS} SELECT track, model, count(metric) AS n_seeds, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS sd FROM latest GROUP BY 1, 2")
def seed_summary(spark: SparkSession, d: str) -> DataFrame:
    return records.seed_summary(_runs(spark, d), "metric")


@query(f"WITH {_RUNS}, p AS (SELECT a.track, a.metric - b.metric AS v FROM latest a JOIN latest b ON a.track = b.track AND a.seed = b.seed WHERE a.model = 'purchase' AND b.model = 'view') SELECT track, count(*) AS n_pairs, round(avg(v), 6) AS mean_delta, round(stddev_samp(v), 6) AS sd_delta FROM p GROUP BY 1")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    return records.paired_delta(_runs(spark, d), "metric", "purchase", "view")


@query(f"WITH {_SC}, c AS (SELECT score, count(*) AS n FROM sc GROUP BY 1), r AS (SELECT score, n, sum(n) OVER (ORDER BY score) AS cum, sum(n) OVER () AS total FROM c) SELECT review_id, round((cum - n + (n + 1) / 2) / total, 6) AS rank_share FROM sc JOIN r USING (score)")
def score_ranks(spark: SparkSession, d: str) -> DataFrame:
    return records.percentile_ranks(scored_events(spark, d)).select("review_id", F.round("rank_share", 6).alias("rank_share"))


@query("SELECT target_id, n FROM (SELECT target_id, count(*) AS n FROM reviews WHERE target_id IS NOT NULL GROUP BY 1) ORDER BY n DESC, target_id LIMIT 15")
def investigation_queue(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "reviews").filter("target_id is not null").groupBy("target_id").agg(F.count("*").alias("n"))
    return records.top_n(t, 20, "n", "target_id")


# -- rings and campaigns -----------------------------------------------------------------------------------------------

_SEL = "sel AS (SELECT * FROM sc ORDER BY score DESC, review_id LIMIT 300)"
_POOL = f"{_SEL}, pool AS (SELECT * FROM sel UNION ALL SELECT * FROM sc WHERE reviewer_id IN (SELECT reviewer_id FROM sel) AND review_id NOT IN (SELECT review_id FROM sel) AND score >= (SELECT quantile_cont(score, 0.5) FROM sc))"


@query(f"WITH {_SC}, {_POOL} SELECT review_id, score FROM pool")
def ring_pool(spark: SparkSession, d: str) -> DataFrame:
    s = scored_events(spark, d)
    sel = rings.select_top(s)
    return sel.unionByName(rings.bridges(s, sel)).select("review_id", "score")


def _jaccard(rows: str) -> str:
    return f"""(WITH t AS (SELECT DISTINCT component, reviewer_id, target_id FROM {rows}), n AS (SELECT component, reviewer_id, count(*) AS n FROM t GROUP BY 1, 2),
      s AS (SELECT a.component, a.reviewer_id AS x, b.reviewer_id AS y, count(*) AS c FROM t a JOIN t b ON a.component = b.component AND a.target_id = b.target_id AND a.reviewer_id < b.reviewer_id GROUP BY 1, 2, 3),
      j AS (SELECT s.component, sum(c / (p.n + q.n - c)) AS v FROM s JOIN n p ON p.component = s.component AND p.reviewer_id = x JOIN n q ON q.component = s.component AND q.reviewer_id = y GROUP BY 1),
      m AS (SELECT component, count(*) AS m FROM n GROUP BY 1 HAVING count(*) > 1) SELECT m.component, round(2 * coalesce(v, 0) / (m * (m - 1)), 6) AS o FROM m LEFT JOIN j USING (component))"""


_GROUPED = "gr AS (SELECT target_id % 7 AS component, reviewer_id, target_id % 40 AS target_id, us FROM ev)"
_DEALT = """dealt AS (WITH t AS (SELECT DISTINCT component, reviewer_id, target_id FROM gr), a AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY reviewer_id, target_id) AS i FROM t),
    b AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY md5(concat_ws('|', '42', cast(component AS VARCHAR), cast(reviewer_id AS VARCHAR), cast(target_id AS VARCHAR))), reviewer_id, target_id) AS i FROM t)
    SELECT a.component, a.reviewer_id, b.target_id FROM a JOIN b USING (component, i))"""


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return event_reviews(spark, d).select((F.col("target_id") % 7).alias("component"), "reviewer_id", (F.col("target_id") % 40).alias("target_id"), "us")


@query(f"WITH {_EV}, {_GROUPED}, {_DEALT} SELECT a.component, a.o AS raw_overlap, b.o AS ref_overlap FROM {_jaccard('gr')} a JOIN {_jaccard('dealt')} b USING (component)")
def ring_overlap(spark: SparkSession, d: str) -> DataFrame:
    g = _grouped(spark, d)
    return rings.overlap(g).join(rings.shuffled_overlap(g), "component")


_DAYS = f"dd AS (SELECT target_id, us // {_D} AS day, count(*) AS n FROM ev GROUP BY 1, 2), span AS (SELECT target_id, min(day) AS a, max(day) AS b FROM dd GROUP BY 1), every AS (SELECT target_id, a, unnest(generate_series(a, b)) AS day FROM span), hist AS (SELECT target_id, every.day - a AS off, coalesce(n, 0) AS n FROM every LEFT JOIN dd USING (target_id, day))"


@query(f'WITH {_EV}, {_DAYS} SELECT target_id, off AS "offset", cast(n AS BIGINT) AS n FROM hist')
def day_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rings.day_histogram(event_reviews(spark, d), "target_id")


@query(f"WITH {_EV}, {_DAYS}, w AS (SELECT target_id, off, n, sum(n) OVER (PARTITION BY target_id ORDER BY off RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING) AS s, max(off) OVER (PARTITION BY target_id) + 1 AS len FROM hist) SELECT target_id, round(max(s) FILTER (off < greatest(len - 7, 1)) / sum(n), 6) AS synchrony FROM w GROUP BY 1")
def ring_synchrony_legacy(spark: SparkSession, d: str) -> DataFrame:
    return rings.synchrony_legacy(event_reviews(spark, d), "target_id")


@query(f"WITH {_DELAY} SELECT count(*) AS n_campaigns, count(alert_day) AS n_detected, round(count(alert_day) / count(*), 6) AS recall FROM dl")
def detection_recall(spark: SparkSession, d: str) -> DataFrame:
    s = scored_events(spark, d)
    return campaigns.detection_recall(evaluation.replay_delay(s, _members(s), 0.9))


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "ring_candidates").select(F.col("candidate_id").alias("p"), F.explode("members").alias("member")).filter("member is not null")
    return p, table(spark, d, "account_links").select(F.col("run_id").alias("t"), F.col("reviewer_a").alias("member")).filter("member is not null")


@query()
def campaign_matches(spark: SparkSession, d: str) -> DataFrame:
    return campaigns.match_sets(*_sets(spark, d))


@query()
def campaign_recovery(spark: SparkSession, d: str) -> DataFrame:
    return campaigns.recovery(*_sets(spark, d))


def _simulated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    r = table(spark, d, "reviews").select("review_id", "reviewer_id", "target_id", F.col("timestamp").cast("timestamp").alias("timestamp"), "text", "rating", "source").filter("review_id is not null")
    return simulate.simulate(r, table(spark, d, "splits"))


@query()
def simulated_campaigns(spark: SparkSession, d: str) -> DataFrame:
    return simulate.simulation_stats(_simulated(spark, d)["grown"])


@query()
def simulated_rings(spark: SparkSession, d: str) -> DataFrame:
    """Rings found among planted campaigns: a planted row scores 0.9, any other by its md5 share below 0.6."""
    t = _simulated(spark, d)
    r = t["reviews"].filter("reviewer_id is not null and target_id is not null and timestamp is not null").dropDuplicates(["review_id"])
    planted = t["labels"].filter("label = 1").select("review_id", F.lit(0.9).alias("_p"))
    s = r.join(planted, "review_id", "left").select("review_id", "reviewer_id", "target_id", F.unix_micros("timestamp").alias("us"), F.coalesce("_p", 0.6 * simulate.share("score", F.col("review_id"))).alias("score"))
    return rings.priority_table(rings.ring_table(s))


# -- messages and fusion -----------------------------------------------------------------------------------------------

_FE = "fe AS (SELECT review_id, max(coalesce(rating, 0)) AS a, cast(max(CASE WHEN verified_purchase THEN 1 ELSE 0 END) AS DOUBLE) AS b FROM reviews GROUP BY 1), ed AS (SELECT DISTINCT relation, src, dst FROM edges WHERE src IS NOT NULL), nm AS (SELECT dst, relation, avg(a) AS a, avg(b) AS b FROM ed JOIN fe ON fe.review_id = ed.src GROUP BY 1, 2)"


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "reviews").groupBy("review_id").agg(F.max(F.coalesce("rating", F.lit(0.0))).alias("a"), F.max(F.when(F.col("verified_purchase"), 1.0).otherwise(0.0)).alias("b"))
    return table(spark, d, "edges").filter("src is not null").select("relation", "src", "dst").distinct(), r.select("review_id", F.array("a", "b").alias("h"))


@query(f"WITH {_FE} SELECT dst, relation, round(a, 6) AS mean_a, round(b, 6) AS mean_b FROM nm")
def neighbour_means(spark: SparkSession, d: str) -> DataFrame:
    e, x = _features(spark, d)
    return graph.neighbour_mean(e, x, "review_id", "h").select("dst", "relation", F.round(F.col("mean")[0], 6).alias("mean_a"), F.round(F.col("mean")[1], 6).alias("mean_b"))


_LAYER = {"self": [[0.5], [-1.0]], "same_reviewer": [[0.25], [1.0]], "same_target": [[-0.5], [0.5]], "co_target": [[1.0], [0.125]], "bias": [0.1]}


@query(
    f"""WITH {_FE}, m AS (SELECT dst, avg(CASE relation WHEN 'same_reviewer' THEN 0.25 * a + b WHEN 'same_target' THEN -0.5 * a + 0.5 * b ELSE a + 0.125 * b END) AS m FROM nm WHERE relation IN ('same_reviewer', 'same_target', 'co_target') GROUP BY 1)
    SELECT review_id, round(greatest(0.5 * a - b + coalesce(m, 0) + 0.1, 0), 6) AS h FROM fe LEFT JOIN m ON dst = review_id"""
)
def relational_layer(spark: SparkSession, d: str) -> DataFrame:
    e, x = _features(spark, d)
    return graph.relational_layer(e, x, _LAYER).select("review_id", F.round(F.col("h")[0], 6).alias("h"))


@query(
    """WITH s AS (SELECT DISTINCT node_key FROM splits WHERE role = 'test'), e AS (SELECT src, dst, relation, min(available_at) AS available_at FROM edges GROUP BY 1, 2, 3),
    a AS (SELECT *, 1 AS hop FROM e WHERE dst IN (SELECT node_key FROM s)), b AS (SELECT *, 2 AS hop FROM e WHERE dst IN (SELECT src FROM a WHERE src IS NOT NULL)),
    u AS (SELECT src, dst, relation, available_at, min(hop) AS hop FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE src IS NOT NULL GROUP BY 1, 2, 3, 4) SELECT src, dst, relation, available_at, hop FROM u ORDER BY available_at NULLS FIRST, src, dst, relation LIMIT 100"""
)
def receptive_field(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").filter("src is not null")
    return graph.receptive_field(e, table(spark, d, "splits").filter("role = 'test'").select(F.col("node_key").alias("review_id")))


@query("WITH e AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1) SELECT DISTINCT r.review_id, NOT coalesce(text_missing, false) AS text, coalesce(n, 0) > 0 AS graph, true AS time FROM (SELECT review_id, bool_or(coalesce(text_missing, false)) AS text_missing FROM reviews GROUP BY 1) r LEFT JOIN e ON dst = r.review_id")
def expert_availability(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "reviews").groupBy("review_id").agg(F.bool_or(F.coalesce("text_missing", F.lit(False))).alias("text_missing"))
    n = graph.in_degree(r, table(spark, d, "edges")).select("review_id", "in_degree")
    return experts.availability(r.join(n, "review_id").withColumn("time_available", F.lit(True)))


_X = "x AS (SELECT review_id, label, CASE WHEN review_id % 3 > 0 THEN score END AS a, CASE WHEN review_id % 4 > 0 THEN 1 - score END AS b, CASE WHEN review_id % 5 > 0 THEN 0.5 END AS c FROM sc)"


def _experts(spark: SparkSession, d: str) -> DataFrame:
    s, i = scored_events(spark, d), F.col("review_id")
    return s.select("review_id", "label", F.when(i % 3 > 0, F.col("score")).alias("a"), F.when(i % 4 > 0, 1 - F.col("score")).alias("b"), F.when(i % 5 > 0, F.lit(0.5)).alias("c"))


@query(f"WITH {_SC} SELECT round(avg(label), 6) AS prior, count(*) AS n FROM sc WHERE label IN (0, 1)")
def prior_model(spark: SparkSession, d: str) -> DataFrame:
    return experts.prior_model(scored_events(spark, d))


@query(f"WITH {_SC}, {_X} SELECT review_id, round((coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE 0.5 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.3 END) + (CASE WHEN c IS NULL THEN 0 ELSE 0.2 END), 0), 6) AS fused FROM x")
def global_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _experts(spark, d).select("review_id", F.round(fusion.weighted_available(["a", "b", "c"], [0.5, 0.3, 0.2]), 6).alias("fused"))


@query(
    f"""WITH {_SC}, {_X}, p AS (SELECT i / 10 AS wa, j / 10 AS wb, (10 - i - j) / 10 AS wc FROM range(11) r(i), range(11) s(j) WHERE i + j <= 10),
    y AS (SELECT wa, wb, wc, label, round((coalesce(a * wa, 0) + coalesce(b * wb, 0) + coalesce(c * wc, 0)) / nullif((CASE WHEN a IS NULL THEN 0 ELSE wa END) + (CASE WHEN b IS NULL THEN 0 ELSE wb END) + (CASE WHEN c IS NULL THEN 0 ELSE wc END), 0), 6) AS s FROM x, p WHERE label IN (0, 1)),
    g AS (SELECT wa, wb, wc, s, sum(label) AS p, count(*) AS n FROM y WHERE s IS NOT NULL GROUP BY 1, 2, 3, 4), t AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS m FROM g WINDOW o AS (PARTITION BY wa, wb, wc ORDER BY s DESC))
    SELECT round(wa, 1) AS wa, round(wb, 1) AS wb, round(wc, 1) AS wc, round(sum(p * tp / m) / sum(p), 4) AS average_precision FROM t GROUP BY 1, 2, 3"""
)
def fusion_grid(spark: SparkSession, d: str) -> DataFrame:
    return experts.grid_average_precision(_experts(spark, d), ["a", "b", "c"]).withColumn("average_precision", F.round("average_precision", 4))


@query(f"WITH {_SC}, {_X} SELECT 'a' AS a, 'b' AS b, count(*) AS n, round(corr(ra, rb), 5) AS spearman, round(avg(CASE WHEN (x >= 0.5) <> (y >= 0.5) THEN 1.0 ELSE 0.0 END), 6) AS disagreement FROM (SELECT a AS x, b AS y, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM x WHERE a IS NOT NULL AND b IS NOT NULL)")
def expert_ranks(spark: SparkSession, d: str) -> DataFrame:
    return experts.rank_diagnostics(_experts(spark, d), ["a", "b"])


@query(f"WITH {_SC}, {_X} SELECT review_id, greatest(a, b, c) AS row_max, round(greatest(a, b, c) - least(a, b, c), 6) AS row_spread FROM x")
def expert_extremes(spark: SparkSession, d: str) -> DataFrame:
    return experts.row_extremes(_experts(spark, d), ["a", "b", "c"])


@query(f"WITH {_SC}, {_X}, y AS (SELECT review_id, CASE WHEN cast(concat('0x', substr(md5(concat_ws('|', '77', 'a', cast(review_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0 >= 0.3 THEN a END AS a, b, c FROM x) SELECT review_id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0), 6) AS fused FROM y")
def stress_drop(spark: SparkSession, d: str) -> DataFrame:
    return experts.stress(_experts(spark, d), ["a", "b", "c"], "a", 0.3, fusion.mean_available).select("review_id", F.round("fused", 6).alias("fused"))


@query(f"WITH {_SC}, {_X}, w AS (SELECT CASE WHEN a IS NULL THEN 0 ELSE exp(a) END AS a, CASE WHEN b IS NULL THEN 0 ELSE exp(b) END AS b, CASE WHEN c IS NULL THEN 0 ELSE exp(c) END AS c FROM x), n AS (SELECT unnest(['a', 'b', 'c']) AS expert, unnest([a / nullif(a + b + c, 0), b / nullif(a + b + c, 0), c / nullif(a + b + c, 0)]) AS w FROM w) SELECT expert, round(avg(w), 6) AS mean_weight, round(stddev_pop(w), 6) AS sd_weight, round(max(w), 6) AS max_weight FROM n WHERE w IS NOT NULL GROUP BY 1")
def gate_weights(spark: SparkSession, d: str) -> DataFrame:
    x = _experts(spark, d)
    w = fusion.masked_softmax(["a", "b", "c"], [F.col(n).isNotNull() for n in "abc"])
    return experts.gate_summary(x.select(*(c.alias(f"w_{n}") for c, n in zip(w, "abc"))), ["a", "b", "c"])


@query()
def adaptive_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The gate trained on the first 60 % of events and applied to all."""
    x = _experts(spark, d).withColumn("context", F.array(F.lit(1.0), (F.col("review_id") % 7).cast("double")))
    train = x.join(evaluation.chronological_split(event_reviews(spark, d)).filter("role = 'train'").select("review_id"), "review_id", "left_semi")
    w = experts.train_gate(train, ["a", "b", "c"], epochs=50)
    return experts.adaptive_fusion(x, ["a", "b", "c"], w).select("review_id", *(F.round(c, 6).alias(c) for c in ("w_a", "w_b", "w_c", "fused")), "insufficient_data")


@query()
def classification_report(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.classification_report(scored_events(spark, d))


@query()
def ring_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence cards of the rings among scored events."""
    s = scored_events(spark, d).withColumn("review_id", F.col("review_id").cast("string"))
    found = rings.ring_table(s)
    return explain.evidence_cards(found, explain.cited_events(found, s.select("review_id", "reviewer_id", "target_id", "us"), s))


@query("SELECT coalesce(nullif(concat_ws('. ', nullif(trim(title), ''), nullif(trim(text), '')), ''), '') AS body, count(*) AS n FROM reviews GROUP BY 1")
def joined_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reviews").select(experts.joined_text(F.col("title"), F.col("text")).alias("body")).groupBy("body").agg(F.count("*").alias("n"))


@query()
def causal_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.causal_graph(log_reviews(spark, d))


# -- history of the events as the experts see it -------------------------------------------------------------------------


@query(_scaled_sql(", ".join(scaled_column(n) for n in history.CONTEXT)))
def gate_context(spark: SparkSession, d: str) -> DataFrame:
    g = history.gate_context(_scaled(spark, d))
    return g.select("review_id", *(F.round(F.col("context")[i], 5).alias(n) for i, n in enumerate(history.CONTEXT)))


_FLAGS = " + ".join(f"({n} IS NULL)::INT" for n in history.COUNTS + history.SECONDS + history.SIGNED)


@query(f"WITH {_EV}, x AS (SELECT * FROM ev), {_HIST} SELECT review_id, {_FLAGS} AS n_missing, {_FLAGS} < 16 AS available FROM h")
def missing_features(spark: SparkSession, d: str) -> DataFrame:
    m = history.missing_flags(history.history(event_reviews(spark, d)))
    return m.select("review_id", F.aggregate("missing", F.lit(0), lambda s, x: s + x).alias("n_missing"), "available")
