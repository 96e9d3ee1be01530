"""Labels, roles, partitions of campaigns, run tables: the joins and checks between the engine's tables.

Defined results: a missing role is train (or what the caller names), a missing label stays null; nulls in member lists and
repeated members don't count; empty tables give empty results and pass the checks; checks raise with what they found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.evaluation import ROLES

#: Where a label may come from.
LABEL_SOURCES = ("unknown", "human", "platform", "synthetic", "benchmark")


# -- labels and predictions ------------------------------------------------------------------------------------------


def background_labels(reviews: DataFrame) -> DataFrame:
    """(review_id, label, label_source, campaign_id, is_synthetic): nothing is known of background reviews."""
    return reviews.select("review_id").distinct().select("review_id", F.lit(None).cast("int").alias("label"), F.lit("unknown").alias("label_source"), F.lit(None).cast("string").alias("campaign_id"), F.lit(False).alias("is_synthetic"))


def label_faults(labels: DataFrame, sources: tuple[str, ...] = LABEL_SOURCES) -> DataFrame:
    """One row: repeated ids, unknown sources, and labels that aren't 0, 1 or null."""
    return labels.agg(
        (F.count("review_id") - F.count_distinct("review_id")).alias("repeated_ids"),
        F.count_if(~F.coalesce(F.col("label_source").isin(*sources), F.lit(False))).alias("bad_sources"),
        F.count_if(F.col("label").isNotNull() & ~F.col("label").isin(0, 1)).alias("bad_labels"),
    )


def prediction_faults(predictions: DataFrame, expected: int) -> DataFrame:
    """One row: repeated ids, and rows that are missing from or beyond the expected number."""
    return predictions.agg((F.count("review_id") - F.count_distinct("review_id")).alias("repeated_ids"), (F.count("*") - F.lit(expected)).cast("long").alias("surplus_rows"))


def must_be_clean(faults: DataFrame, what: str) -> None:
    """Raise if a one-row table of faults has anything but zeros."""
    found = {k: v for k, v in faults.first().asDict().items() if v}
    if found:
        raise ValueError(f"{what}: {found}")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on the left only, on the right only, and on both (each counted once)."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))


def with_labels(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """Every review with its label; null where it has none."""
    return reviews.join(labels.select("review_id", "label").dropDuplicates(["review_id"]), "review_id", "left")


def with_label_lists(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions of older runs with the label saved elsewhere; their own label wins where they have one."""
    old = labels.select("review_id", F.col("label").alias("_label")).dropDuplicates(["review_id"])
    own = F.col("label") if "label" in predictions.columns else F.lit(None)
    return predictions.join(old, "review_id", "left").withColumn("label", F.coalesce(own, "_label")).drop("_label")


# -- roles and campaigns ---------------------------------------------------------------------------------------------


def with_roles(reviews: DataFrame, splits: DataFrame, default: str = ROLES[0]) -> DataFrame:
    """Every review with its role; the default where it has none."""
    s = splits.groupBy(F.col("node_key").alias("review_id")).agg(F.min("role").alias("role"))
    return reviews.join(s, "review_id", "left").withColumn("role", F.coalesce("role", F.lit(default)))


def members_of(campaigns: DataFrame) -> DataFrame:
    """(campaign_id, review_id) of the members' lists."""
    return campaigns.select("campaign_id", F.explode(F.array_distinct(F.array_compact("member_review_ids"))).alias("review_id"))


def final_roles(reviews: DataFrame, background: DataFrame, campaigns: DataFrame) -> DataFrame:
    """(review_id, role): the background split's role, else that of the review's campaign, else train."""
    part = members_of(campaigns).join(campaigns.select("campaign_id", "partition"), "campaign_id").groupBy("review_id").agg(F.min("partition").alias("partition"))
    b = background.groupBy(F.col("node_key").alias("review_id")).agg(F.min("role").alias("role"))
    j = reviews.select("review_id").distinct().join(b, "review_id", "left").join(part, "review_id", "left")
    return j.select("review_id", F.coalesce("role", "partition", F.lit(ROLES[0])).alias("role"))


def campaign_partitions(members: DataFrame, splits: DataFrame) -> DataFrame:
    """(campaign_id, partition, n_roles, spanning): a campaign belongs to the latest role among its members; train if none has one."""
    rank = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role"))
    s = splits.filter(F.col("role").isin(*ROLES)).select(F.col("node_key").alias("review_id"), "role").distinct()
    g = members.join(s, "review_id", "left").groupBy("campaign_id").agg(F.max_by("role", F.when(F.col("role").isNotNull(), rank)).alias("latest"), F.count_distinct("role").alias("n_roles"))
    return g.select("campaign_id", F.coalesce("latest", F.lit(ROLES[0])).alias("partition"), "n_roles", (F.col("n_roles") > 1).alias("spanning"))


def assert_no_leak(leaks: DataFrame) -> None:
    """Raise if any campaign has members in several roles."""
    some = leaks.limit(5).collect()
    if some:
        raise ValueError(f"campaigns span roles: {[r.asDict() for r in some]}")


def planted(campaigns: DataFrame, partition: str = "test") -> DataFrame:
    """The manipulative campaigns of a partition."""
    return campaigns.filter((F.col("partition") == partition) & F.col("is_manipulative"))


def campaign_reviewers(members: DataFrame, reviews: DataFrame) -> DataFrame:
    """(campaign_id, reviewers): the distinct authors of each campaign's reviews."""
    r = reviews.filter("reviewer_id is not null").select("review_id", "reviewer_id").distinct()
    return members.join(r, "review_id").groupBy("campaign_id").agg(F.array_sort(F.collect_set("reviewer_id")).alias("reviewers"))


def of_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of the given reviews."""
    return rows.join(nodes.select("review_id").distinct(), "review_id", "left_semi")


def role_nodes(splits: DataFrame, role: str) -> DataFrame:
    """(review_id) with that role, each once."""
    return splits.filter((F.col("role") == role) & F.col("node_key").isNotNull()).select(F.col("node_key").alias("review_id")).distinct()


def role_counts(splits: DataFrame) -> DataFrame:
    return splits.groupBy("role").agg(F.count("*").alias("n_rows"), F.count_distinct("node_key").alias("n_nodes"))


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of tables whose columns may differ; what a table lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def id_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: sizes of the union, the intersection and both differences of two id sets."""
    x = aligned(a, b, key)
    return x.select((F.col("left_only") + F.col("right_only") + F.col("both")).alias("n_union"), F.col("both").alias("n_intersection"), F.col("left_only").alias("n_minus"), F.col("right_only").alias("n_reverse_minus"))


# -- runs ------------------------------------------------------------------------------------------------------------


def finite(value: Column) -> Column:
    """The number, or null where it is missing, NaN or infinite."""
    v = value.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The run with the greatest id for each (track, model, seed); ids end in their start time."""
    cols = [c for c in runs.columns if c not in ("track", "model", "seed")]
    return runs.groupBy("track", "model", "seed").agg(F.max_by(F.struct(*cols), "run_id").alias("r")).select("track", "model", "seed", "r.*")


def seed_summary(runs: DataFrame, metric: str) -> DataFrame:
    """(track, model, n_seeds, mean, sd): over the latest run of each seed; the sample deviation, null for one seed; non-finite values are left out."""
    v = latest_runs(runs).select("track", "model", finite(F.col(metric)).alias("v"))
    return v.groupBy("track", "model").agg(F.count("v").alias("n_seeds"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"))


def paired_delta(runs: DataFrame, metric: str, a: str, b: str) -> DataFrame:
    """(track, n_pairs, mean_delta, sd_delta): model a minus model b over the seeds that both have."""
    v = latest_runs(runs).select("track", "model", "seed", finite(F.col(metric)).alias("v")).filter("v is not null")
    x, y = (v.filter(F.col("model") == m).select("track", "seed", F.col("v").alias(n)) for m, n in ((a, "x"), (b, "y")))
    d = x.join(y, ["track", "seed"]).select("track", (F.col("x") - F.col("y")).alias("d"))
    return d.groupBy("track").agg(F.count("*").alias("n_pairs"), F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.stddev_samp("d"), 6).alias("sd_delta"))


def percentile_ranks(scored: DataFrame, score: str = "score") -> DataFrame:
    """Rows with `rank_share`: the mean rank of equal scores by the number of rows with a score; ranks are running totals over ranges."""
    from tidegraph.functions.prefix import running_totals

    s = scored.filter(finite(F.col(score)).isNotNull()).groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("n"))
    r = running_totals(s, [F.col("_s")], ["n"])
    total = s.agg(F.sum("n").alias("total")).first().total or 0
    rank = r.select("_s", F.round((F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2) / F.lit(max(total, 1)), 9).alias("rank_share"))
    return scored.join(rank, F.col(score) == F.col("_s"), "left").drop("_s")


def top_n(rows: DataFrame, n: int, by: str, tie: str, least: int = 3, most: int = 15) -> DataFrame:
    """The n highest rows, n held between `least` and `most`: the queue of an investigation."""
    return rows.orderBy(F.desc(by), tie).limit(min(max(n, least), most))


def last_of(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The n last rows of each key; ranks are limited inside each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(*(F.desc(o) for o in order))
    return rows.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")
