"""Strict-past behavioural features of reviewers and targets.

Events at one instant see the same past. Counts over trailing days are differences of two running counts, so a key costs
time in line with its events, however dense they are. Means and distinct counts look at the last `cap` earlier events
of a key: the frame of that many rows before the first event of an instant holds just these, and all events of the
instant take it over. Gaps are capped on their own: the last `cap` gaps, not the gaps of the last events.

Defined results: features without a past are null, counts are 0; a null reviewer or target is a key of its own, as in
the log; null ratings count as events and not in means; an empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
COUNTS = ("rev_count_1d", "rev_count_7d", "rev_count_30d", "prior_unique_targets", "prior_reviews_31d", "target_volume_prior", "target_reviewer_volume_prior", "reviewer_prior_rating_count", "target_burst_24h", "reviewer_burst_24h")
SECONDS = ("last_gap_s", "interarrival_std_s", "interarrival_mean_s", "time_since_target_prev_s")
SIGNED = ("rating_minus_reviewer_prior_mean", "target_prior_mean_rating")
#: Fixed value: the features that the gate sees as context, in its order.
CONTEXT = ("rev_count_7d", "rev_count_30d", "target_volume_prior", "last_gap_s")


def _before(key: str, days: int = 0):
    """All events of the key more than `days` days and at least a microsecond earlier."""
    return Window.partitionBy(key).orderBy("us").rangeBetween(Window.unboundedPreceding, -days * DAY - 1)


def _within(key: str, days: int) -> Column:
    return F.count("*").over(_before(key)) - F.count("*").over(_before(key, days))


def gaps(reviews: DataFrame) -> DataFrame:
    """With gap_s: time since the reviewer's event before this one in (time, id) order, null after more than 30 days."""
    before = F.lag("us").over(Window.partitionBy("reviewer_id").orderBy("us", "review_id"))
    return reviews.withColumn("gap_s", F.when(before >= F.col("us") - 30 * DAY, (F.col("us") - before) / 1e6))


def _gap_state(reviews: DataFrame, cap: int) -> DataFrame:
    """With _gap: (number of gaps so far, this gap, mean and deviation of the last `cap`) on the events that close a gap."""
    order = Window.partitionBy("reviewer_id", F.col("gap_s").isNotNull()).orderBy("us", "review_id")
    last = order.rowsBetween(1 - cap, 0)
    state = F.struct(F.row_number().over(order).alias("n"), F.col("gap_s").alias("gap"), F.avg("gap_s").over(last).alias("mean"), F.stddev_pop("gap_s").over(last).alias("std"))
    return gaps(reviews).withColumn("_gap", F.when(F.col("gap_s").isNotNull(), state))


def _capped(rows: DataFrame, key: str, other: str, prefix: str, cap: int) -> DataFrame:
    """With <prefix>_mean and <prefix>_distinct over the last `cap` earlier events of the key."""
    recent = Window.partitionBy(key).orderBy("us", "review_id").rowsBetween(-cap, -1)
    instant = Window.partitionBy(key, "us").orderBy("review_id")
    x = rows.withColumn("_m", F.avg("rating").over(recent)).withColumn("_d", F.size(F.collect_set(other).over(recent)).cast("long"))
    return x.withColumn(f"{prefix}_mean", F.first("_m").over(instant)).withColumn(f"{prefix}_distinct", F.first("_d").over(instant)).drop("_m", "_d")


def history(reviews: DataFrame, cap: int = 512) -> DataFrame:
    """The features of each event (review_id, reviewer_id, target_id, us, rating); null means missing."""
    u, t = "reviewer_id", "target_id"
    g = _gap_state(reviews.select("review_id", u, t, "us", "rating"), cap)
    g = _capped(_capped(g, u, t, "_u", cap), t, u, "_t", cap)
    n_past, seen, since = F.count("*").over(_before(u)), F.max("us").over(_before(u)), F.max("us").over(_before(t))
    gap = F.max("_gap").over(_before(u))
    g = g.withColumn("_g", gap)
    return g.select(
        "review_id",
        _within(u, 1).alias("rev_count_1d"),
        _within(u, 7).alias("rev_count_7d"),
        _within(u, 30).alias("rev_count_30d"),
        F.col("_g.gap").alias("last_gap_s"),
        F.when(F.col("_g.n") >= 2, F.col("_g.std")).alias("interarrival_std_s"),
        F.when(F.col("_g.n") >= 2, F.col("_g.mean")).alias("interarrival_mean_s"),
        F.col("_u_distinct").alias("prior_unique_targets"),
        _within(u, 30).alias("prior_reviews_31d"),
        _within(t, 30).alias("target_volume_prior"),
        F.col("_t_distinct").alias("target_reviewer_volume_prior"),
        F.when(since >= F.col("us") - 30 * DAY, (F.col("us") - since) / 1e6).alias("time_since_target_prev_s"),
        (F.col("rating") - F.col("_u_mean")).alias("rating_minus_reviewer_prior_mean"),
        F.when(n_past > 0, F.least(n_past, F.lit(cap))).alias("reviewer_prior_rating_count"),
        F.col("_t_mean").alias("target_prior_mean_rating"),
        _within(t, 1).alias("target_burst_24h"),
        _within(u, 1).alias("reviewer_burst_24h"),
        ((F.col("us") - seen) / 1e6).alias("time_since_prev_s"),
    )


def _logged(name: str) -> Column:
    return F.log1p(F.greatest(F.col(name).cast("double"), F.lit(0.0))) if name in COUNTS or name in SECONDS else F.col(name).cast("double")


def scale(features: DataFrame, train: DataFrame, names: tuple[str, ...] = COUNTS + SECONDS + SIGNED) -> DataFrame:
    """Robust scaling by the train rows' medians and quartiles: (log) features, centred, over IQR / 1.349; missing becomes 0."""
    x = features.select("review_id", *(_logged(n).alias(n) for n in names))
    stats = x.join(train.select("review_id"), "review_id", "left_semi").agg(*(a for n in names for a in (F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{n}"), F.stddev_pop(n).alias(f"s_{n}"), F.count(n).alias(f"c_{n}"))))
    row = stats.first()
    cols = []
    for n in names:
        q, c = row[f"q_{n}"], row[f"c_{n}"]
        if not q or c < 2:
            cols.append(F.coalesce(F.col(n), F.lit(0.0)).alias(n))
            continue
        width = (q[2] - q[0]) / 1.349 or row[f"s_{n}"] or 0.0
        cols.append(F.coalesce((F.col(n) - q[1]) / max(width, 1e-6), F.lit(0.0)).alias(n))
    return x.select("review_id", *cols)


def gate_context(scaled: DataFrame) -> DataFrame:
    """(review_id, context): the gate's four scaled features as one array."""
    return scaled.select("review_id", F.array(*CONTEXT).alias("context"))


def missing_flags(features: DataFrame, names: tuple[str, ...] = COUNTS + SECONDS + SIGNED) -> DataFrame:
    """(review_id, missing, available): a 0/1 flag for each feature, and whether any feature was observed (counts always are)."""
    flags = [F.col(n).isNull().cast("int") for n in names]
    return features.select("review_id", F.array(*flags).alias("missing"), (sum(flags) < len(names)).alias("available"))
