"""Splits, ranking metrics, set matching and daily replay."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.prefix import running_totals

#: Roles in time order.
ROLES = ("train", "validation", "calibration", "test")


def chronological_split(reviews: DataFrame, fractions: tuple[float, ...] = (0.6, 0.15, 0.1, 0.15)) -> DataFrame:
    """(review_id, us, role) by rank in (us, review_id) order; each role but the last gets int(n * share) rows; ranks are running totals over ranges."""
    r = reviews.select("review_id", "us", F.lit(1).alias("one"))
    n = r.count()
    bounds = _bounds(n, fractions)
    rank = F.col("cum_one")
    role = F.lit(ROLES[-1])
    for b, name in reversed(list(zip(bounds, ROLES))):
        role = F.when(rank <= b, name).otherwise(role)
    return running_totals(r, ["us", "review_id"], ["one"]).select("review_id", "us", role.alias("role"))


def split_cutoffs(split: DataFrame) -> DataFrame:
    return split.groupBy("role").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def _bounds(n: int, fractions: tuple[float, ...]) -> list[int]:
    if abs(sum(fractions) - 1) > 1e-6:
        raise ValueError("the fractions must sum to 1")
    out, total = [], 0
    for f in fractions[:-1]:
        total += int(n * f)
        out.append(total)
    return out


def stratified_split(rows: DataFrame, id_col: str, label: str, seed: int = 42, fractions: tuple[float, ...] = (0.6, 0.15, 0.1, 0.15)) -> DataFrame:
    """Roles within each class in a seeded md5 order: int(n * share) rows each, the last role the rest; rows without a label are excluded.

    Ranks come from one running total over ranges of (class, md5, id); the classes' sizes, one row each, give their starts.
    """
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(label).cast("string"), F.col(id_col).cast("string")))
    known = rows.filter(F.col(label).isNotNull()).select(id_col, label, draw.alias("_u"), F.lit(1).alias("one"))
    sizes = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row a class
    role, before = F.lit(ROLES[-1]), 0
    for value in sorted(sizes):
        rank = F.col("cum_one") - before
        for b, name in reversed(list(zip(_bounds(sizes[value], fractions), ROLES))):
            role = F.when((F.col(label) == F.lit(value)) & (rank <= b), name).otherwise(role)
        before += sizes[value]
    ranked = running_totals(known, [F.col(label), F.col("_u"), F.col(id_col)], ["one"]).select(id_col, label, role.alias("role"))
    return ranked.unionByName(rows.filter(F.col(label).isNull()).select(id_col, label, F.lit("excluded").alias("role")))


def leak_check(members: DataFrame, split: DataFrame) -> DataFrame:
    """(campaign_id, n_roles, roles) of campaigns (campaign_id, review_id) whose members stand in several roles."""
    j = members.join(split.select("review_id", "role"), "review_id").groupBy("campaign_id").agg(F.count_distinct("role").alias("n_roles"), F.concat_ws(",", F.array_sort(F.collect_set("role"))).alias("roles"))
    return j.filter("n_roles > 1")


def _judged(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isin(0, 1))


def curve(scored: DataFrame) -> DataFrame:
    """(score, tp, fp, precision, recall, f1) at each distinct score, highest first; ties are one step."""
    s = _judged(scored).groupBy("score").agg(F.sum("label").cast("long").alias("p"), F.count("*").alias("n"))
    c = running_totals(s, [F.desc("score")], ["p", "n"])
    total = s.agg(F.sum("p").alias("pos"), F.sum("n").alias("all")).first()
    c = c.withColumn("pos", F.lit(total.pos).cast("long")).withColumn("all", F.lit(total["all"]).cast("long"))
    tp, m = F.col("cum_p"), F.col("cum_n")
    return c.select("score", "p", "n", "pos", "all", tp.cast("long").alias("tp"), (m - tp).cast("long").alias("fp"), (tp / m).alias("precision"), F.try_divide(tp, F.col("pos")).alias("recall"), (2 * tp / (m + F.col("pos"))).alias("f1"))


def ranking_summary(scored: DataFrame) -> DataFrame:
    """One row: n, positives, average precision, ROC AUC, Brier score, F1 at 0.5, best F1 and its lowest threshold; null where undefined."""
    c = curve(scored)
    both = (F.max("pos") > 0) & (F.max("pos") < F.max("all"))
    fp_step = F.col("n") - F.col("p")
    auc = F.sum(fp_step * (F.col("tp") - F.col("p")) + fp_step * F.col("p") / 2) / (F.max("pos") * (F.max("all") - F.max("pos")))
    at_half = F.max(F.when(F.col("score") >= 0.5, F.struct("tp", "fp")))
    a = c.agg(
        F.max("all").alias("n"),
        F.max("pos").alias("n_positive"),
        F.round(F.when(both, F.sum(F.col("p") * F.col("precision")) / F.max("pos")), 6).alias("average_precision"),
        F.round(F.when(both, auc), 6).alias("roc_auc"),
        F.round(F.sum(F.col("p") * (1 - F.col("score")) * (1 - F.col("score")) + fp_step * F.col("score") * F.col("score")) / F.max("all"), 6).alias("brier"),
        F.round(F.coalesce(F.when(F.max("pos") + at_half["tp"] + at_half["fp"] > 0, 2 * at_half["tp"] / (at_half["tp"] + at_half["fp"] + F.max("pos"))), F.lit(0.0)), 6).alias("f1_at_half"),
        F.round(F.max("f1"), 6).alias("best_f1"),
        F.when(both, F.min_by("score", F.struct(-F.round("f1", 12), "score"))).alias("best_threshold"),
        F.round(F.try_divide(F.max("pos"), F.max("all")), 6).alias("prevalence"),
    )
    return a


def at_k(scored: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, precision, recall) of the k highest scores, ties by id; one top-k pass over max(ks) rows."""
    j = _judged(scored)
    w = Window.orderBy(F.desc("score"), "review_id")  # over max(ks) rows
    top = j.orderBy(F.desc("score"), "review_id").limit(max(ks)).select("label", F.row_number().over(w).alias("rn"))
    total = j.agg(F.sum("label").alias("pos")).first().pos
    k = top.select("*", F.explode(F.array(*(F.lit(x) for x in ks))).alias("k")).filter("rn <= k").groupBy("k").agg(F.sum("label").alias("hit"), F.count("*").alias("m"))
    return k.select("k", F.round(F.col("hit") / F.col("m"), 6).alias("precision"), F.round(F.try_divide("hit", F.lit(total).cast("long")), 6).alias("recall"))


def classification_report(scored: DataFrame, ks: tuple[int, ...] = (100,)) -> DataFrame:
    """(metric, value): the ranking summary, precision and recall at each k, and the rows left out for want of a score or label."""
    row = ranking_summary(scored).first().asDict()
    row |= {f"{m}_at_{r.k}": r[m] for r in at_k(scored, ks).collect() for m in ("precision", "recall")}
    row["n_excluded"] = scored.count() - (row["n"] or 0)
    return scored.sparkSession.createDataFrame([(k, None if v is None else float(v)) for k, v in row.items()], "metric string, value double")


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate): equal bins, the last closed; empty bins are kept."""
    b = _judged(scored).select(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "score", "label")
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("label"), 6).alias("rate"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(g, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "rate")


def iou_pairs(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(p, t, iou) of the sets (p, member) and (t, member) that share a member: an equi-join instead of all pairs."""
    a, b = predicted.select("p", "member").distinct(), truth.select("t", "member").distinct()
    na, nb = a.groupBy("p").agg(F.count("*").alias("na")), b.groupBy("t").agg(F.count("*").alias("nb"))
    s = a.join(b, "member").groupBy("p", "t").agg(F.count("*").alias("both")).join(na, "p").join(nb, "t")
    return s.select("p", "t", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("iou"))


def best_matching(weights: list[list[float]]) -> list[tuple[int, int]]:
    """One-to-one (row, column) pairs of greatest total weight (weights to 12 decimals); pairs of weight 0 are left out."""
    return best_pairs([(i, j, round(w * 1e12)) for i, r in enumerate(weights) for j, w in enumerate(r)])


def best_pairs(edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """One-to-one pairs of greatest total weight out of edges (i, j, whole weight); edges without a positive weight are left out.

    Shortest augmenting paths with potentials from the side with fewer ends, along edges alone; an end may stay free at
    weight 0. Of equally good matchings the one with the smallest sum of i, then of j.
    """
    edges = [e for e in edges if e[2] > 0]
    swap = len({i for i, _, _ in edges}) > len({j for _, j, _ in edges})
    base = sum(i + j for i, j in {(i, j) for i, j, _ in edges}) + 1  # above the sum of any matching
    adj: dict[int, list[tuple[int, int]]] = {}
    for i, j, w in edges:
        adj.setdefault(j if swap else i, []).append((i if swap else j, (i - w * base) * base + j))
    row_price, col_price, owner = dict.fromkeys(adj, 0), {}, {}
    for start in sorted(adj):
        dist, via, done, near = {}, {}, {}, []
        row, col, gone = start, None, 0
        while True:
            for j, c in (*adj[row], (-1 - row, 0)):  # the last one leaves the row free
                d = gone + c - row_price[row] - col_price.get(j, 0)
                if j not in dist or d < dist[j]:
                    dist[j], via[j] = d, col
                    heapq.heappush(near, (d, j))
            while True:
                gone, col = heapq.heappop(near)
                if gone == dist[col] and col not in done:
                    break
            if col not in owner:
                break
            done[col] = None
            row = owner[col]
        for j in done:
            row_price[owner[j]] += gone - dist[j]
            col_price[j] = col_price.get(j, 0) - gone + dist[j]
        row_price[start] += gone
        while via[col] is not None:
            owner[col] = owner[via[col]]
            col = via[col]
        owner[col] = start
    return sorted((j, r) if swap else (r, j) for j, r in owner.items() if j >= 0)


def replay_daily(scored: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(day, n_scored, alerts, planted_scored, planted_alerted): a review in several campaigns counts in each."""
    s = scored.select("review_id", F.to_date(F.timestamp_micros("us")).alias("day"), F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("alert"))
    day = s.groupBy("day").agg(F.count("*").alias("n_scored"), F.count_if("alert").alias("alerts"))
    planted = s.join(members.select("campaign_id", "review_id").distinct(), "review_id").groupBy("day").agg(F.count("*").alias("planted_scored"), F.count_if("alert").alias("planted_alerted"))
    j = day.join(planted, "day", "left")
    return j.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n_scored", "alerts", F.coalesce("planted_scored", F.lit(0)).alias("planted_scored"), F.coalesce("planted_alerted", F.lit(0)).alias("planted_alerted"))


def replay_delay(scored: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(campaign_id, first_day, alert_day, delay_days): null where a campaign was never alerted."""
    s = scored.select("review_id", F.to_date(F.timestamp_micros("us")).alias("day"), "score").join(members.select("campaign_id", "review_id").distinct(), "review_id")
    g = s.groupBy("campaign_id").agg(F.min("day").alias("f"), F.min(F.when(F.col("score") >= threshold, F.col("day"))).alias("a"))
    return g.select("campaign_id", F.date_format("f", "yyyy-MM-dd").alias("first_day"), F.date_format("a", "yyyy-MM-dd").alias("alert_day"), F.datediff("a", "f").cast("long").alias("delay_days"))


def replay_horizons(delays: DataFrame, horizons: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """(horizon, recall): campaigns alerted within so many days; undetected ones stay in the denominator."""
    x = delays.select(F.explode(F.array(*(F.lit(h) for h in horizons))).alias("horizon"), "delay_days")
    return x.groupBy("horizon").agg(F.round(F.count_if(F.col("delay_days") <= F.col("horizon")) / F.count("*"), 6).alias("recall"))
