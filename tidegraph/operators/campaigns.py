"""Predicted groups against planted campaigns: one-to-one matching, recovery, splits and merges, detection.

IoU is computed only for sets that share a member. These pairs fall into components (sets that touch directly or through
others); a one-to-one matching never crosses one, so each component is solved by itself in a task.

Defined results: empty sets match nothing; repeated members count once; no pairs give no matches; shares over nothing are
null; ties between equally good matchings are decided by the order of ids.
"""

from __future__ import annotations

from collections.abc import Iterator  # noqa: F401

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.evaluation import best_pairs, iou_pairs
from tidegraph.operators.graph import components
from tidegraph.session import cut


def match_sets(predicted: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(p, t, iou, good): the one-to-one pairs of greatest total IoU of sets (p, member) and (t, member); good: IoU of at least `least`.

    Of a component with k sets on its smaller side, each of these needs only its k best pairs: the others take up at most
    k - 1 partners. The rest never reach the solver.
    """
    return _matched(cut(iou_pairs(predicted, truth), "iou"), least)


def _matched(iou: DataFrame, least: float) -> DataFrame:
    ends = iou.select(F.concat(F.lit("p|"), F.col("p").cast("string")).alias("a"), F.concat(F.lit("t|"), F.col("t").cast("string")).alias("b"), "p", "t", "iou")
    of = components(ends.select("a", "b")).select(F.col("node").alias("a"), "component")
    kinds = dict(iou.dtypes)
    met = ends.join(of, "a").select("component", "p", "t", "iou")
    sides = met.groupBy("component").agg(F.count_distinct("p").alias("np"), F.count_distinct("t").alias("nt"))
    met = met.join(sides, "component").withColumn("by_p", F.col("np") <= F.col("nt")).withColumn("by", F.when(F.col("by_p"), F.concat(F.lit("p|"), F.col("p").cast("string"))).otherwise(F.concat(F.lit("t|"), F.col("t").cast("string"))))
    met = met.withColumn("rk", F.row_number().over(Window.partitionBy("component", "by").orderBy(F.desc("iou"), "p", "t"))).filter("rk <= least(np, nt)")

    def solve(t: pa.Table) -> pa.Table:
        ps, ts = (sorted(set(t.column(c).to_pylist())) for c in ("p", "t"))
        row, col = {p: i for i, p in enumerate(ps)}, {x: j for j, x in enumerate(ts)}
        weight = {(row[p], col[x]): w for p, x, w in zip(*(t.column(c).to_pylist() for c in ("p", "t", "iou")))}
        got = best_pairs([(i, j, round(w * 1_000_000)) for (i, j), w in weight.items()])
        return pa.table({"p": pa.array([ps[i] for i, _ in got], t.schema.field("p").type), "t": pa.array([ts[j] for _, j in got], t.schema.field("t").type), "iou": pa.array([weight[e] for e in got], pa.float64())})

    met = met.select("component", "p", "t", "iou").groupBy("component").applyInArrow(solve, f"p {kinds['p']}, t {kinds['t']}, iou double")
    return met.withColumn("good", F.col("iou") >= least)


def recovery(predicted: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: precision, recall, member recovery, mean IoU, and how campaigns are split and merged.

    fragmentation and merging count, among the matched pairs, sets in several pairs, so they are 0 for any one-to-one
    matching; n_fragmented and n_merged count them among all pairs that share a member.
    """
    iou = cut(iou_pairs(predicted, truth), "iou")
    m = cut(_matched(iou, least), "matched")
    np_, nt = (d.select(F.count_distinct(c).alias(f"n_{c}")) for d, c in ((predicted, "p"), (truth, "t")))
    good = m.filter("good")
    shared = good.join(truth.select("t", "member").distinct(), "t").join(predicted.select("p", "member").distinct(), ["p", "member"], "left_semi").groupBy("p", "t").agg(F.count("*").alias("both"))
    size = truth.groupBy("t").agg(F.count_distinct("member").alias("n"))
    share = shared.join(size, "t").agg(F.avg(F.col("both") / F.col("n")).alias("member_recovery"))
    g = good.agg(F.count("*").alias("n_good"), F.avg("iou").alias("mean_iou"))
    split = iou.groupBy("t").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_fragmented"))
    merged = iou.groupBy("p").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_merged"))
    one = {}
    for part in (np_, nt, g, share, split, merged):  # six rows of one value each
        one |= part.first().asDict()
    ratio = lambda a, b: round(a / b, 6) if b else None
    row = (one["n_p"], one["n_t"], one["n_good"], ratio(one["n_good"], one["n_p"]), ratio(one["n_good"], one["n_t"]), round(one["member_recovery"] or 0.0, 6), None if one["mean_iou"] is None else round(one["mean_iou"], 6), 0.0, 0.0, one["n_fragmented"], one["n_merged"])
    return predicted.sparkSession.createDataFrame([row], "n_predicted bigint, n_truth bigint, n_matched bigint, precision double, recall double, member_recovery double, mean_iou double, fragmentation double, merging double, n_fragmented bigint, n_merged bigint")


def detection_recall(delays: DataFrame) -> DataFrame:
    """One row: campaigns, those ever alerted, and their share; null without campaigns."""
    d = delays.agg(F.count("*").alias("n_campaigns"), F.count("alert_day").alias("n_detected"))
    return d.select("*", F.round(F.try_divide("n_detected", "n_campaigns"), 6).alias("recall"))
