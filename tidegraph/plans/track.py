"""The event track from end to end: a labelled log to experts, fusion, calibration, threshold, replay and rings.

Each step is a table keyed by review_id; what several later steps read is written once. Training reads bounded samples of
labelled rows (experts.train_expert); everything else covers the whole log.

Defined results: reviews without author, target or time are left out; an expert that can't be trained (no labelled rows of
both classes) is missing for every row; rows without any expert have no score and are counted as insufficient.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.operators import evaluation, experts, fusion, graph, history, records, rings
from tidegraph.session import cut

RELATIONS = ("same_reviewer", "same_target", "co_target")


def feature_tables(log: DataFrame, train: DataFrame) -> dict[str, DataFrame]:
    """(review_id, v) for each expert: text vectors, scaled history beside missing flags, and history propagated over the causal graph."""
    h = cut(history.history(log.select("review_id", "reviewer_id", "target_id", "us", "rating")), "history")
    names = history.COUNTS + history.SECONDS + history.SIGNED
    scaled = history.scale(h, train).select("review_id", F.array(*names).alias("x"))
    time = cut(scaled.join(history.missing_flags(h), "review_id").select("review_id", F.concat("x", F.transform("missing", lambda v: v.cast("double"))).alias("v")), "time")
    text = experts.hashed_vectors(log.select("review_id", experts.joined_text(F.col("title"), F.col("text")).alias("text"))).withColumnRenamed("vector", "v")
    edges = cut(graph.causal_graph(log), "edges")
    reached = edges.select(F.col("dst").alias("review_id")).distinct()
    wide = experts.propagated(edges, time.select("review_id", F.col("v").alias("h")), RELATIONS)
    return {"text": text, "graph": wide.join(reached, "review_id", "left_semi").withColumnRenamed("h", "v"), "time": time}


def train_and_score(log: DataFrame, labels: DataFrame, splits: DataFrame, hidden: tuple[int, ...] = (64, 32), epochs: int = 40, max_rows: int = 20_000, seed: int = 42) -> dict[str, object]:
    """scores (review_id, role, label, text, graph, time, fused, score), threshold, report of the test role, and each expert's epochs.

    log: review_id, reviewer_id, target_id, us, rating, title, text. Fused: mean of the available experts; score: calibrated on
    the calibration role; threshold: best F1 on the validation role, frozen before the test role is looked at.
    """
    log = log.filter("review_id is not null and reviewer_id is not null and target_id is not null and us is not null").dropDuplicates(["review_id"])
    base = cut(records.with_labels(records.with_roles(log.select("review_id"), splits), labels), "roles")
    of = lambda role: base.filter(F.col("role") == role).select("review_id", "label")
    out, epochs_of = base, {}
    for name, vectors in feature_tables(log, of("train").select("review_id")).items():
        vectors = cut(vectors, name)
        try:
            weights, epochs_of[name] = experts.train_expert(of("train").join(vectors, "review_id"), of("validation").join(vectors, "review_id"), "v", max_rows, hidden=hidden, epochs=epochs, seed=seed)
        except ValueError:
            out = out.withColumn(name, F.lit(None).cast("double"))
            continue
        got = experts.score_rows(vectors, "v", weights).select("review_id", fusion.sigmoid(F.col("logit")).alias(name))
        out = out.join(got, "review_id", "left")
    out = cut(out.withColumn("fused", fusion.mean_available(list(experts.EXPERTS))), "fused")
    part = out.filter("role = 'calibration'").select(F.col("fused").alias("score"), "label")
    scores = cut(experts.calibrated(part, out.withColumn("score", F.col("fused"))).withColumn("score", F.col("calibrated")).drop("calibrated"), "scores")
    threshold = experts.frozen_threshold(scores.filter("role = 'validation'"))
    report = evaluation.classification_report(scores.filter("role = 'test'"))
    return {"scores": scores, "threshold": threshold, "report": report, "epochs": epochs_of}


def investigate(log: DataFrame, scores: DataFrame, members: DataFrame, threshold: float, top_k: int = 300) -> dict[str, DataFrame]:
    """Replay by day, delays of the given campaigns (campaign_id, review_id), and the rings among the scored reviews."""
    s = log.select("review_id", "reviewer_id", "target_id", "us").join(scores.select("review_id", "score", "label"), "review_id")
    return {"daily": evaluation.replay_daily(s, members, threshold), "delays": evaluation.replay_delay(s, members, threshold), "rings": rings.ring_table(s, top_k=top_k)}
