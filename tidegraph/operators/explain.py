"""Why a candidate ring scores as it does: masking of its evidence edges, measures of the removal, evidence cards.

The receptive field of a ring's seed is bounded (max_edges) and comes to the driver; masking scores variants of it within
a budget of model calls. Everything around it, events, scores and missing context, stays in tables.

Defined results: a field without edges is explained as `no_edges`; no candidates give the status `no_candidates`; an
unknown candidate raises; missing scores and times come out as null and are named as missing context.
"""

from __future__ import annotations

from collections.abc import Callable
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.graph import receptive_field
from tidegraph.operators.rings import best_ring, seed_review

Edge = tuple[str, str, str]  # src, dst, relation


def groups_of(edges: list[Edge]) -> list[tuple[str, list[Edge]]]:
    """The edges of each relation, in their order without repeats; largest group first, then by name."""
    by: dict[str, dict[Edge, None]] = {}
    for e in edges:
        by.setdefault(e[2], {})[e] = None
    return sorted(((r, list(es)) for r, es in by.items()), key=lambda x: (-len(x[1]), x[0]))


def mask_relations(edges: list[Edge], score: Callable[[list[Edge]], float], budget: int = 50, seed: int = 42) -> dict:
    """Remove whole relations, each time the one whose loss lowers the score most, until none does or the budget is spent.

    The last relation is never removed. Gives the scores of all, of the kept and of the removed edges alone, and of two
    random controls: legacy (edges taken from what was kept, as many as were removed; nothing if too few are left) and
    equal (as many edges taken from all).
    """
    groups = groups_of(edges)
    every = [e for _, es in groups for e in es]
    calls = 0

    def ask(kept: list[Edge]) -> float:
        nonlocal calls
        calls += 1
        return float(score(kept))

    if not every:
        return {"status": "no_edges", "original": ask([]), "removed": [], "calls": calls}
    original = now = ask(every)
    removed: list[str] = []
    while len(removed) < len(groups) - 1:
        best = None
        for r, _ in groups:
            if r in removed or calls >= budget - 3:
                continue
            s = ask([e for e in every if e[2] not in (*removed, r)])
            if best is None or s < best[0]:
                best = (s, r)
        if best is None or best[0] >= now:
            break
        now = best[0]
        removed.append(best[1])
    kept, gone = [e for e in every if e[2] not in removed], [e for e in every if e[2] in removed]
    alone = ask(gone) if gone else original
    rng = Random(seed)
    legacy = kept if len(kept) <= len(gone) else [e for e in kept if e not in set(rng.sample(kept, len(gone)))]
    drop = set(rng.sample(every, len(gone)))
    equal = [e for e in every if e not in drop]
    return {"status": "explained", "original": original, "masked": now, "alone": alone, "removed": removed, "n_removed": len(gone), "n_edges": len(every), "random_legacy": ask(legacy) if gone else original, "random_equal": ask(equal) if gone else original, "calls": calls}


def masking_measures(m: dict) -> dict:
    """Removal effect, retention gap, compactness (the removed fraction), and the advantage over both random controls."""
    if m["status"] != "explained":
        return {"removal_effect": None, "retention_gap": None, "compactness": None, "random_advantage": None, "random_advantage_fixed": None}
    effect = m["original"] - m["masked"]
    return {
        "removal_effect": round(effect, 6),
        "retention_gap": round(m["original"] - m["alone"], 6),
        "compactness": round(m["n_removed"] / m["n_edges"], 6),
        "random_advantage": round(m["random_legacy"] - m["masked"], 6) if m["n_edges"] - m["n_removed"] > m["n_removed"] else 0.0,
        "random_advantage_fixed": round(effect - (m["original"] - m["random_equal"]), 6),
    }


def field_edges(edges: DataFrame, seeds: DataFrame, hops: int = 2, max_edges: int = 100) -> list[Edge]:
    """The bounded receptive field as tuples."""
    return [(r.src, r.dst, r.relation) for r in receptive_field(edges, seeds, hops, max_edges).collect()]


def weighted_scorer(scores: dict[str, float], seed_id: str, weights: dict[str, float], base: float = 0.0) -> Callable[[list[Edge]], float]:
    """A transparent scorer: the seed's own score, raised by the scores of its neighbours over the kept edges, by relation weight."""
    import math

    def score(kept: list[Edge]) -> float:
        z = base + scores.get(seed_id, 0.0)
        for relation, w in sorted(weights.items()):
            near = [scores.get(s, 0.0) for s, d, r in kept if r == relation]
            z += w * (sum(near) / len(near)) if near else 0.0
        return 1 / (1 + math.exp(-z))

    return score


# -- cards -----------------------------------------------------------------------------------------------------------


def cited_events(rings: DataFrame, reviews: DataFrame, scored: DataFrame, most: int = 20) -> DataFrame:
    """(ring_id, review_id, reviewer_id, target_id, us, score): the highest scored reviews of each ring's members on its targets, at most `most` a ring."""
    from tidegraph.operators.records import last_of

    m = rings.select("ring_id", "targets", F.explode("members").alias("reviewer_id"))
    x = reviews.join(m, "reviewer_id").filter(F.array_contains("targets", F.col("target_id"))).select("ring_id", "review_id", "reviewer_id", "target_id", "us")
    x = x.join(scored.select("review_id", "score").dropDuplicates(["review_id"]), "review_id", "left").withColumn("_s", F.coalesce("score", F.lit(-1.0)))
    return last_of(x, "ring_id", ["_s", "review_id"], most).select("ring_id", "review_id", "reviewer_id", "target_id", "us", "score")


def _missing() -> Column:
    """Names of what the cited events lack."""
    some = lambda c, name: F.when(c, F.lit(name))
    return F.array_compact(F.array(some(F.col("n_events") == 0, "no_events"), some(F.col("n_scored") == 0, "no_scores"), some((F.col("n_scored") > 0) & (F.col("n_scored") < F.col("n_events")), "some_scores"), some(F.col("first_us").isNull(), "no_times")))


def evidence_cards(rings: DataFrame, cited: DataFrame) -> DataFrame:
    """One card a ring: sizes, measures, its cited reviews, their span in time, missing context, and a summary in one sentence."""
    c = cited.groupBy("ring_id").agg(F.count("*").alias("n_events"), F.count("score").alias("n_scored"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.array_sort(F.collect_list("review_id")).alias("cited"))
    j = rings.join(c, "ring_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0))).withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))
    text = F.format_string("%s: %d accounts on %d targets, priority %.3f, %d cited reviews", "ring_id", F.size("members"), F.size("targets"), "priority", "n_events")
    day = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd")
    return j.select(F.col("ring_id").alias("candidate_id"), F.size("members").alias("n_members"), F.size("targets").alias("n_targets"), "mean_top_score", "adjusted_overlap", "synchrony", "priority", F.coalesce("cited", F.array().cast("array<string>")).alias("cited"), day("first_us").alias("first_day"), day("last_us").alias("last_day"), _missing().alias("missing_context"), text.alias("summary"))


def explain_ring(rings: DataFrame, rows: DataFrame, edges: DataFrame, scored: DataFrame, candidate: str | None = None, weights: dict[str, float] | None = None, budget: int = 50) -> dict:
    """The masking of one candidate (the best where none is named): its seed review, its bounded field, the measures.

    rows: the ring's reviews (component, review_id, score), with the components of rings.
    """
    if rings.isEmpty():
        return {"status": "no_candidates"}
    picked = best_ring(rings) if candidate is None else rings.filter(F.col("ring_id") == candidate)
    ring = picked.select("ring_id", "component").first()
    if ring is None:
        raise KeyError(f"unknown candidate {candidate}")
    seed = seed_review(rows.filter(F.col("component") == F.lit(ring.component))).first()
    field = field_edges(edges, rings.sparkSession.createDataFrame([(seed.review_id,)], f"review_id {dict(rows.dtypes)['review_id']}"))
    ids = {x for s, d, _ in field for x in (s, d)} | {seed.review_id}
    scores = {r.review_id: r.score for r in scored.filter(F.col("review_id").isin(*ids)).select("review_id", F.coalesce("score", F.lit(0.0)).alias("score")).collect()}  # at most max_edges reviews twice
    weights = weights or {r: 1.0 for r in sorted({r for *_, r in field})}
    m = mask_relations(field, weighted_scorer(scores, seed.review_id, weights), budget)
    return {"candidate_id": ring.ring_id, "seed_review": seed.review_id, **m, **masking_measures(m)}
