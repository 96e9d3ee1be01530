"""Candidate rings of reviewers: selection, projection on shared targets, components, scores, order.

Defined results: scores that are null or NaN are never selected; ties in score are ordered by id; fewer than min_accounts
reviewers, components with fewer than min_targets targets and an empty budget give no ring; repeated rows count once in
sets and as often as they stand in mean scores.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.graph import components, shared_target_pairs
from tidegraph.session import cut

DAY = 86_400_000_000


def select_top(scored: DataFrame, threshold: float | None = None, top_k: int = 300, cap: int = 4000) -> DataFrame:
    """The review budget: the top_k scores, or those of at least the threshold up to the cap; ties by id."""
    s = scored.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    s = s if threshold is None else s.filter(F.col("score") >= threshold)
    return s.orderBy(F.desc("score"), "review_id").limit(top_k if threshold is None else cap)


def bridges(scored: DataFrame, selected: DataFrame, percentile: float = 0.5) -> DataFrame:
    """Further reviews by selected authors with a score of at least that percentile of all scores."""
    least = scored.agg(F.percentile("score", F.lit(percentile)).alias("least")).first().least
    more = scored.join(selected.select("reviewer_id").distinct(), "reviewer_id", "left_semi").join(selected.select("review_id"), "review_id", "left_anti")
    return more.filter(F.col("score") >= F.lit(least)).select(scored.columns)


def strong_components(pairs: DataFrame, n_reviewers: int, giant_share: float = 0.6) -> DataFrame:
    """(node, component) over the edges (a, b, weight); if one component holds more than giant_share of the reviewers, over the edges above the median weight alone."""
    pairs = cut(pairs, "projection")
    c = cut(components(pairs.select("a", "b")), "groups")
    size = c.groupBy("component").agg(F.count("*").alias("m")).agg(F.max("m").alias("largest")).first()
    if (size.largest or 0) > giant_share * n_reviewers:
        middle = pairs.agg(F.percentile("weight", F.lit(0.5)).alias("w")).first().w
        strong = pairs.filter(F.col("weight") > middle)
        if not strong.isEmpty():
            return components(strong.select("a", "b"))
    return c


def ring_table(scored: DataFrame, threshold: float | None = None, top_k: int = 300, min_accounts: int = 3, min_targets: int = 2, top_m: int = 5, least_shared: int = 2, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), legacy: bool = False) -> DataFrame:
    """One row for each ring: ring_id, members, targets, mean of the top_m scores, mean pairwise overlap, 7-day synchrony, priority.

    The review budget bounds everything after it. size_ref_mean is the overlap after shuffling (see shuffled_overlap()),
    adjusted_overlap what the raw one has above it; the priority counts the adjusted one. Ids follow the order of each
    ring's first member, not the priority. legacy: synchrony as in synchrony_legacy().
    """
    sel = select_top(scored, threshold, top_k)
    pool = cut(sel.unionByName(bridges(scored, sel)), "pool")
    c = strong_components(shared_target_pairs(pool, least_shared), pool.select("reviewer_id").distinct().count())
    sized = c.withColumn("m", F.count("*").over(Window.partitionBy("component"))).filter(F.col("m") >= min_accounts).select("node", "component")
    x = cut(pool.join(sized, F.col("reviewer_id") == F.col("node")), "ring-rows")
    g = x.groupBy("component").agg(
        F.array_sort(F.collect_set("reviewer_id")).alias("members"),
        F.array_sort(F.collect_set("target_id")).alias("targets"),
        F.count("*").alias("n_reviews"),
        F.round(F.expr(f"aggregate(slice(sort_array(collect_list(coalesce(score, 0D)), false), 1, {top_m}), 0D, (s, v) -> s + v) / least(count(1), {top_m})"), 6).alias("mean_top_score"),
    ).filter(F.size("targets") >= min_targets)
    sync = synchrony_legacy(x, "component") if legacy else synchrony(x, "component")
    j = g.join(overlap(x), "component").join(sync, "component").join(shuffled_overlap(x), "component", "left")
    j = j.withColumn("size_ref_mean", F.coalesce("ref_overlap", F.lit(0.0))).drop("ref_overlap")
    j = j.withColumn("adjusted_overlap", F.round(F.greatest(F.col("raw_overlap") - F.col("size_ref_mean"), F.lit(0.0)), 6))
    p = weights[0] * F.col("mean_top_score") + weights[1] * F.least(3 * F.col("adjusted_overlap"), F.lit(1.0)) + weights[2] * F.col("synchrony")
    place = F.row_number().over(Window.orderBy(F.col("members")[0])) - 1  # a row for each ring of the budget
    return j.withColumn("priority", F.round(p, 6)).withColumn("ring_id", F.format_string("ring-%04d", place))


def priority_table(rings: DataFrame) -> DataFrame:
    """Rings by priority, sizes in place of lists."""
    return rings.select("ring_id", F.size("members").alias("n_members"), F.size("targets").alias("n_targets"), "n_reviews", "mean_top_score", "raw_overlap", "size_ref_mean", "adjusted_overlap", "synchrony", "priority").orderBy(F.desc("priority"), "ring_id")


def drop_overlapping(rings: DataFrame, least: float = 0.7) -> DataFrame:
    """Rings without those whose members have a Jaccard of at least `least` with a ring of higher priority that stays.

    Rings of one discovery are disjoint and all stay; lists that come from several runs may overlap. Rings are bounded by
    the review budget, and only those that share a member are compared.
    """
    m = rings.select("ring_id", "priority", F.explode("members").alias("member"), F.size("members").alias("n"))
    a, b = m.alias("a"), m.alias("b")
    better = (F.col("b.priority") > F.col("a.priority")) | ((F.col("b.priority") == F.col("a.priority")) & (F.col("b.ring_id") < F.col("a.ring_id")))
    s = a.join(b, (F.col("a.member") == F.col("b.member")) & better).groupBy(F.col("a.ring_id").alias("ring_id"), F.col("b.ring_id").alias("over")).agg(F.count("*").alias("both"), F.max("a.n").alias("n"), F.max("b.n").alias("k"))
    near = {}
    for r in s.filter(F.col("both") / (F.col("n") + F.col("k") - F.col("both")) >= least).collect():
        near.setdefault(r.ring_id, set()).add(r.over)
    gone: set[str] = set()
    for r in rings.select("ring_id", "priority").orderBy(F.desc("priority"), "ring_id").collect():
        if near.get(r.ring_id, set()) - gone:
            gone.add(r.ring_id)
    return rings.filter(~F.col("ring_id").isin(*gone)) if gone else rings


def best_ring(rings: DataFrame) -> DataFrame:
    return rings.orderBy(F.desc("priority"), "ring_id").limit(1)


def seed_review(rows: DataFrame) -> DataFrame:
    """(component, review_id): the review with the highest score of each ring, the smallest id among equals."""
    return rows.groupBy("component").agg(F.min_by("review_id", F.struct(-F.coalesce("score", F.lit(0.0)), "review_id")).alias("review_id"))


def overlap(rows: DataFrame, joined: int = 1_000_000, block: int = 2048) -> DataFrame:
    """(component, raw_overlap): mean Jaccard of the target sets of all pairs of a component's reviewers; pairs without a shared target add 0.

    Reviewers with equal sets are compared once and counted by their number. Different sets meet on shared targets; where
    that gives a component more than `joined` rows and a good part of its pairs share a target, blocks of sets are
    multiplied as matrices instead.
    """
    t = rows.select("component", "reviewer_id", "target_id").distinct()
    sets = t.groupBy("component", "reviewer_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("target_id")).alias("ts"))
    equal = cut(sets.groupBy("component", "n", "ts").agg(F.count("*").alias("m"), F.count("reviewer_id").alias("k"), F.min("reviewer_id").alias("id")), "target-sets")
    size = equal.groupBy("component").agg(F.sum("m").alias("m")).filter("m > 1")
    x = equal.filter("component is not null and k > 0 and size(ts) > 0").select("component", "id", "n", "k", "ts")
    same = x.select("component", (F.size("ts") / (2 * F.col("n") - F.size("ts")) * F.col("k") * (F.col("k") - 1) / 2).alias("j"))
    often = x.select("component", F.explode("ts").alias("target_id")).groupBy("component", "target_id").agg(F.count("*").alias("f")).groupBy("component").agg(F.sum(F.col("f") * F.col("f")).alias("met"))
    plan = x.groupBy("component").agg(F.count("*").alias("sets")).join(often, "component").select("component", ((F.col("met") > joined) & (F.col("sets") * F.col("sets") <= 64 * F.col("met"))).alias("dense"), F.ceil(F.col("sets") / block).cast("int").alias("g"))
    x = x.join(plan, "component")
    e = x.filter("not dense").select("component", "id", "n", "k", F.explode("ts").alias("target_id"))
    s = e.alias("a").join(e.alias("b"), (F.col("a.component") == F.col("b.component")) & (F.col("a.target_id") == F.col("b.target_id")) & (F.col("a.id") < F.col("b.id")))
    both = F.count("*")
    s = s.groupBy(F.col("a.component").alias("component"), F.col("a.id"), F.col("b.id")).agg((both / (F.max("a.n") + F.max("b.n") - both) * F.max("a.k") * F.max("b.k")).alias("j")).select("component", "j")
    d = x.filter("dense").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    d = d.select("component", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"), "blk", "n", "k", "ts")
    d = d.groupBy("component", "lo", "hi").applyInArrow(_block_overlap, f"component {dict(rows.dtypes)['component']}, j double")
    s = same.unionByName(s).unionByName(d).groupBy("component").agg(F.sum("j").alias("s"))
    return size.join(s, "component", "left").select("component", F.round(2 * F.coalesce("s", F.lit(0.0)) / (F.col("m") * (F.col("m") - 1)), 6).alias("raw_overlap"))


def _block_overlap(t: pa.Table) -> pa.Table:
    """(component, j): the sum of the Jaccards of two blocks of sets, or of the pairs of one, each counted by its numbers of reviewers."""
    import numpy as np

    t = t.combine_chunks()
    blk, n, k = (t.column(c).to_numpy() for c in ("blk", "n", "k"))
    lists = t.column("ts").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else lists.chunk(0)
    code = lists.flatten().dictionary_encode().indices.to_numpy()
    row = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy())
    same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
    a = np.flatnonzero(blk == t.column("lo")[0].as_py())
    b = a if same else np.flatnonzero(blk == t.column("hi")[0].as_py())
    both, width = np.zeros((len(a), len(b)), dtype=np.float32), 1024
    for first in range(0, int(code.max()) + 1, width):
        at = (code >= first) & (code < first + width)
        has = np.zeros((len(n), width), dtype=np.float32)
        has[row[at], code[at] - first] = 1
        both += has[a] @ has[b].T
    j = both / (n[a][:, None] + n[b][None, :] - both).astype(np.float64) * k[a][:, None] * k[b][None, :]
    return pa.table({"component": t.column("component").slice(0, 1), "j": pa.array([float(np.triu(j, 1).sum() if same else j.sum())])})


def synchrony(rows: DataFrame, key: str, days: int = 7) -> DataFrame:
    """Largest share of a group's events within `days` days; windows that start on an event's day suffice."""
    d = rows.groupBy(key, F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("day").rangeBetween(0, days - 1)
    return d.withColumn("s", F.sum("n").over(w)).groupBy(key).agg(F.round(F.max("s") / F.sum("n"), 6).alias("synchrony"))


def day_histogram(rows: DataFrame, key: str) -> DataFrame:
    """(key, offset, n): events of each day of a group's span, days without events included."""
    d = rows.groupBy(key, F.floor(F.col("us") / DAY).alias("day")).agg(F.count("*").alias("n"))
    span = d.groupBy(key).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    every = span.select(key, "a", F.explode(F.sequence("a", "b")).alias("day"))
    return every.join(d, [key, "day"], "left").select(key, (F.col("day") - F.col("a")).alias("offset"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def synchrony_legacy(rows: DataFrame, key: str, days: int = 7) -> DataFrame:
    """Synchrony with the surveyed fault: of a span longer than the window the last start is never tried, so its final day never counts."""
    h = day_histogram(rows, key)
    w = Window.partitionBy(key)
    h = h.withColumn("s", F.sum("n").over(w.orderBy("offset").rangeBetween(0, days - 1))).withColumn("len", F.max("offset").over(w) + 1)
    tried = F.max(F.when(F.col("offset") < F.greatest(F.col("len") - days, F.lit(1)), F.col("s")))
    return h.groupBy(key).agg(F.round(tried / F.sum("n"), 6).alias("synchrony"))


def shuffled_overlap(members: DataFrame, seed: int = 42) -> DataFrame:
    """(component, ref_overlap): the overlap after dealing each component's targets anew to its reviewers by a seeded md5 order."""
    w = Window.partitionBy("component")
    t = members.select("component", "reviewer_id", "target_id").distinct()
    slots = t.withColumn("i", F.row_number().over(w.orderBy("reviewer_id", "target_id"))).select("component", "i", "reviewer_id")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("component").cast("string"), F.col("reviewer_id").cast("string"), F.col("target_id").cast("string")))
    dealt = t.withColumn("i", F.row_number().over(w.orderBy(draw, "reviewer_id", "target_id"))).select("component", "i", "target_id")
    return overlap(slots.join(dealt, ["component", "i"])).withColumnRenamed("raw_overlap", "ref_overlap")
