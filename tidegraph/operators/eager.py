"""Per-key results where a few keys hold most rows: aggregate before the join, combine states algebraically, roll up.

An aggregate over a join is rewritten: each input is reduced to one compact state for each (join key, group key), the
states are joined, and counts are multiplied or sums scaled by the other side's count. Every reduction has map-side
combine, so a hot key leaves each task as one row; no key's rows meet in one task.

Defined results: rows whose join key is null join nothing; rows whose group key is null form no group; null measures
add nothing to sums and to n_measured; repeated rows count as often as they stand; an empty side gives an empty result;
column names of the sides may clash, as both are renamed first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums run over whole millionths, so that their order doesn't change them.
SCALE = 1_000_000


def _units(measure: Column) -> Column:
    return F.round(measure * SCALE).cast("decimal(38,0)")


def join_states(rows: DataFrame, join_key: str, groups: list[str], measure: str | None = None) -> DataFrame:
    """One state for each (join key, groups): n, n_measured, units (exact sum)."""
    picked = rows.select(F.col(join_key).alias("jk"), *(F.col(g).alias(f"g_{g}") for g in groups), *([F.col(measure).alias("m")] if measure else [])).filter("jk is not null")
    for g in groups:
        picked = picked.filter(F.col(f"g_{g}").isNotNull())
    aggs = [F.count("*").alias("n")]
    if measure:
        aggs += [F.count("m").alias("n_measured"), F.sum(_units(F.col("m"))).alias("units")]
    return picked.groupBy("jk", *(f"g_{g}" for g in groups)).agg(*aggs)


def eager_join_aggregate(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_groups: list[str], right_groups: list[str], measure: str) -> DataFrame:
    """count(*), count(measure) and avg(measure) of left JOIN right by the groups, without joining rows.

    A left state of n rows meets a right state of k rows as n * k joined rows whose measure sum is k times its own.
    """
    a = join_states(left, left_key, left_groups, measure)
    b = join_states(right, right_key, right_groups).withColumnRenamed("n", "k")
    joined = a.join(b, "jk")
    names = [f"g_{g}" for g in [*left_groups, *right_groups]]
    rolled = joined.groupBy(*names).agg(
        F.sum(F.col("n") * F.col("k")).cast("long").alias("n_rows"),
        F.sum(F.col("n_measured") * F.col("k")).cast("long").alias("n_measured"),
        F.sum(F.col("units") * F.col("k")).alias("units"),
    )
    mean = F.expr("try_divide(cast(units as double), n_measured)") / SCALE
    return rolled.select(*(F.col(f"g_{g}").alias(g) for g in [*left_groups, *right_groups]), "n_rows", "n_measured", F.round(mean, 6).alias(f"mean_{measure}"))


def _as_keys(rows: DataFrame, fields: list[str], *others: str) -> DataFrame:
    """Each row once for each key field: (key_field, key_value, others)."""
    pairs = F.array(*(F.struct(F.lit(f).alias("key_field"), F.col(f).cast("string").alias("key_value")) for f in fields))
    return rows.select(F.explode(pairs).alias("_k"), *others).select("_k.key_field", "_k.key_value", *others).filter("key_value is not null")


def key_stats(rows: DataFrame, fields: list[str], measure: str) -> DataFrame:
    """Counts and means for all values of each key field, in one pass: partial states per task, then one row for each key."""
    keyed = _as_keys(rows, fields, measure)
    s = keyed.groupBy("key_field", "key_value").agg(F.count("*").alias("n_rows"), F.count(measure).alias("n_measured"), F.sum(_units(F.col(measure))).alias("units"))
    return s.select("key_field", "key_value", "n_rows", "n_measured", F.round(F.expr("try_divide(cast(units as double), n_measured)") / SCALE, 6).alias(f"mean_{measure}"))


def key_history(rows: DataFrame, fields: list[str], time: str, measure: str) -> DataFrame:
    """Monthly counts, means and running counts of each key; a key's history has at most one row a month."""
    from pyspark.sql import Window

    month = rows.filter(F.col(time).isNotNull()).select(*fields, measure, F.date_format(time, "yyyy-MM").alias("month"))
    keyed = _as_keys(month, fields, "month", measure)
    s = keyed.groupBy("key_field", "key_value", "month").agg(F.count("*").alias("n_rows"), F.count(measure).alias("c"), F.sum(_units(F.col(measure))).alias("units"))
    w = Window.partitionBy("key_field", "key_value").orderBy("month")
    return s.select("key_field", "key_value", "month", "n_rows", F.round(F.expr("try_divide(cast(units as double), c)") / SCALE, 6).alias(f"mean_{measure}"), F.sum("n_rows").over(w).alias("n_so_far"))


def heavy_keys(rows: DataFrame, fields: list[str], share: float = 0.02) -> DataFrame:
    """key_field, key_value of the non-null keys that hold at least that share of all rows.

    An eager aggregation over the join of the rows with themselves on each key, where a key of n rows on either side
    has n * n joined rows: both inputs are reduced to a state for each key before the join, the states' counts are
    multiplied, and the products rolled up. A key is heavy if its product reaches the square of the share of all rows.
    """
    keyed = _as_keys(rows, fields).select("key_field", "key_value", F.struct("key_field", "key_value").alias("key"))
    a = join_states(keyed, "key", ["key_field", "key_value"])
    b = join_states(keyed, "key", []).withColumnRenamed("n", "k")
    met = a.join(b, "jk").groupBy(F.col("g_key_field").alias("key_field"), F.col("g_key_value").alias("key_value")).agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("k").cast("decimal(19,0)")).alias("n_joined"))
    least = math.ceil(share * rows.count() - 1e-9)
    return met.filter(F.col("n_joined") >= F.lit(str(least * least)).cast("decimal(38,0)")).select("key_field", "key_value")


def target_pairs(reviews: DataFrame, key: str, group: str, measure: str) -> DataFrame:
    """(group, n_rows, n_measured, mean): over all pairs of rows that share a key, by the left row's group, without joining rows.

    Both sides are hot on the key: a key of n rows stands for n * n pairs, of which a task sees one row a group.
    """
    return eager_join_aggregate(reviews, reviews.select(F.col(key), F.lit("all").alias("_all")), key, key, [group], ["_all"], measure).drop("_all")
