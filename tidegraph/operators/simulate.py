"""A simulator of campaigns and harmless look-alikes, planted beside background reviews.

The driver designs campaigns only: one row each, their number bounded by the quotas. Everything else, accounts, targets,
times, ratings and texts, is drawn by the tasks from seeded md5 shares of (seed, campaign, member, target), so a design
always grows into the same rows, on any cluster. Background rows are never changed or relabelled.

Defined results: quotas of 0 give no campaigns; a partition without targets or of no length gets none; times never leave
their partition (they end a minute before it); ids hold a running number and can't collide.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from random import Random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.operators.evaluation import ROLES, leak_check
from tidegraph.operators.records import assert_no_leak, background_labels, final_roles, members_of, union_all

DAY, MINUTE = 86_400_000_000, 60_000_000
#: Families of the manipulative campaigns; the last is held out for the test partition.
FAMILIES, HELD_OUT_FAMILY = ("template_wave", "paraphrase_wave"), "burstwave"
CONTROLS = ("launch_burst", "repeat_customer", "isolated", "binge_shopper")


@dataclass(frozen=True)
class Plan:
    """What is planted in each partition."""

    positive_rows: int = 800
    negative_rows: int = 560
    n_campaigns: int = 10
    n_controls: int = 8
    accounts: tuple[int, int] = (4, 12)
    targets: tuple[int, int] = (2, 5)
    duration_days: tuple[int, ...] = (1, 7, 30)
    duration_share: tuple[float, ...] = (0.25, 0.35, 0.40)
    shared_activity: tuple[float, ...] = (0.3, 0.5, 0.8)
    mixed_share: float = 0.6
    ordinary_mix: float = 0.3
    least_held_out: int = 3
    openers: tuple[str, ...] = field(default=("Bought this for daily use", "Came in a plain box", "Ordered two of these", "My neighbour has the same one", "Used it for a week"))
    praise: tuple[str, ...] = field(default=("works better than expected", "well worth having", "would buy again", "fits perfectly"))
    blame: tuple[str, ...] = field(default=("broke on the second day", "looks nothing like the picture", "not worth the money", "sent it back"))
    closers: tuple[str, ...] = field(default=("no more to say", "hope this helps", "delivery was on time", "that is all"))


def design(bounds: dict[str, tuple[int, int]], plan: Plan, seed: int = 42) -> list[tuple]:
    """One tuple for each campaign: id, partition, family, manipulative, accounts, targets, start, length, sentiment, shared, mix, seed.

    bounds: first and last microsecond of each role. Campaigns are added until both the quota of rows and the least
    number of campaigns are reached; the held-out family stands in the test partition alone.
    """
    out: list[tuple] = []
    for at, role in enumerate(r for r in ROLES if r in bounds):
        lo, hi = bounds[role]
        rng = Random(seed + 1000 * (at + 1))
        if hi - lo <= MINUTE:
            continue
        for kind, quota, least in (("c", plan.positive_rows, plan.n_campaigns), ("n", plan.negative_rows, plan.n_controls)):
            rows, n = 0, 0
            held_out = max(least // 3, plan.least_held_out) if kind == "c" and role == ROLES[-1] and quota else 0
            while quota and (rows < quota or n < least):
                if kind == "c":
                    family = HELD_OUT_FAMILY if n < held_out else FAMILIES[n % len(FAMILIES)]
                    accounts, targets = rng.randint(*plan.accounts), rng.randint(*plan.targets)
                    days = 1 if family == HELD_OUT_FAMILY else rng.choices(plan.duration_days, plan.duration_share)[0]
                else:
                    family = CONTROLS[n % len(CONTROLS)]
                    accounts, targets, days = {"launch_burst": (rng.randint(6, 16), 1, 3), "repeat_customer": (1, rng.randint(2, 3), 60), "isolated": (1, 1, 1), "binge_shopper": (1, rng.randint(6, 12), 1)}[family]
                length = min(days * DAY, hi - lo - MINUTE)
                start = rng.randint(lo, hi - MINUTE - length)
                mix = plan.ordinary_mix if kind == "c" and rng.random() < plan.mixed_share else 0.0
                out.append((f"{role}-{kind}{n:04d}", role, family, kind == "c", accounts, targets, start, length, rng.choice((1, -1)) if kind == "c" else 0, rng.choice(plan.shared_activity) if kind == "c" else 1.0, mix, seed))
                rows += accounts * targets
                n += 1
    return out


DESIGN = "campaign_id string, partition string, family string, is_manipulative boolean, n_accounts int, n_targets int, start_us bigint, length_us bigint, sentiment int, shared double, mix double, seed bigint"


def share(*parts: Column | str) -> Column:
    """A share in [0, 1) from the md5 of the parts; the same in any engine."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def _pick(values: tuple[str, ...], *parts: Column | str) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.floor(share(*parts) * len(values)) + 1).cast("int"))


def grow(designs: DataFrame, targets: DataFrame, plan: Plan) -> DataFrame:
    """The reviews of the designed campaigns; targets: (target_id, rank from 0), the catalogue they draw from.

    Each account of a manipulative campaign reviews a target with the campaign's shared share (its first two always), a
    control account every target. A share `mix` of a campaign's rows is ordinary in rating and text.
    """
    n = targets.count()
    c = designs.filter("n_accounts > 0 and n_targets > 0") if n else designs.filter("false")
    c = c.withColumn("account", F.explode(F.sequence(F.lit(0), F.col("n_accounts") - 1))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n_targets") - 1)))
    key = (F.col("seed"), F.col("campaign_id"), F.col("account"), F.col("t"))
    c = c.filter(~F.col("is_manipulative") | (F.col("t") < 2) | (share("act", *key) < F.col("shared")))
    c = c.withColumn("_rank", F.pmod(F.floor(share("target", F.col("seed"), F.col("campaign_id")) * n).cast("long") + F.col("t"), F.lit(max(n, 1)).cast("long")))
    c = c.join(targets.select("target_id", F.col("rank").alias("_rank")), "_rank")
    ordinary = share("mix", *key) < F.col("mix")
    us = F.col("start_us") + F.floor(share("time", *key) * F.col("length_us")).cast("long")
    free = (F.floor(share("rating", *key) * 5) + 1).cast("double")
    rating = F.when(F.col("is_manipulative") & ~ordinary, F.when(F.col("sentiment") > 0, 5.0).otherwise(1.0)).otherwise(free)
    mood = lambda *k: F.when(rating >= 3, _pick(plan.praise, *k)).otherwise(_pick(plan.blame, *k))
    one, own = (F.col("seed"), F.col("campaign_id")), key
    varied = F.concat_ws(", ", _pick(plan.openers, "o", *own), mood("m", *own), _pick(plan.closers, "c", *own))
    template = F.concat_ws(", ", _pick(plan.openers, "o", *one), mood("m", *one), _pick(plan.closers, "c", *one))
    paraphrase = F.concat_ws(", ", _pick(plan.openers, "o", *own), mood("m", *one), _pick(plan.closers, "c", *one))
    text = F.when(~F.col("is_manipulative") | ordinary, varied).when(F.col("family") == "paraphrase_wave", paraphrase).otherwise(template)
    account = F.concat(F.lit("sim:"), "campaign_id", F.lit("-a"), F.col("account").cast("string"))
    flag = F.conv(F.substring(F.md5(account), 1, 2), 16, 10).cast("int") % 5 != 0
    number = F.format_string("%04d%04d", "account", "t")
    return c.select(F.concat(F.lit("sim:"), "campaign_id", F.lit("-"), number).alias("review_id"), account.alias("reviewer_id"), "target_id", F.timestamp_micros(us).alias("timestamp"), text.alias("text"), rating.alias("rating"), F.lit("sim").alias("source"), flag.alias("verified_purchase"), F.lit(False).alias("text_missing"), "campaign_id", "partition", "family", "is_manipulative", ordinary.alias("ordinary"))


def planted_tables(grown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, campaigns): a row is positive if its campaign is manipulative; member lists by campaign."""
    labels = grown.select("review_id", F.col("is_manipulative").cast("int").alias("label"), F.lit("synthetic").alias("label_source"), "campaign_id", F.lit(True).alias("is_synthetic"))
    campaigns = grown.groupBy("campaign_id").agg(F.first("partition").alias("partition"), F.first("family").alias("family"), F.first("is_manipulative").alias("is_manipulative"), F.array_sort(F.collect_list("review_id")).alias("member_review_ids"))
    return labels, campaigns


def simulation_stats(grown: DataFrame) -> DataFrame:
    """(partition, family, is_manipulative, n_campaigns, n_rows, n_accounts, n_targets)."""
    return grown.groupBy("partition", "family", "is_manipulative").agg(F.count_distinct("campaign_id").alias("n_campaigns"), F.count("*").alias("n_rows"), F.count_distinct("reviewer_id").alias("n_accounts"), F.count_distinct("target_id").alias("n_targets"))


def ranked_targets(reviews: DataFrame) -> DataFrame:
    """(target_id, rank): targets by name from 0; ranks are running totals over ranges."""
    from tidegraph.functions.prefix import running_totals

    t = reviews.filter("target_id is not null").select("target_id").distinct().withColumn("one", F.lit(1))
    return running_totals(t, [F.col("target_id")], ["one"]).select("target_id", (F.col("cum_one") - 1).alias("rank"))


def simulate(reviews: DataFrame, splits: DataFrame, plan: Plan = Plan(), seed: int = 42) -> dict[str, DataFrame]:
    """reviews, labels, campaigns, splits and grown: background and planted rows together; raises if a campaign spans roles.

    reviews need review_id, reviewer_id, target_id and timestamp; splits (node_key, role) give each role's bounds in time.
    """
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    r = splits.filter(F.col("role").isin(*ROLES)).select(F.col("node_key").alias("review_id"), "role").distinct()
    span = reviews.filter("timestamp is not null").select("review_id", us.alias("us")).join(r, "review_id").groupBy("role").agg(F.min("us").alias("a"), F.max("us").alias("b")).collect()  # a row for each role
    designs = reviews.sparkSession.createDataFrame(design({x.role: (x.a, x.b) for x in span}, plan, seed), DESIGN)
    grown = grow(designs, ranked_targets(reviews), plan)
    labels, campaigns = planted_tables(grown)
    every = union_all(reviews, grown.drop("campaign_id", "partition", "family", "is_manipulative", "ordinary"))
    roles = final_roles(every, splits, campaigns).withColumnRenamed("review_id", "node_key")
    assert_no_leak(leak_check(members_of(campaigns), roles.withColumnRenamed("node_key", "review_id")))
    return {"reviews": every, "labels": union_all(background_labels(reviews), labels), "campaigns": campaigns, "splits": roles, "grown": grown}
