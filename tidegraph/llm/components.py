"""Groups from pairwise matches by random contraction.

Each round every vertex hooks to the vertex that comes first, among itself and its neighbours, in a fresh hash order;
edges are relabelled by the hooks, loops and repeats dropped, and the round's map is kept. A round removes a constant
share of the vertices in expectation, whatever the graph's shape, so long chains need no more rounds than stars. When
no edge is left the maps are composed from the last to the first; their sizes shrink geometrically, so this costs about
as much as the first join. Each round is written to the shared folder, and only row counts reach the driver.

Defined results: null ends and loops link nothing (a node known only from them has no row); repeated edges and either
order count once; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.session import cut


def _canonical(edges: DataFrame) -> DataFrame:
    e = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return e.distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 200) -> DataFrame:
    """(node, component): each linked node with the smallest node of its component.

    Nodes are strings compared by bytes. A hub's edges are reduced by min_by with map-side combine before they move.
    """
    e = cut(_canonical(edges.select(F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b"))), "edges")
    maps: list[DataFrame] = []
    rounds = 0
    while not e.isEmpty():
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        both = e.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("x")).select("x.v", "x.u")
        order = lambda c, r=rounds: F.xxhash64(F.lit(r), F.col(c))
        near = both.groupBy("v").agg(F.min(F.struct(order("u").alias("h"), F.col("u"))).alias("m"))
        hook = near.select("v", F.when(F.struct(order("v").alias("h"), F.col("v").alias("u")) <= F.col("m"), F.col("v")).otherwise(F.col("m.u")).alias("r"))
        hook = cut(hook, "hooks")
        maps.append(hook)
        e = e.join(hook.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a").join(hook.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
        e = cut(_canonical(e.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    root = maps[-1]
    for hook in reversed(maps[:-1]):
        later = root.select(F.col("v").alias("r"), F.col("r").alias("end"))
        root = cut(hook.join(later, "r", "left").select("v", F.coalesce("end", "r").alias("r")), "roots")
    least = root.groupBy("r").agg(F.min("v").alias("component"))
    return root.join(least, "r").select(F.col("v").alias("node"), "component")


def member_links(lists: DataFrame, list_col: str, id_col: str) -> DataFrame:
    """(src, dst): each list's smallest member with the other members; nulls and repeats inside a list are dropped."""
    m = lists.filter(F.col(list_col).isNotNull()).select(F.array_sort(F.array_distinct(F.array_compact(list_col))).alias("m"))
    return m.filter("size(m) > 1").select(F.col("m")[0].alias("src"), F.explode(F.slice("m", 2, 2147483647)).alias("dst"))


def reviewer_links(account_links: DataFrame, ring_candidates: DataFrame, least_shared: int = 2) -> DataFrame:
    """Links between reviewers from pairs with enough shared targets and from candidates' member lists."""
    pairs = account_links.filter((F.col("shared_targets") >= least_shared) & F.col("reviewer_a").isNotNull() & F.col("reviewer_b").isNotNull()).select(F.col("reviewer_a").alias("src"), F.col("reviewer_b").alias("dst"))
    return pairs.unionByName(member_links(ring_candidates, "members", "candidate_id"))


def reviewer_groups(account_links: DataFrame, ring_candidates: DataFrame, least_shared: int = 2) -> DataFrame:
    """(reviewer_id, group_id) of every reviewer linked to another one."""
    c = connected_components(reviewer_links(account_links, ring_candidates, least_shared), "src", "dst")
    return c.select(F.col("node").alias("reviewer_id"), F.col("component").alias("group_id"))


def group_summary(account_links: DataFrame, ring_candidates: DataFrame, least_shared: int = 2) -> DataFrame:
    """(group_id, n_reviewers, components_merged): the candidates that a group joins are those with a member in it.

    A candidate of a single reviewer who is linked elsewhere counts too; one without any linked member belongs nowhere.
    """
    groups = cut(reviewer_groups(account_links, ring_candidates, least_shared), "groups")
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n_reviewers"))
    first = ring_candidates.select("candidate_id", F.explode(F.array_distinct(F.array_compact("members"))).alias("reviewer_id")).join(groups, "reviewer_id")
    merged = first.groupBy("group_id").agg(F.count_distinct("candidate_id").alias("components_merged"))
    return sizes.join(merged, "group_id", "left").select("group_id", "n_reviewers", F.coalesce("components_merged", F.lit(0)).cast("long").alias("components_merged"))
