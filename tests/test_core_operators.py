import random
import time
from datetime import date, datetime, timedelta, timezone
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import asof, campaigns, eager, evaluation, graph, ingest, rings, rolling

FEED = "source_file string, source_row bigint, format string, raw string, reason string"
GOOD = "u,p,a,t,x,5,1700000000000,true"


@pytest.mark.parametrize(
    "fmt,raw,reason",
    [
        ("csv", GOOD, None),
        ("csv", 'u,p,a,"t, ""q""",x,4.5,1700000000000,', None),
        ("csv", 'u,p,a,"t,x,5,1700000000000,true', "malformed_record"),
        ("csv", 'u,p,a,"t"z,x,5,1700000000000,true', "malformed_record"),
        ("csv", 'u,p,a,t"z,x,5,1700000000000,true', "malformed_record"),
        ("csv", "u,p,a", "wrong_column_count"),
        ("csv", " ,p,a,t,x,5,1700000000000,true", "missing_required_ids"),
        ("csv", "u,p,a,t,x,5,,true", "missing_timestamp"),
        ("csv", "u,p,a,t,x,five,1700000000000,true", "rating_out_of_range"),
        ("jsonl", "[1]", "not_an_object"),
        ("jsonl", '{"a": NaN}', "malformed_record"),
        ("jsonl", '{"a": 1} x', "malformed_record"),
        ("jsonl", '{"user_id": "u", "parent_asin": "p", "timestamp": 1, "rating": true}', "rating_out_of_range"),
        ("jsonl", '{"user_id": "u", "parent_asin": "p", "timestamp": 1, "rating": 5e0}', "rating_out_of_range"),
        ("jsonl", '{"user_id": "u", "parent_asin": null, "timestamp": 1, "rating": 5}', "missing_required_ids"),
        ("jsonl", "[" * 100000, "malformed_record"),
    ],
)
def test_first_reason(fmt, raw, reason):
    assert ingest.parse_line(fmt, raw)[0] == reason


def test_records_are_assembled_across_lines():
    assert list(ingest.assemble(iter(['a,"b', 'c",d', "e"]))) == ['a,"b\nc",d', "e"]


def test_feed(spark):
    js = '{"user_id": "u", "parent_asin": "p", "asin": %s, "title": "t", "text": "x", "rating": 5.0, "timestamp": %s}'
    data = [("f", 1, "csv", GOOD, "clash"), ("f", 3, "csv", GOOD, None), ("g", 2, "csv", GOOD, None), ("f", 2, "csv", "  ", None), ("f", 4, "csv", None, None), ("h", 1, "jsonl", js % ("null", 1700000000000), None), ("h", 2, "jsonl", js % ('""', '"1700000000000"'), None), ("h", 3, "jsonl", js % ('"z"', '"yesterday"'), None), ("h", 4, "jsonl", js % ('"z"', '"yesterday"'), None), ("i", 1, "csv", "u,p,a,t," + "x" * 300_000 + ",5,1700000000000,true", None)]
    feed = spark.createDataFrame(data, FEED)
    got = {tuple(r) for r in ingest.rejected_lines(feed).collect()}
    assert got == {("f", 3, "exact_duplicate"), ("h", 2, "exact_duplicate"), ("h", 3, "implausible_timestamp"), ("h", 4, "exact_duplicate")}
    for r in ingest.audit(feed).collect():
        assert r.read_rows == r.accepted + r.duplicates + r.rejected == (1 if r.source_file in "gi" else 2 if r.source_file == "f" else 4)
    assert ingest.accepted_reviews(feed).count() == 4
    assert ingest.rejected_lines(feed.filter("false")).count() == 0


def test_reconcile_compares_reasons_and_keeps_every_file(spark):
    bad = [("f", 1, "csv", GOOD), ("f", 2, "csv", "u,p,a"), ("f", 3, "csv", 'u,"p'), ("g", 1, "csv", "u,p,a"), ("h", 1, "csv", GOOD)]
    feed = spark.createDataFrame(bad, "source_file string, source_row bigint, format string, raw string")
    audits = [("f", 3, 2, 1, 0, 1, {"wrong_column_count": 1}), ("g", 1, 1, 0, 0, 1, {"missing_timestamp": 1}), ("gone", 5, 5, 5, 0, 0, {})]
    earlier = spark.createDataFrame(audits, "source_file string, last_source_row bigint, read_rows bigint, accepted bigint, duplicates bigint, rejected bigint, reasons map<string,bigint>")
    got = {r.source_file: r for r in ingest.reconcile(feed, earlier).collect()}
    assert {k: r.reconciled for k, r in got.items()} == {"f": True, "g": False, "gone": False, "h": False}
    assert got["f"].reasons == {"wrong_column_count": 1, "malformed_record": 1} and got["f"].earlier_scope_reasons == {"wrong_column_count": 1}
    assert got["gone"].read_rows == 0 and got["gone"].earlier_read == 5


def test_as_of_brute_force(spark):
    rng = random.Random(3)
    versions = [(i, rng.choice("abc"), rng.choice([None, *range(9)]), rng.choice([None, *range(9)])) for i in range(60)] * 2
    events = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.choice([None, *range(10)])) for i in range(200)]
    v = spark.createDataFrame(versions, "version_id bigint, entity string, v bigint, k bigint")
    e = spark.createDataFrame(events, "id bigint, entity string, event_us bigint")
    got = {r.id: r.version_id for r in asof.asof_join(e, asof.current_states(v, "entity", "v", "k", "version_id"), ["id"], ["version_id"]).collect()}
    for i, who, t in events:
        ok = [(a, k, n) for n, w, a, k in versions if None not in (w, a, k, who, t) and w == who and a <= t and k <= t]
        assert got[i] == (max(ok)[2] if ok else None)
    assert asof.asof_join(e.filter("false"), asof.current_states(v.filter("false"), "entity", "v", "k", "version_id"), ["id"], ["version_id"]).count() == 0


def test_eager_equals_plain_join(spark):
    rng = random.Random(5)
    a = spark.createDataFrame([(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, "x", "y"]), rng.choice([None, 1.5, 2.0])) for _ in range(300)], "k int, g string, m double")
    b = spark.createDataFrame([(rng.choice([None, 1, 1, 2, 4]), rng.choice([None, "p", "q"])) for _ in range(100)], "k int, g2 string")
    got = {tuple(r) for r in eager.eager_join_aggregate(a, b, "k", "k", ["g"], ["g2"], "m").collect()}
    plain = a.join(b, "k").filter("g is not null and g2 is not null").groupBy("g", "g2").agg(F.count("*"), F.count("m"), F.round(F.avg("m"), 6))
    assert got == {tuple(r) for r in plain.collect()}
    assert eager.eager_join_aggregate(a.filter("false"), b, "k", "k", ["g"], ["g2"], "m").count() == 0
    assert {tuple(r) for r in eager.heavy_keys(a, ["g"], 0.02).collect()} == {("g", "x"), ("g", "y")}


def _log(spark, seed=7):
    rng = random.Random(seed)
    t0 = datetime(2023, 3, 1, tzinfo=timezone.utc)
    rows = [(f"r{i}", rng.choice(["a", "b", None]), rng.choice([None, *(t0 + timedelta(days=rng.randint(0, 60), seconds=rng.randint(0, 3)) for _ in range(5))]), rng.choice([None, 1.0, 4.5])) for i in range(150)]
    return rows, spark.createDataFrame(rows + rows[:40], "id string, who string, ts timestamp, rating double")


def test_rolling_brute_force_and_state(spark):
    rows, df = _log(spark)
    got = {(r.who, r.day): r for r in rolling.rolling_daily(df, "who", "ts", "id", "rating", last_day="2023-06-30").collect()}
    for (who, day), r in got.items():
        d = datetime.fromisoformat(day).date()
        for n in (7, 30):
            x = [q for _, w, t, q in rows if w == who and t and timedelta(0) <= d - t.date() < timedelta(days=n)]
            assert r[f"n_{n}d"] == len(x) and abs(r[f"total_{n}d"] - sum(q for q in x if q)) < 1e-9
    assert rolling.rolling_daily(df.filter("false"), "who", "ts", "id", "rating", last_day="2023-06-30").count() == 0


def _days(states, corrected=None):
    return {(r.entity, r.day): (r.n_7, r.n_30, r.units_7, r.units_30) for r in rolling.latest_days(states, corrected).collect() if r.n_30}


def test_rolling_state_by_blocks_and_corrections(spark):
    _, df = _log(spark)
    daily = rolling.daily_amounts(df, "who", "ts", "id", "rating").cache()
    last = date(2023, 5, 20)
    want = _days(rolling.stored_states(daily, last, block_days=1000))
    assert want and _days(rolling.stored_states(daily, last, block_days=11)) == want
    # two days advanced, then a correction: only these two days change, and the next block starts from them
    first, second = date(2023, 3, 1), date(2023, 3, 2)
    made = lambda rows: spark.createDataFrame(rows, "entity string, day date, n bigint, n_measured bigint, units bigint")
    base = made([("x", first, 5, 5, 50), ("x", second, 1, 1, 10)])
    states = rolling.advance(rolling.empty_state(base, (7, 30)), base, first, second)
    fix = rolling.correct(states, made([("x", first, 2, 2, 20)]), first, second)
    assert {(r.day, r.n_7, r.version) for r in fix.collect()} == {(first, 7, 1), (second, 8, 1)}
    days = _days(states, fix)
    assert days[("x", first)][0] == 7 and days[("x", second)][0] == 8 and len(days) == 2
    both = states.unionByName(fix)
    closing = rolling.closing_state(both, second)
    assert [r.n_7 for r in closing.collect()] == [8]
    later = rolling.advance(closing, made([("x", first, 7, 7, 70), ("x", second, 1, 1, 10)]), date(2023, 3, 3), date(2023, 3, 12))
    got = {d: n for (_, d), (n, *_) in _days(later).items()}
    assert [got.get(date(2023, 3, k), 0) for k in (3, 7, 8, 9, 10)] == [8, 8, 1, 0, 0]
    late = rolling.correct(states, made([("y", date(2023, 3, 9), 1, 1, 1)]), first, second)
    assert late.count() == 0


def test_matching_is_optimal():
    rng = random.Random(1)
    for n, m in ((3, 3), (2, 4), (4, 3), (1, 1)):
        w = [[rng.random() for _ in range(m)] for _ in range(n)]
        best = sum(w[i][j] for i, j in evaluation.best_matching(w))
        k = max(n, m)
        brute = max(sum(w[i][p[i]] for i in range(n) if p[i] < m) for p in permutations(range(k)))
        assert abs(best - brute) < 1e-9
    assert evaluation.best_matching([]) == []


def test_matching_of_many_sets_with_few():
    """thousands of sets that touch three; the work follows the pairs, and ties go to the first ids."""
    began = time.process_time()
    w = [[0.25, 0.25, 0.5 if i == 2999 else 0.25] for i in range(3000)]
    assert evaluation.best_matching(w) == [(0, 0), (1, 1), (2999, 2)]
    assert evaluation.best_matching([list(c) for c in zip(*w)]) == [(0, 0), (1, 1), (2, 2999)]
    assert time.process_time() - began < 3


def test_pruned_matching_is_optimal(spark):
    """the best pairs of the smaller side are enough, whichever side that is."""
    rng = random.Random(5)
    sets = lambda n, name: [(f"{name}{i:02d}", m) for i in range(n) for m in rng.sample(range(12), 4)]
    for few, many in ((sets(3, "p"), sets(30, "t")), (sets(30, "p"), sets(3, "t"))):
        p, t = spark.createDataFrame(few, "p string, member int"), spark.createDataFrame(many, "t string, member int")
        ps, ts = ({k: {m for x, m in rows if x == k} for k, _ in rows} for rows in (few, many))
        iou = [[round(len(a & b) / len(a | b), 6) for b in ts.values()] for a in ps.values()]
        small, large = (iou, len(ts)) if len(ps) < len(ts) else ([list(c) for c in zip(*iou)], len(ps))
        best = max(sum(small[i][x[i]] for i in range(3)) for x in permutations(range(large), 3))
        got = campaigns.match_sets(p, t).collect()
        assert len({r.p for r in got}) == len({r.t for r in got}) == len(got) and sum(r.iou for r in got) == pytest.approx(best)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 14], "a int, b int")
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {(i, 0 if i <= 14 else 15) for i in range(31)}


def test_ring_priority_counts_overlap_above_chance(spark):
    full = [(f"r{i}{t}", f"m{i}", f"t{t}", 0, 0.5) for i in range(4) for t in range(3)]
    apart = [(f"q{i}{t}", f"n{i}", f"u{(i + t) // 2}", 0, 0.5) for i in range(9) for t in (0, 1, 2, 3)]
    df = spark.createDataFrame(full + apart, "review_id string, reviewer_id string, target_id string, us bigint, score double")
    got = rings.ring_table(df).collect()
    assert got
    for r in got:
        assert 0 < r.size_ref_mean < 1 and r.adjusted_overlap == pytest.approx(max(r.raw_overlap - r.size_ref_mean, 0), abs=2e-6)
        assert r.priority == pytest.approx(0.5 * r.mean_top_score + 0.3 * min(3 * r.adjusted_overlap, 1) + 0.2 * r.synchrony, abs=2e-6)


def test_co_target_edges_of_a_hot_reviewer(spark):
    """10,000 events of one reviewer on two targets, which 20,000 touches of others share within 30 days."""
    day = 86_400
    own = [(i, 0, i % 2, (i * 259 + 5) * 1_000_000) for i in range(10_000)]
    rest = [(100_000 + 2 * k + x, k, x, (k * 257 + x * 1000) * 1_000_000) for k in range(1, 10_001) for x in (0, 1)]
    df = spark.createDataFrame(own + rest, "review_id int, reviewer_id int, target_id int, us bigint")
    began = time.monotonic()
    got = {}
    for r in graph.co_target_edges(df).filter("dst in (1, 2, 500, 9999, 100041)").collect():
        got.setdefault(r.dst, {})[r.src] = r.available_at
    assert time.monotonic() - began < 60
    every = [(i, u, x, us // 1_000_000) for i, u, x, us in own + rest]
    for d in (1, 2, 500, 9999, 100_041):
        _, me, _, now = next(e for e in every if e[0] == d)
        held, latest = {}, {}
        for i, u, x, at in every:
            if now - 30 * day <= at < now:
                held.setdefault(u, set()).add(x)
                latest[u] = max(latest.get(u, (0, 0)), (at, i))
        mine = held.pop(me, set())
        best = sorted((-len(mine & xs), u) for u, xs in held.items() if len(mine & xs) >= 2)[:10]
        assert got.get(d, {}) == {latest[u][1]: latest[u][0] for _, u in best}


def test_causal_edges_against_sql_in_both_ways(spark, duck):
    """events counted one by one, by rise and fall, and over several shards give what the SQL gives."""
    from tests.conftest import SF
    from tidegraph.plans import core

    want = sorted(duck.execute(core.SQL["edges_co_target"]).fetchall())
    assert want
    for how in ({"often": 0}, {"often": 2, "rows": 50}):
        assert sorted(map(tuple, graph.co_target_edges(core.log_reviews(spark, SF), **how).collect())) == want


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_recent_edges_stream_over_batches(spark, batch):
    """logs stream through Arrow batches of any size, without a list for each row; ties of a second see the same past, spans of time hide nothing."""
    rng = random.Random(batch)
    day = 86_400
    rows = [(i, rng.choice(["a", "a", "b", None]), i % 5, rng.choice([rng.randrange(40 * day), 13 * day, 14 * day - 1, 14 * day, 21 * day]) * 1_000_000 + i % 3) for i in range(300)] + [(900, "a", 1, None), (901, "b", 1, -5 * day * 1_000_000)]
    df = spark.createDataFrame(rows, "review_id int, reviewer_id string, target_id int, us long").repartition(4)
    plain = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for most in (1, 4, 20):
            e = graph.recent_edges(df, "reviewer_id", 7, most, "r")
            assert "collect_list" not in e._jdf.queryExecution().toString()
            got = sorted(map(tuple, e.collect()))
            want = []
            known = [(i, u, us // 1_000_000) for i, u, _, us in rows if u is not None and us is not None]
            for i, u, at in known:
                past = sorted(((s, j) for j, v, s in known if v == u and at - 7 * day <= s < at), reverse=True)[:most]
                want += [(j, i, "r", s) for s, j in past]
            assert got == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", plain)


def test_overlap_of_equal_and_dense_sets(spark):
    """equal target sets are compared once, dense components as matrices; both ways give the pairwise mean."""
    rng = random.Random(3)
    rows = [(c, u, x) for c in (1, 2) for u in range(60) for x in rng.sample(range(6), rng.randint(1, 4))] + [(2, 7, None), (2, None, 3), (3, 1, 1), (None, 1, None)]
    df = spark.createDataFrame(rows + rows[:50], "component int, reviewer_id int, target_id int")
    want = {}
    for c in (1, 2):
        sets = {u: {x for d, v, x in rows if (d, v) == (c, u)} for u in {v for d, v, _ in rows if d == c}}
        pairs = [(sets[u], sets[v]) for u in sets for v in sets if u is not None and v is not None and u < v]
        want[c] = sum(len((a & b) - {None}) / (len(a) + len(b) - len((a & b) - {None})) for a, b in pairs) * 2 / (len(sets) * (len(sets) - 1))
    for how in ({}, {"joined": 0}, {"joined": 0, "block": 9}):
        got = {r.component: r.raw_overlap for r in rings.overlap(df, **how).collect()}
        assert got == pytest.approx(want, abs=2e-6)
    many = spark.range(400_000).select(F.lit(1).alias("component"), (F.col("id") / 4).cast("long").alias("reviewer_id"), (F.col("id") % 4).alias("target_id"))
    assert [tuple(r) for r in rings.overlap(many).collect()] == [(1, 1.0)]  # 100,000 reviewers: 5 billion pairs


def test_ring_projection_covers_all_reviews(spark, duck):
    from tests.conftest import SF
    from tidegraph.plans import core
    from tidegraph.sources.tables import table

    sql = "WITH p AS (SELECT DISTINCT reviewer_id r, target_id t FROM reviews WHERE reviewer_id IS NOT NULL AND target_id IS NOT NULL) SELECT x.r, y.r, count(*), 2 * count(*) - 1 FROM p x JOIN p y ON x.t = y.t AND x.r < y.r GROUP BY 1, 2 HAVING count(*) >= "
    assert sorted(map(tuple, core.QUERIES["ring_projection"](spark, SF).collect())) == sorted(duck.execute(sql + "2").fetchall())
    for least, how in ((2, {"block": 5, "large": 3}), (3, {"block": 7, "large": 20})):
        assert sorted(map(tuple, graph.shared_target_pairs(table(spark, SF, "reviews"), least, **how).collect())) == sorted(duck.execute(sql + str(least)).fetchall())


def test_ring_projection_of_hot_targets(spark, duck):
    """pairs on hot targets come from masks, whatever counts as hot; none is lost or counted twice."""
    from tests.conftest import SF
    from tidegraph.sources.tables import table

    sql = "WITH p AS (SELECT DISTINCT reviewer_id r, target_id t FROM reviews WHERE reviewer_id IS NOT NULL AND target_id IS NOT NULL) SELECT x.r, y.r, count(*), 2 * count(*) - 1 FROM p x JOIN p y ON x.t = y.t AND x.r < y.r GROUP BY 1, 2 HAVING count(*) >= "
    for least, how in ((2, {"hot": 2, "block": 9}), (2, {"hot": 12}), (3, {"hot": 3, "block": 20, "large": 20})):
        assert sorted(map(tuple, graph.shared_target_pairs(table(spark, SF, "reviews"), least, **how).collect())) == sorted(duck.execute(sql + str(least)).fetchall())


def test_future_events_leave_the_past_alone(spark):
    base = [(i, i % 3, i % 2, i * 3_600_000_000, 3.0) for i in range(40)]
    schema = "review_id int, reviewer_id int, target_id int, us bigint, rating double"
    from tidegraph.operators.history import history

    a = {r.review_id: r for r in history(spark.createDataFrame(base, schema)).collect()}
    b = {r.review_id: r for r in history(spark.createDataFrame(base + [(99, 0, 0, 10**12, 1.0)], schema)).collect()}
    assert all(a[i] == b[i] for i in a)


def test_stream_equals_batch(spark, tmp_path):
    from tidegraph.streaming.replay import run_once, streaming_daily

    e = spark.range(500).select((F.timestamp_seconds(F.col("id") * 3000)).alias("ts"), (F.col("id") % 10 / 10).alias("score"))
    last = e.agg(F.max("ts")).first()[0]
    late = spark.createDataFrame([(last + timedelta(days=9), 0.0)], "ts timestamp, score double")  # moves the watermark past every day before
    e.unionByName(late).repartition(1).write.parquet(f"{tmp_path}/in")
    run_once(streaming_daily(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"), 0.5), f"{tmp_path}/out", f"{tmp_path}/cp", "append")
    got = {tuple(r) for r in spark.read.schema("day string, n_scored bigint, alerts bigint").parquet(f"{tmp_path}/out").collect()}
    batch = {tuple(r) for r in e.groupBy(F.date_format("ts", "yyyy-MM-dd")).agg(F.count("*"), F.count_if(F.col("score") >= 0.5)).collect()}
    assert got == batch
