import gzip
import hashlib
import json
import random
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.operators import campaigns, evaluation, experiments, experts, explain, fusion, graph, ingest, records, rings, simulate
from tidegraph.sources import files, sinks

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


# -- files and sinks ---------------------------------------------------------------------------------------------------


def test_lines_keep_their_physical_number(spark, tmp_path):
    rows = [json.dumps({"user_id": "u", "i": i}) if i % 7 else "  " for i in range(500)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows) + "\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("x,y\n\nz,w\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = {(r.source_file, r.source_row): (r.format, r.raw, r.source_file_hash) for r in files.feed(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {("a.jsonl", i): ("jsonl", r) for i, r in enumerate(rows) if r.strip()} | {("b.csv.gz", 0): ("csv", "x,y"), ("b.csv.gz", 2): ("csv", "z,w")}
    assert {k: v[:2] for k, v in got.items()} == want
    assert got[("a.jsonl", 1)][2] == hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest()
    assert got[("b.csv.gz", 0)][2] == hashlib.sha256((tmp_path / "b.csv.gz").read_bytes()).hexdigest()


def test_records_may_span_lines_where_a_feed_says_so(spark):
    tail = ",x,5,1700000000000,true"
    raw = ['u,p,a,"one', "two", 'three"' + tail, "u,p,a,t" + tail, 'u,p,a,"open' + tail, "v,p,a,t" + tail, 'w,p,a,"also' + tail]
    feed = spark.createDataFrame([("f", i, "csv", r) for i, r in enumerate(raw)], "source_file string, source_row bigint, format string, raw string")
    reasons = lambda b: {r.source_row: r.reason for r in ingest.classify_feed(feed, b).collect()}
    assert reasons(True) == {0: None, 3: None, 4: "malformed_record", 5: None, 6: "malformed_record"}
    assert reasons(False) == {0: "malformed_record", 1: "wrong_column_count", 2: "malformed_record", 3: None, 4: "malformed_record", 5: None, 6: "malformed_record"}
    assert ingest.classify_feed(feed.filter("false"), True).count() == 0


def test_configurations_merge(tmp_path):
    (tmp_path / "a.json").write_text('{"paths": {"out": "o", "in": "i"}, "n": 1}')
    (tmp_path / "b.json").write_text('{"paths": {"out": "p"}, "m": [1]}')
    c = files.load_config(str(tmp_path / "a.json"), str(tmp_path / "b.json"))
    assert c == {"paths": {"out": "p", "in": "i"}, "n": 1, "m": [1]}
    assert files.resolve_paths(c, "/r")["paths"] == {"out": "/r/p", "in": "/r/i"}
    assert files.inspect_config(files.resolve_paths(c, str(tmp_path))) == [("paths.in", str(tmp_path / "i"), False), ("paths.out", str(tmp_path / "p"), False)]
    (tmp_path / "c.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.load_config(str(tmp_path / "c.json"))


def test_static_graph_is_checked(spark, tmp_path):
    nodes = spark.createDataFrame([(i, [1.0, 2.0], int(i > 9)) for i in range(12)], "node_idx bigint, features array<double>, label int")
    edges = spark.createDataFrame([(0, 1, "rur"), (1, 2, "rtr"), (11, 0, "rtr")], "src bigint, dst bigint, relation string")
    sinks.write_table(nodes, f"{tmp_path}/n"), sinks.write_table(edges, f"{tmp_path}/e")
    n, e = files.static_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e", ("rur", "rtr"))
    assert n.count() == 12 and {(r.relation, r.src, r.dst) for r in e.collect()} == {("rur", 0, 1), ("rtr", 1, 2), ("rtr", 11, 0)}
    assert files.mask_unlabelled_prefix(n, 10).filter("labelled").count() == 2
    for bad in (lambda: files.static_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e", ("rsr",)), lambda: files.mask_unlabelled_prefix(n, 11), lambda: files.check_static_graph(n.filter("node_idx > 0"), e, ("rur",))):
        with pytest.raises(ValueError):
            bad()


def test_arrays_and_weights_round_trip(spark, tmp_path):
    x = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "x.npy", x), np.savez_compressed(tmp_path / "x.npz", a=x[:, 0])
    assert [r["values"] for r in files.array_rows(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == x.tolist()
    assert [r["values"] for r in files.array_rows(spark, str(tmp_path / "x.npz"), "a").orderBy("row").collect()] == x[:, :1].tolist()
    w = experts.init_layers([3, 5, 1], 1)
    sinks.save_weights(w, str(tmp_path / "w.json"))
    back = files.load_weights(str(tmp_path / "w.json"))
    assert files.layer_sizes(back) == [3, 5, 1] and np.array_equal(back["w0"], w["w0"])
    sinks.save_weights({"x": [1]}, str(tmp_path / "v.json"))
    with pytest.raises(ValueError):
        files.load_weights(str(tmp_path / "v.json"))


def test_cards_are_upserted_and_vectors_cached(spark, tmp_path):
    schema = "candidate_id string, n int"
    made = lambda rows: spark.createDataFrame(rows, schema)
    sinks.upsert_cards(made([("a", 1), ("b", 1)]), f"{tmp_path}/cards")
    got = sinks.upsert_cards(made([("b", 2), ("c", 2)]), f"{tmp_path}/cards")
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 2), ("c", 2)} == {tuple(r) for r in files.evidence(spark, f"{tmp_path}/cards", schema).collect()}
    sinks.write_cards(made([("z", 0)]), f"{tmp_path}/cards")
    assert files.evidence(spark, f"{tmp_path}/cards", schema).count() == 1
    asked = []

    def encode(df):
        asked.append(df.count())
        return df.select("key", F.array(F.length("text").cast("float")).alias("vector"))

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    assert sinks.cached_vectors(texts("a", "bb", "a", None), f"{tmp_path}/cache", "e", "1", encode).count() == 3
    assert sinks.cached_vectors(texts("a", "ccc"), f"{tmp_path}/cache", "e", "1", encode).count() == 2
    assert sinks.cached_vectors(texts("a"), f"{tmp_path}/cache", "e", "2", encode).count() == 1
    assert asked == [3, 1, 1]


def test_runs_reports_and_experiments(spark, tmp_path):
    with pytest.raises(FileExistsError):
        (tmp_path / "full").mkdir(), (tmp_path / "full" / "x").touch(), sinks.run_directory(str(tmp_path / "full"))
    runs = experiments.experiment(str(tmp_path / "e"), "a", ["prior", "text"], [1, 2], lambda m, s, _: s / 10 + (m == "text"))
    assert json.loads((tmp_path / "e/experiment.json").read_text())["status"] == "complete" and len(runs) == 4
    s = files.summaries(spark, str(tmp_path / "e"), experiments.RUN)
    assert s.count() == 4 and s.filter("run_folder = run_id").count() == 4
    text = experiments.collected(s, pairs=(("text", "prior"),))
    assert "| a | text | 2 | 1.1500 | 0.0707 |" in text and "| a | 2 | 1.0000 | 0.0000 |" in text
    with pytest.raises(RuntimeError):
        experiments.experiment(str(tmp_path / "f"), "a", ["prior"], [1], lambda *_: (_ for _ in ()).throw(RuntimeError("no")))
    assert json.loads((tmp_path / "f/experiment.json").read_text())["status"] == "failed"
    assert len(experiments.dry_run(str(tmp_path / "g"), ["prior", "graph"], lambda m, s, smoke: float(smoke))) == 2
    for bad in (lambda: experiments.experiment(str(tmp_path / "h"), "a", ["prior"], [1, 1], lambda *_: 0.0), lambda: experiments.check_arguments("x"), lambda: experiments.check_arguments("prior", epochs=0), lambda: experiments.check_arguments("graph", fanouts=(5,)), lambda: experiments.check_arguments("graph", n_train=0)):
        with pytest.raises(ValueError):
            bad()
    a, b = experiments.run_id("a", "m", 1, T0), experiments.run_id("a", "m", 1, T0 + timedelta(seconds=1))
    assert a < b and a.startswith("a-m-s1-")
    (tmp_path / "raw").write_text("x")
    sinks.write_json({"sha256": "h"}, str(tmp_path / "m.json"))
    assert [experiments.provenance(*p)["source"] for p in ((str(tmp_path / "raw"), None), ("gone", str(tmp_path / "m.json")), (None, None))] == ["file", "manifest", "unavailable"]
    assert experiments.run_manifest(spark, {"b": 1, "a": 2}, 1, "hashed", {})["config_sha256"] == hashlib.sha256(b'{"a":2,"b":1}').hexdigest()
    assert sinks.stage_manifest(str(tmp_path), "split", rows=3)["rows"] == 3 and (tmp_path / "split_manifest.json").exists()
    none = s.filter("false").select("run_id", "metric")
    assert "Nothing to report." in sinks.write_report(str(tmp_path / "r.md"), "R", {"runs": s.select("model", "metric"), "none": none})
    one = lambda q: spark.sql(q)
    f = sinks.figure_data(one("select 0.5 recall, 1.0 precision"), one("select '2024-01-01' day, 3 alerts"), one("select 'text' expert, 0.4 mean_weight"), one("select 'text' model, 1 epoch, 0.7 average_precision"))
    assert f.count() == 4 and f.select("figure").distinct().count() == 4


# -- records -----------------------------------------------------------------------------------------------------------


def test_checks_raise_with_what_they_found(spark):
    rows = spark.createDataFrame([("a", 1, "human"), ("a", 2, "rumour"), (None, None, None)], "review_id string, label int, label_source string")
    assert records.label_faults(rows).first().asDict() == {"repeated_ids": 1, "bad_sources": 2, "bad_labels": 1}
    with pytest.raises(ValueError, match="bad_labels"):
        records.must_be_clean(records.label_faults(rows), "labels")
    records.must_be_clean(records.label_faults(rows.filter("false")), "labels")
    assert records.prediction_faults(rows, 5).first().surplus_rows == -2
    with pytest.raises(ValueError, match="span"):
        records.assert_no_leak(spark.sql("select 'c' campaign_id, 2 n_roles"))


def test_roles_of_campaigns(spark):
    reviews = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "review_id string")
    splits = spark.createDataFrame([("a", "train"), ("b", "test"), ("b", "test")], "node_key string, role string")
    camp = spark.createDataFrame([("k", "validation", True, ["c", "c", None]), ("m", "test", False, ["a"])], "campaign_id string, partition string, is_manipulative boolean, member_review_ids array<string>")
    assert {r.review_id: r.role for r in records.final_roles(reviews, splits, camp).collect()} == {"a": "train", "b": "test", "c": "validation", "d": "train"}
    p = {r.campaign_id: (r.partition, r.spanning) for r in records.campaign_partitions(spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "z")], "campaign_id string, review_id string"), splits).collect()}
    assert p == {"x": ("test", True), "y": ("train", False)}
    assert records.planted(camp).count() == 0 and records.of_nodes(reviews, records.role_nodes(splits, "test")).count() == 1


def test_split_quotas_are_exact(spark):
    df = spark.createDataFrame([(i, i * 10, None if i > 400 else int(i % 4 == 0)) for i in range(413)], "review_id int, us bigint, label int")
    got = {(r.label, r.role): r["count"] for r in evaluation.stratified_split(df, "review_id", "label").groupBy("label", "role").count().collect()}
    assert got == {(0, "train"): 180, (0, "validation"): 45, (0, "calibration"): 30, (0, "test"): 45, (1, "train"): 60, (1, "validation"): 15, (1, "calibration"): 10, (1, "test"): 16, (None, "excluded"): 12}
    c = {r.role: r.n for r in evaluation.split_cutoffs(evaluation.chronological_split(df.limit(13))).collect()}
    assert c == {"train": 7, "validation": 1, "calibration": 1, "test": 4}
    with pytest.raises(ValueError):
        evaluation.chronological_split(df, (0.5, 0.2, 0.1, 0.1))


# -- simulation, rings, campaigns ----------------------------------------------------------------------------------------


def _background(spark, n=400):
    rng = random.Random(1)
    rows = [(f"r{i:04}", f"u{rng.randint(0, 80)}", f"t{rng.randint(0, 20):02}", T0 + timedelta(hours=i), "fine", float(rng.randint(1, 5)), "bg") for i in range(n)]
    splits = [(f"r{i:04}", "train" if i < 240 else "validation" if i < 300 else "calibration" if i < 340 else "test") for i in range(n)]
    return spark.createDataFrame(rows, "review_id string, reviewer_id string, target_id string, timestamp timestamp, text string, rating double, source string"), spark.createDataFrame(splits, "node_key string, role string")


def test_simulated_campaigns(spark):
    r, s = _background(spark)
    plan = simulate.Plan(positive_rows=60, negative_rows=40, n_campaigns=3, n_controls=4)
    t = {k: v.cache() for k, v in simulate.simulate(r, s, plan).items()}
    g = t["grown"]
    assert g.count() == g.select("review_id").distinct().count() and t["reviews"].count() == 400 + g.count()
    bounds = {x.role: (x.a, x.b) for x in r.join(s, r.review_id == s.node_key).groupBy("role").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()}
    for x in g.groupBy("partition").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect():
        assert bounds[x.partition][0] <= x.a and x.b <= bounds[x.partition][1] - timedelta(minutes=1)
    assert {x.partition for x in g.filter("family = 'burstwave'").collect()} == {"test"}
    assert t["labels"].filter("not is_synthetic and label is not null").count() == 0
    assert t["labels"].filter("label = 1").count() == g.filter("is_manipulative").count()
    stats = simulate.simulation_stats(g).collect()
    assert {(x.partition, x.is_manipulative) for x in stats} == {(p, m) for p in bounds for m in (True, False)}
    again = simulate.simulate(r, s, plan)["grown"]
    assert g.exceptAll(again).count() == 0 == again.exceptAll(g).count()
    assert simulate.simulate(r, s, simulate.Plan(positive_rows=0, negative_rows=0))["grown"].count() == 0


def test_planted_ring_is_found_and_explained(spark):
    ring = [(f"a{i}{t}", f"ring{i}", f"x{t}", i * 3600 + t, 0.95) for i in range(3) for t in range(2)]
    rest = [(f"b{i}", f"u{i % 30}", f"y{i % 10}", 864_000 + i * 9000, 0.1 + i / 1000) for i in range(60)]
    df = spark.createDataFrame(ring + rest, "review_id string, reviewer_id string, target_id string, sec bigint, score double").withColumn("us", F.col("sec") * 1_000_000)
    found = rings.ring_table(df, top_k=6).cache()
    assert [(r.ring_id, r.members, r.targets) for r in found.collect()] == [("ring-0000", ["ring0", "ring1", "ring2"], ["x0", "x1"])]
    assert rings.drop_overlapping(found.unionByName(found.withColumn("ring_id", F.lit("ring-0009")))).count() == 1
    assert rings.ring_table(df.filter("score > 2"), top_k=6).count() == 0
    cited = explain.cited_events(found, df, df.filter("review_id <> 'a00'"))
    card = explain.evidence_cards(found, cited).first()
    assert card.n_members == 3 and len(card.cited) == 6 and card.missing_context == ["some_scores"] and card.first_day == "1970-01-01"
    assert explain.evidence_cards(found, cited.filter("false")).first().missing_context == ["no_events", "no_scores", "no_times"]
    rows = df.join(found.select("component", F.explode("members").alias("reviewer_id")), "reviewer_id")
    edges = graph.causal_graph(df)
    got = explain.explain_ring(found, rows, edges, df)
    assert got == explain.explain_ring(found, rows, edges, df, "ring-0000") and got["status"] in ("explained", "no_edges") and got["calls"] <= 50
    assert explain.explain_ring(found.filter("false"), rows, edges, df) == {"status": "no_candidates"}
    with pytest.raises(KeyError):
        explain.explain_ring(found, rows, edges, df, "ring-0777")


def test_giant_component_is_strengthened(spark):
    pairs = spark.createDataFrame([("a", "b", 9), ("b", "c", 9), ("c", "d", 3), ("d", "e", 3), ("e", "f", 3)], "a string, b string, weight int")
    assert rings.strong_components(pairs, 6).select("component").distinct().count() == 1
    assert {r.node for r in rings.strong_components(pairs, 6).collect()} == {"a", "b", "c"}
    assert rings.strong_components(pairs, 100).count() == 6


def test_masking():
    edges = [("a", "s", "x"), ("b", "s", "x"), ("c", "s", "y"), ("c", "s", "y"), ("d", "s", "z")]
    m = explain.mask_relations(edges, lambda kept: 0.1 + 0.4 * any(e[2] == "x" for e in kept) + 0.2 * any(e[2] == "y" for e in kept))
    assert m["removed"] == ["x", "y"] and m["n_edges"] == 4 and m["masked"] == pytest.approx(0.1)
    d = explain.masking_measures(m)
    assert d["removal_effect"] == pytest.approx(0.6) and d["compactness"] == 0.75 and d["random_advantage"] == 0.0
    assert explain.mask_relations([], lambda kept: 0.3)["status"] == "no_edges"
    assert explain.mask_relations(edges, lambda kept: 0.5)["removed"] == []
    assert explain.mask_relations(edges, lambda kept: len(kept) / 10, budget=4)["calls"] <= 4
    assert [r for r, _ in explain.groups_of(edges)] == ["x", "y", "z"]


def test_campaigns_are_matched_one_to_one(spark):
    made = lambda n, sets: spark.createDataFrame([(k, m) for k, v in sets.items() for m in v], f"{n} string, member string")
    p, t = {"p1": "abc", "p2": "de", "p3": "z"}, {"t1": "abcd", "t2": "def", "t3": "q"}
    got = {(r.p, r.t): round(r.iou, 3) for r in campaigns.match_sets(made("p", p), made("t", t)).collect()}
    assert got == {("p1", "t1"): 0.75, ("p2", "t2"): 0.667}
    r = campaigns.recovery(made("p", p), made("t", t)).first()
    assert (r.n_predicted, r.n_truth, r.n_matched, r.n_fragmented, r.n_merged) == (3, 3, 2, 1, 1)
    assert r.precision == pytest.approx(2 / 3, abs=1e-6) and r.member_recovery == pytest.approx((3 / 4 + 2 / 3) / 2, abs=1e-6)
    none = campaigns.recovery(made("p", p).filter("false"), made("t", t)).first()
    assert none.precision is None and none.recall == 0 and none.mean_iou is None


def test_recovery_of_many_candidates(spark):
    """4,000 candidates that each share a member with one of two campaigns; joined once and matched in seconds."""
    p = spark.range(4000).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("p"), F.explode(F.array("id", F.col("id") + 10_000)).alias("member"))
    t = spark.range(4000).select(F.concat(F.lit("t"), (F.col("id") % 2).cast("string")).alias("t"), F.col("id").alias("member"))
    campaigns.recovery(p.limit(4), t.limit(4))  # starts the workers
    began = time.monotonic()
    r = campaigns.recovery(p, t.unionByName(t.limit(1))).first()
    assert time.monotonic() - began < 60
    assert (r.n_predicted, r.n_truth, r.n_matched, r.precision, r.n_fragmented, r.n_merged) == (4000, 2, 0, 0.0, 2, 0)


# -- messages and experts ------------------------------------------------------------------------------------------------


def test_relational_stack_against_numpy(spark):
    rng = np.random.default_rng(2)
    n, x = 12, rng.normal(size=(12, 3))
    edges = [(int(a), int(b), r) for r in ("p", "q") for a, b in rng.integers(0, n, (20, 2))]
    layers = [{"self": rng.normal(size=(3, 4)), "p": rng.normal(size=(3, 4)), "q": rng.normal(size=(3, 4)), "bias": rng.normal(size=4)}, {"self": rng.normal(size=(4, 4)), "p": rng.normal(size=(4, 4)), "q": rng.normal(size=(4, 4))}]
    head = (rng.normal(size=4).tolist(), 0.3)
    h = x
    for w in layers:
        out = h @ w["self"] + w.get("bias", 0.0)
        for v in range(n):
            means = [np.mean([h[a] for a, b, r in edges if b == v and r == k], axis=0) @ w[k] for k in ("p", "q") if any(b == v and r == k for a, b, r in edges)]
            if means:
                out[v] += np.mean(means, axis=0)
        h = np.maximum(out, 0)
    want = h @ np.array(head[0]) + head[1]
    f = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "review_id int, h array<double>")
    e = spark.createDataFrame(edges, "src int, dst int, relation string")
    got = {r.review_id: r.logit for r in graph.relational_stack(e, f, layers, head).collect()}
    assert np.allclose([got[i] for i in range(n)], want)
    s = experts.propagated(e, f, ("p", "q")).collect()
    assert len(s) == n and {len(r.h) for r in s} == {3 + 2 * 2 * 3}


def test_layer_samples(spark):
    rng = random.Random(3)
    e = spark.createDataFrame([(rng.randint(0, 40), rng.randint(0, 10), "p", 0) for _ in range(300)], "src int, dst int, relation string, available_at bigint")
    seeds = spark.createDataFrame([(1,), (2,)], "review_id int")
    a = {tuple(r) for r in graph.layer_samples(e, seeds, (4, 2)).collect()}
    assert a == {tuple(r) for r in graph.layer_samples(e, seeds, (4, 2)).collect()}
    every = {(r.src, r.dst) for r in e.collect()}
    assert {(s, d) for _, _, s, d in a} <= every
    for layer, most in ((2, 4), (1, 2)):
        by = {}
        for x, _, s, d in a:
            if x == layer:
                by.setdefault(d, []).append(s)
        assert by and max(map(len, by.values())) <= most
    assert {d for x, _, _, d in a if x == 2} <= {1, 2}
    with pytest.raises(ValueError):
        graph.layer_samples(e, seeds, (4, 0))
    field = graph.receptive_field(e, seeds, max_edges=7).collect()
    assert len(field) == 7 and field == sorted(field, key=lambda r: (r.available_at, r.src, r.dst, r.relation))


def _rows(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) > 0.4).astype(int)
    rows = [(i, None if i % 17 == 0 else int(y[i]), None if i % 13 == 0 else x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "review_id int, label int, v array<double>"), y


def test_expert_learns_and_scores_every_row(spark):
    df, y = _rows(spark)
    w, log = experts.train_expert(df.filter("review_id < 400"), df.filter("review_id >= 400 and review_id < 500"), "v", hidden=(16, 8), epochs=30, rate=0.01)
    got = {r.review_id: r.logit for r in experts.score_rows(df, "v", w).collect()}
    assert len(got) == 600 and all((got[i] is None) == (i % 13 == 0) for i in got)
    held = [i for i in range(500, 600) if got[i] is not None]
    assert experts.average_precision(y[held], np.array([got[i] for i in held])) > 0.9
    assert max(a for *_, a in log) == pytest.approx(experts.average_precision(*(np.array(z) for z in zip(*[(y[i], got[i]) for i in range(400, 500) if got[i] is not None and i % 17]))), abs=1e-9)
    shuffled = df.withColumn("label", F.when(F.col("label").isNotNull(), (F.xxhash64("review_id") % 2 == 0).cast("int")))
    w2, _ = experts.train_expert(shuffled.filter("review_id < 400"), shuffled.filter("review_id >= 400 and review_id < 500"), "v", hidden=(16, 8), epochs=10)
    other = {r.review_id: r.logit for r in experts.score_rows(df, "v", w2).collect()}
    assert experts.average_precision(y[held], np.array([other[i] for i in held])) < 0.8
    with pytest.raises(ValueError):
        experts.train_expert(df.filter("label = 1"), df, "v")


def test_later_labels_leave_weights_alone(spark):
    df, _ = _rows(spark, 200)
    train, val = df.filter("review_id < 150"), df.filter("review_id >= 150")
    a, _ = experts.train_expert(train, val.filter("false"), "v", hidden=(4,), epochs=3)
    b, _ = experts.train_expert(train, val.withColumn("label", 1 - F.col("label")).filter("false"), "v", hidden=(4,), epochs=3)
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_losses_and_gate(spark):
    assert experts.masked_loss(np.zeros(2), np.zeros(2), np.zeros(2), 1.0)[0] == 0.0
    z, y, m = np.array([0.3, -0.2, 1.0]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 1.0, 0.0])
    loss, g = experts.masked_loss(z, y, m, 3.0)
    for i in range(3):
        d = np.zeros(3)
        d[i] = 1e-6
        assert g[i] == pytest.approx((experts.masked_loss(z + d, y, m, 3.0)[0] - loss) / 1e-6, abs=1e-4)
    assert experts.average_precision(np.array([1, 1]), np.array([0.1, 0.2])) is None
    assert experts.average_precision(np.array([0, 1, 0, 1]), np.array([0.9, 0.8, 0.7, 0.6])) == pytest.approx(0.5)
    rng = random.Random(5)
    rows = []
    for i in range(400):
        label, good = i % 2, rng.random() < 0.5  # the context says which expert is right
        right, wrong = 0.9 if label else 0.1, rng.random()
        rows.append((i, label, right if good else wrong, wrong if good else right, None if i % 50 else 0.5, [1.0 if good else -1.0]))
    rows += [(900, None, None, None, None, [0.0]), (901, None, 0.7, None, None, [0.0])]
    df = spark.createDataFrame(rows, "review_id int, label int, a double, b double, c double, context array<double>")
    got = {r.review_id: r for r in experts.adaptive_fusion(df, ["a", "b", "c"], experts.train_gate(df, ["a", "b", "c"])).collect()}
    assert got[900].insufficient_data and got[900].fused is None and got[901].w_a == pytest.approx(1) and got[901].fused == pytest.approx(0.7)
    y, s, mean = zip(*((r.label, r.fused, (r.a + r.b) / 2) for r in got.values() if r.label is not None))
    assert experts.average_precision(np.array(y), np.array(s)) > experts.average_precision(np.array(y), np.array(mean))


def test_encoders_texts_and_thresholds(spark):
    df = spark.createDataFrame([(1, "Good thing", "x"), (2, "good THING", None), (3, " ", "y"), (4, None, None)], "review_id int, text string, title string")
    v = {r.review_id: r.vector for r in experts.hashed_vectors(df, 32).collect()}
    assert v[1] == v[2] and v[3] is None and v[4] is None and sum(x * x for x in v[1]) == pytest.approx(1)
    assert experts.encoder("absent")[0] == "hashed"
    assert [r.t for r in df.orderBy("review_id").select(experts.joined_text(F.col("title"), F.col("text")).alias("t")).collect()] == ["x. Good thing", "good THING", "y", ""]
    s = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.6, 0), (0.8, 1)], "score double, label int")
    assert experts.frozen_threshold(s) == 0.4 and experts.frozen_threshold(s.filter("label = 1")) == 0.5
    few = experts.calibrated(s, s).collect()
    assert all(r.calibrated == pytest.approx(r.score, abs=1e-6) for r in few)
    assert len(experts.simplex()) == 66
    assert sum(experts.global_weights(s.select(F.col("score").alias("a"), (1 - F.col("score")).alias("b"), F.lit(0.5).alias("c"), "label"), ["a", "b", "c"], 2)) == pytest.approx(1)
    z = fusion.logit(F.col("score"))
    assert s.select(experts.single_score([z, z]).alias("p")).first().p == pytest.approx(0.2)


def test_reduced_vectors(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("red green blue cyan gold".split(), k=8))) for i in range(60)], "id int, text string")
    w = fusion.tfidf(docs, "id", "text")
    r = {x.id: np.array(x.vector) for x in fusion.reduced(w, 3).collect()}
    assert len(r) == 60 and all(len(v) == 3 and np.linalg.norm(v) == pytest.approx(1) for v in r.values())
    full = {}
    for x in w.collect():
        full.setdefault(x.id, {})[x.term] = x.weight
    dot = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items())
    near = [(dot(full[i], full[j]), float(r[i] @ r[j])) for i in range(20) for j in range(i)]
    assert np.corrcoef(*zip(*near))[0, 1] > 0.5


def test_edges_stay_when_the_future_is_appended(spark):
    rng = random.Random(8)
    rows = [(i, rng.randint(0, 5), rng.randint(0, 6), rng.randint(0, 60 * 86_400) * 1_000_000) for i in range(300)]
    schema = "review_id int, reviewer_id int, target_id int, us bigint"
    old = {tuple(r) for r in graph.causal_graph(spark.createDataFrame(rows, schema)).collect()}
    new = {tuple(r) for r in graph.causal_graph(spark.createDataFrame(rows + [(999, 1, 1, 61 * 86_400 * 1_000_000)], schema)).collect()}
    assert old == {e for e in new if e[1] != 999} and {r[2] for r in old} == {"same_reviewer", "same_target", "co_target"}
    us = {r[0]: r[3] // 1_000_000 for r in rows}
    assert all(us[s] < us[d] and at <= us[d] and s != d for s, d, _, at in old)


def test_event_track_end_to_end(spark):
    from tidegraph.plans import track

    r, s = _background(spark)
    t = simulate.simulate(r, s, simulate.Plan(positive_rows=60, negative_rows=40, n_campaigns=3, n_controls=4))
    log = t["reviews"].withColumn("us", F.unix_micros("timestamp")).withColumn("title", F.lit(None).cast("string")).cache()
    labels = t["labels"].select("review_id", F.when(F.col("is_synthetic"), F.col("label")).otherwise(0).alias("label"))
    got = track.train_and_score(log, labels, t["splits"], hidden=(16,), epochs=15)
    rows = got["scores"].collect()
    assert len(rows) == log.count() and all(0 <= x.score <= 1 for x in rows) and set(got["epochs"]) == set(experts.EXPERTS)
    report = {x.metric: x.value for x in got["report"].collect()}
    assert report["average_precision"] > report["prevalence"] + 0.2 and 0 < got["threshold"] < 1
    seen = track.investigate(log, got["scores"], records.members_of(records.planted(t["campaigns"])), got["threshold"])
    assert seen["daily"].agg(F.sum("n_scored")).first()[0] == log.count() and campaigns.detection_recall(seen["delays"]).first().n_campaigns >= 3
    none = track.train_and_score(log.limit(30), labels.withColumn("label", F.lit(None).cast("int")), t["splits"], epochs=2)
    assert none["scores"].filter("score is not null").count() == 0 and none["threshold"] == 0.5
