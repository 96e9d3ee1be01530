import random
import re

import numpy as np
import pytest

from tidegraph.llm import abuse, components, cross_split, leaks, near_duplicates, packing, queries

WORDS = [f"w{i}" for i in range(400)]
TOKENS = f"{queries.TOKENIZERS}/byte_bpe_50k.tiktoken"


def texts(seed=1, n=60):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        w = rng.sample(WORDS, 25)
        out[f"a{i:03}"] = " ".join(w)
        if i % 3 == 0:
            out[f"b{i:03}"] = " ".join([*w[:20], *rng.sample(WORDS, rng.randint(0, 3))])
        if i % 10 == 0:
            out[f"c{i:03}"] = " ".join(w).upper() + "!"
    return out


def jaccard_pairs(t):
    s = {k: set(re.findall(r"[^\W_]+", v.lower())) for k, v in t.items() if v}
    ids = sorted(k for k in s if len(s[k]) >= 12)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.7}


@pytest.mark.parametrize("block", [16384, 3])
def test_near_duplicates(spark, block):
    t = texts() | {"n1": None, "n2": "", "n3": "short", "long": " ".join(WORDS * 50)}
    df = spark.createDataFrame([(k, v, 1) for k, v in t.items()] * 2, "review_id string, text string, c int")
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "review_id", "text", block=block).collect()}
    assert got == jaccard_pairs(t)
    assert near_duplicates.near_duplicate_pairs(df.filter("false"), "review_id", "text").count() == 0


def test_many_copies_stay_linear(spark):
    from tidegraph.llm.similar import record_pairs

    t = {f"x{i:04}": " ".join(WORDS[:20]) for i in range(300)} | {"y": " ".join(WORDS[:21])}
    df = spark.createDataFrame(list(t.items()), "id string, text string")
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(df, "id", "text").collect()}
    assert got == {("x0000", f"x{i:04}") for i in range(1, 300)} | {("x0000", "y")}
    g = near_duplicates.near_duplicate_groups(df, "id", "text").collect()
    assert len(g) == 301 and {r.group_id for r in g} == {"x0000"} and {r.n_links for r in g} == {1}
    assert callable(record_pairs)


@pytest.mark.parametrize("how", [{}, {"often": 3, "block": 1 << 16}, {"often": 2, "block": 3}])
def test_cross_split(spark, how):
    t = texts(2) | {"long1": " ".join(WORDS[:200]), "long2": " ".join(WORDS[20:230]), "long3": " ".join(WORDS[40:290]), "n": None, "e": " "}
    role = {k: random.Random(k).choice(["train", "test", "validation", "excluded", None]) for k in t} | {"long1": "train", "long2": "test", "long3": "train"}
    r = spark.createDataFrame([(k, v, "s") for k, v in t.items()], "review_id string, text string, source string")
    s = spark.createDataFrame([(k, x) for k, x in role.items() if x] * 2, "node_key string, role string")
    held = {"test", "validation"}
    want = {(a, b) for a, b in jaccard_pairs(t) if (role[a] == "train" and role[b] in held) or (role[b] == "train" and role[a] in held)}
    got = {tuple(x) for x in cross_split.cross_split_pairs(r, s, **how).collect()}
    assert got == want and want
    assert cross_split.cross_split_pairs(r.filter("false"), s).count() == 0
    assert cross_split.overlap_counts(cross_split.cross_split_pairs(r, s), r, s).count() >= 1


def test_pairs_need_enough_agreeing_coordinates(spark):
    t = texts(5)
    sets = near_duplicates.near_duplicate_sets(spark.createDataFrame(list(t.items()), "id string, text string"), "id", "text")
    found = [near_duplicates.signature_pairs(sets, coordinates=8, skip=0, match=m).count() for m in (1, 4, 9)]
    assert found[0] > found[1] > found[2] == 0


def test_split_lists_keep_every_pair():
    from tidegraph.llm import lists

    rng = np.random.default_rng(3)
    n = 40
    c = np.arange(n, dtype=np.int64)
    row, words = np.repeat(np.arange(n), 12), np.tile(np.arange(12, dtype=np.uint32), n)
    for side in (np.full(n, 3, np.int32), rng.integers(1, 3, n).astype(np.int32)):
        bits, more = lists.pack(words, row, n, side)
        met = []
        for block in (1000, 3):
            out = lists.posted(np.zeros(n, np.uint64), c, bits, more, np.full(n, n), block).to_pandas().sort_values(["k", "c"])
            cols = [out[x].to_numpy() if x in "kc" else out[x].to_numpy().view(np.uint64) for x in ("k", "c", "bits", "more")]
            a, b = lists._pairs(*cols, lists.Filter(0.7), lists._Tiles())
            met.append(sorted(zip(a.tolist(), b.tolist())))
        want = sorted((i, j) for i in range(n) for j in range(i + 1, n) if (side[i] & 1 and side[j] & 2) or (side[i] & 2 and side[j] & 1))
        assert met[0] == met[1] == want


def test_cross_split_needs_no_shared_run(spark):
    rng = random.Random(6)
    t = texts(3)
    for k in list(t)[:40]:
        w = t[k].split()
        w[:3] = [f"typo{k}{i}" for i in range(3)]
        t[f"z{k}"] = " ".join(rng.sample(w, len(w)))
    r = spark.createDataFrame([(k, v, "s") for k, v in t.items()], "review_id string, text string, source string")
    s = spark.createDataFrame([(k, "test" if k[0] == "z" else "train") for k in t], "node_key string, role string")
    want = {(a, b) for a, b in jaccard_pairs(t) if (a[0] == "z") != (b[0] == "z")}
    assert {tuple(x) for x in cross_split.cross_split_pairs(r, s).collect()} == want and len(want) >= 40


@pytest.mark.parametrize("train,held", [({"y"}, {f"x{i:04}" for i in range(300)}), ({f"x{i:04}" for i in range(300)}, {"x0123", "y"})])
def test_cross_split_writes_every_copy(spark, train, held):
    t = {f"x{i:04}": " ".join(WORDS[:20]) for i in range(300)} | {"y": " ".join(WORDS[:18])}
    r = spark.createDataFrame([(k, v, "s") for k, v in t.items()], "review_id string, text string, source string")
    s = spark.createDataFrame([(k, "train") for k in train] + [(k, "test") for k in held], "node_key string, role string")
    want = {(min(a, b), max(a, b)) for a in train for b in held if a != b}
    pairs = cross_split.cross_split_pairs(r, s)
    assert {tuple(x) for x in pairs.collect()} == want
    assert [(x.n_records, x.n_pairs) for x in cross_split.overlap_counts(pairs, r, s).collect()] == [(len(held), len(want))]


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(50)] + [(f"m{rng.randint(0, 60)}", f"m{rng.randint(0, 60)}") for _ in range(40)] + [("z", "z"), (None, "q")]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and a != b:
            up[find(a)] = find(b)
    want = {}
    for x in list(up):
        want.setdefault(find(x), []).append(x)
    want = {(x, min(g)) for g in want.values() for x in g if len(g) > 1}
    df = spark.createDataFrame(edges * 2, "src string, dst string")
    assert {tuple(r) for r in components.connected_components(df, "src", "dst").collect()} == want
    assert components.connected_components(df.filter("false"), "src", "dst").count() == 0
    lists = spark.createDataFrame([(1, ["b", "a", None, "a"]), (2, ["c"]), (3, []), (4, None)], "id int, members array<string>")
    assert [tuple(r) for r in components.member_links(lists, "members", "id").collect()] == [("a", "b")]


def least_unused(sizes, short, long):
    """A bound from below on the space that any packing leaves, over all numbers of short bins.

    Long bins: each item above half of one needs its own; items of at least alpha fit only beside those of up to
    long - alpha, and what has no place there needs further bins, less what the short bins can take.
    """
    total, best = sum(sizes), float("inf")
    for a in range(total // short + 2):
        n_long = 0
        for alpha in {0, *(x for x in sizes if x <= long // 2)}:
            over = sum(x > long - alpha for x in sizes)
            upper = [x for x in sizes if long // 2 < x <= long - alpha]
            rest = sum(x for x in sizes if alpha <= x <= long // 2) - (short * a if alpha <= short else 0) - (len(upper) * long - sum(upper))
            n_long = max(n_long, over + len(upper) + max(0, -(-rest // long)))
        if n_long * long + a * short >= total:
            best = min(best, n_long * long + a * short)
    return best - total


def test_packing_uses_lengths_jointly():
    rng = np.random.default_rng(4)
    sizes = np.sort(np.exp(rng.normal(5, 1, 20_000)).astype(int) + 1).clip(1, 4096)[::-1]
    lengths = (512, 1024, 2048, 4096)
    bins, final, place = packing.pack_group(sizes, lengths)
    n = bins.max() + 1
    filled, capacity = np.bincount(bins, sizes, n), np.zeros(n)
    capacity[bins] = final
    assert (filled <= capacity).all() and set(final) == set(lengths)
    assert (capacity - filled).sum() < 0.002 * sizes.sum()
    assert len(set(zip(bins.tolist(), place.tolist()))) == len(sizes)


def test_packing_keeps_every_token(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 450)))) for i in range(80)] + [(900, None), (901, ""), (902, "word " * 9000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = packing.pack(df, "doc_id", "text", TOKENS, (256, 1024)).collect()
    sizes = {r.id: r.n_tokens for r in packing.token_counts(df, "doc_id", "text", TOKENS).collect()}
    for i, n in sizes.items():
        own = sorted((r.start, r.n_tokens) for r in rows if r.id == i)
        assert sum(x for _, x in own) == n and len(own) == max(1, -(-n // 1024))
    bins = {}
    for r in rows:
        if r.sequence_id:
            bins.setdefault((r.sequence_id, r.capacity), []).append(r.n_tokens)
    assert all(sum(v) <= c for (_, c), v in bins.items())
    pieces = [r.n_tokens for r in rows if r.n_tokens]
    assert sum(c - sum(v) for (_, c), v in bins.items()) <= least_unused(pieces, 256, 1024) + 256
    text = "ab " * 90_000 + "x" * 150_000 + " tail é"
    assert "".join(packing.parts(text)) == text
    assert packing.pack(df.filter("false"), "doc_id", "text", TOKENS).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([5, 9, 12, 30])))) for i in range(20)] + [(50, None), (51, " ")]
    docs = []
    for i in range(60):
        w = rng.choices(WORDS, k=40)
        src = items[rng.randrange(20)][1].split()
        n = rng.choice([4, 12, 13, 14, 30])
        docs.append((i, " ".join(w[:20]) + " " + " ".join(src[:n]).upper().replace("W", "ｗ­") + ", " + " ".join(w[20:])))
    docs += [(90, None), (91, ""), (92, "x")]
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"), block_words=100).filter("leaked").collect()}
    want = set()
    for d, t in docs:
        for i, q in items:
            a, b = leaks.normal_words(t or ""), leaks.normal_words(q or "")
            n = min(13, len(b))
            if n and any(a[x : x + n] == b[y : y + n] for x in range(len(a) - n + 1) for y in range(len(b) - n + 1)):
                want.add((d, i))
    assert got == want and want


def test_segments():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s = rng.normal(-0.3, 1, 30)
        score, a, b = abuse.best_segment(s)
        brute = max((s[i:j].sum() for i in range(30) for j in range(i + 1, 31)), default=0)
        assert abs(score - max(brute, 0)) < 1e-9 and abs(s[a:b].sum() - score) < 1e-9
        segments = abuse.maximal_segments(s)
        assert not segments or abs(max(x for *_, x in segments) - score) < 1e-9
        assert all(p[1] <= q[0] for p, q in zip(segments, segments[1:]))
        assert [(x, y) for x, y, _ in segments] == _maximal(s, 0, 30)


def _maximal(s, lo, hi):
    """By definition: the best segment, then the same to its left and right."""
    best = max(((s[i:j].sum(), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    return _maximal(s, lo, best[2]) + [best[2:]] + _maximal(s, best[3], hi)


def test_segments_take_linear_time():
    import time

    took = []
    for n in (20_000, 160_000):
        s = np.tile([1.0, -0.9], n // 2) - np.linspace(0, 0.3, n)
        t = time.process_time()
        abuse.maximal_segments(s)
        took.append(time.process_time() - t)
    assert took[1] < 30 * max(took[0], 0.005)


def test_tokens():
    assert abuse.tokens("1d!ot m.o.r.o.n v e r m i n f**k 12") == ["idiot", "moron", "vermin", "<masked>", "f*k", "0"]
    assert abuse.tokens("a b i t c h") == ["abitch", "bitch"]
    assert abuse.tokens("vitamin a b c d k are") == ["vitamin", "abcdk", "bcdk", "are"]
    assert abuse.tokens("m o r o n  s i t s") == ["moron", "sits"]


def test_weak_passages_add_up():
    m = abuse.Model(np.zeros((2, abuse.SLOTS)), 1.0, 0.05, 10.0)
    passage, between = [11.0, 11.0], [-1.0] * 30
    one = m.judge(np.array(between + passage + between * 7))
    many = m.judge(np.array((between + passage) * 7 + between))
    assert one[0] < m.limit <= many[0] and (one[3], many[3]) == (1, 7)
    chance = m.judge(np.array((between + [3.0, 3.0]) * 7 + between))
    assert chance[0] == m.evidence(6.0, 7 * 32 + 30) and chance[3] == 0


def test_abuse_found_in_held_out_texts(spark):
    rng = random.Random(9)
    neutral = lambda: " ".join(rng.choices(WORDS[:200], k=rng.randint(5, 60)))
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        docs.append((i, neutral() + (f" you are a {rng.choice(['filthy', 'vile'])} zork " if bad else " ") + neutral(), "s"))
        if i < 250:
            labels += [(i, int(bad)), (i, None)]
    docs += [(900, None, None), (901, "", "s")]
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    t = abuse.slot_table(d)
    got = {r.doc_id: r.flagged for r in abuse.score_documents(t, abuse.fit(t, y)).collect()}
    wrong = sum(got[i] != (i % 5 == 0) for i in range(250, 400))
    assert wrong <= 3 and not got[900] and not got[901] and len(got) == 402
    none = abuse.score_documents(t, abuse.fit(t, y.filter("false"))).filter("flagged").count()
    assert none == 0
    empty = abuse.slot_table(d.filter("false"))
    assert abuse.score_documents(empty, abuse.fit(empty, y)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL | queries.SLOW_SQL))
def test_queries_against_sql(spark, duck, name):
    from tests.conftest import SF

    got = queries.QUERIES[name](spark, SF).toArrow()
    want = duck.execute((queries.SQL | queries.SLOW_SQL)[name]).to_arrow_table()
    cols = sorted(want.column_names)
    assert cols == sorted(got.column_names)
    assert sorted(zip(*(map(str, got[c].to_pylist()) for c in cols))) == sorted(zip(*(map(str, want[c].to_pylist()) for c in cols))) and got.num_rows
