"""Vector operators against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    x = centres[rng.integers(0, 6, n)] * 0.6 + rng.standard_normal((n, dim))
    for i in range(0, n, 7):  # near copies and exact ones
        x[i] = x[0] + rng.standard_normal(dim) * 0.05 if i % 3 else x[1]
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype("f4").tolist()


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, score double, dim string, x int")


def odd_rows(n):
    bad = [(n + 1, None), (n + 2, []), (n + 3, [0.0] * 16), (n + 4, [float("nan")] + [1.0] * 15), (n + 5, [float("inf")] + [1.0] * 15), (n + 6, [None] + [1.0] * 15), (None, [0.5] * 16), (n + 7, [1.0, 0.0]), (n + 8, [2.0, 0.0])]
    return bad


def rows_for(n, seed=1):
    return [(i, v, 0, 0.0, "d", 1) for i, v in [*enumerate(vectors(n, 16, seed)), *odd_rows(n + n % 2)]]


@pytest.mark.parametrize("blocks", [(8192, 4096), (64, 16)])
def test_top_k(spark, blocks):
    from veriloom.llm.topk import exact_top_k

    rows = rows_for(600)
    rows.append((40, rows[3][1], 0, 0.0, "d", 1))  # an id twice: two candidates, one query
    out = exact_top_k(frame(spark, rows), 20, 20, 64, candidate_rows=blocks[0], query_rows=blocks[1]).collect()
    ok = [(i, [math.floor(64 * c) for c in v]) for i, v, *_ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    first = {}
    for i, v in ok:
        if i % 20 == 0:
            key = np.array(v, "<f8").tobytes()
            first[i] = min(first.get(i, key), key)
    want = []
    for q, key in first.items():
        v = [int(c) for c in np.frombuffer(key, "<f8")]
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:20]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)
    assert exact_top_k(frame(spark, rows).where("false")).count() == 0
    assert exact_top_k(frame(spark, rows).where("vec_id = 0")).count() == 0


def test_large_components(spark):
    from veriloom.llm.topk import exact_top_k

    rng = random.Random(2)
    rows = [(i, [rng.uniform(-9e5, 9e5) for _ in range(4)]) for i in range(0, 60)]
    out = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5).collect()
    ints = {i: [math.floor(64 * c) for c in v] for i, v in rows}
    for q in (0, 20, 40):
        want = sorted((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in ints.items() if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in want]


@pytest.mark.parametrize("far", [1e3, 1e5, 1e6, 1e9])
def test_outliers_decide_nothing(spark, far):
    """Vectors near a line and one that is far away: pivots and bounds stay sound, and nothing finite is left out."""
    from veriloom.llm.topk import exact_top_k

    rng = np.random.default_rng(7)
    line = rng.standard_normal(16)
    x = [(line * t + rng.standard_normal(16) * 0.01).tolist() for t in rng.uniform(0.5, 2, 800)] + [[far] * 16, [-far] * 16]
    rows = [(i, v) for i, v in enumerate(x)] + [(1000, [2e6] + [0.0] * 15)]
    out = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10, candidate_rows=256, query_rows=32).collect()
    ints = {i: [math.floor(64 * c) for c in v] for i, v in rows}
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {i for i in ints if i % 20 == 0}
    for q in got:
        scored = sorted((-sum(a * b for a, b in zip(ints[q], w)), i) for i, w in ints.items() if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in scored]


def test_scores_beyond_64_bits(spark):
    from veriloom.llm.topk import exact_top_k

    frame_of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    huge = [(0, [1e10, 1.0]), (1, [1e10, 0.0]), (2, [1.0, 1.0]), (3, [-1e300, 0.0]), (4, [2.0, 0.0])]
    with pytest.raises(Exception, match="does not fit in 64 bits"):
        exact_top_k(frame_of(huge), 2).collect()
    # One beyond 64 bits that is not among the best does no harm.
    low = [(0, [1e10, 1.0]), (1, [-1e10, 0.0]), (2, [1.0, 1.0]), (3, [-1e300, 0.0]), (4, [2.0, 0.0])]
    assert [(r.vec_id, r.score) for r in sorted(exact_top_k(frame_of(low), 2).collect(), key=lambda r: r["rank"])] == [(4, 64 * 64 * 2 * 10**10), (2, 64 * 64 * (10**10 + 1))]


def test_bounds_hold_and_eliminate():
    """Bounds are never below a score, and in clustered data most candidates are never evaluated."""
    from veriloom.llm import topk

    rng = np.random.default_rng(3)
    x = np.floor((rng.standard_normal((40, 8)) * 3)[rng.integers(0, 40, 4000)] * 64 + rng.standard_normal((4000, 8)) * 6)
    for far in (1.0, 1e12):
        y = np.vstack([x, np.full((1, 8), far)])
        pivots = topk.choose_pivots(y)
        d, ids = topk.distances(y, pivots), np.arange(len(y))
        block = topk.Block(ids, y, d, 10)
        for i in range(0, 200, 7):
            exact = [sum(int(a) * int(b) for a, b in zip(y[i], w)) for w in y]
            upper = block.bounds((y[i : i + 1] ** 2).sum(axis=1), d[i : i + 1])[0]
            assert all(u >= s for u, s in zip(upper, exact))
            want = sorted((-s, j) for j, s in enumerate(exact) if j != i)[:10]
            got_ids, got = block.search(i, y[i], upper)
            assert [(int(j), int(s)) for j, s in zip(got_ids, got)] == [(j, -s) for s, j in want]
        assert block.evaluated < 0.5 * len(range(0, 200, 7)) * len(y)


def brute_links(rows, cosine=0.9):
    ok = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    root = {i: i for i, *_ in rows if i is not None}
    links = Counter()
    find = lambda i: i if root[i] == i else find(root[i])
    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i] += 1
                links[j] += 1
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    return {i: (links[i], find(i)) for i in root}


@pytest.mark.parametrize("shards,block", [(1, 4096), (3, 64)])
def test_embedding_components(spark, shards, block):
    from veriloom.llm.embedding_dedup import embedding_components

    rows = rows_for(420, 3)
    out = embedding_components(frame(spark, rows), shards=shards, shard_rows=100_000 if shards == 1 else 200, block=block).collect()
    want = brute_links(rows)
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id is not None}
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.98 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
    none = [r for r in out if r.vec_id is None]
    assert len(none) == 1 and none[0].n_links == 0 and none[0].component_id is None
    assert embedding_components(frame(spark, rows).where("false")).count() == 0


def test_ids_that_repeat(spark):
    """Rows of one id keep their own vectors' links: as many rows out as in."""
    from veriloom.llm.embedding_dedup import embedding_components

    frame_of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embedding_components(frame_of([(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.01]), (7, [-1.0, 0.3])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(5, 0, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 0, 7, True)]
    out = embedding_components(frame_of([(9, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [0.0, 1.0]), (4, [-0.0, 2.0]), (8, [0.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(4, 2, 4, True), (8, 2, 4, False), (9, 1, 9, True), (9, 1, 9, True), (9, 2, 4, False)]


def test_sparse_pairs_near_the_limit(spark):
    """Few pairs, all close to the limit, among vectors that link with nothing."""
    from veriloom.llm.embedding_dedup import embedding_components

    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 300, 2):
        away = rng.standard_normal(24)
        away -= away @ x[i] * x[i]
        angle = np.arccos(rng.uniform(0.88, 0.93))
        x[i + 1] = np.cos(angle) * x[i] + np.sin(angle) * away / np.linalg.norm(away)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = {r.vec_id: r.n_links for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shards=2).collect()}
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.97 * want.sum() > 100


def test_limits_of_cosine(spark):
    from veriloom.llm.embedding_dedup import embedding_components

    with pytest.raises(ValueError):
        embedding_components(frame(spark, rows_for(10)), cosine=0.5)


def test_graph_recall():
    """Beams find near copies in a graph of many nodes."""
    from veriloom.llm import embedding_dedup as E
    from veriloom.llm.hnsw import Graph

    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 32))
    x[700:900] = x[:200] + rng.standard_normal((200, 32)) * 0.18
    x[900:1100] = x[5] + rng.standard_normal((200, 32)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = Graph.load(Graph(x).dump())
    assert len(graph.nodes) < 1400  # copies are members
    shard = E.Shard(graph, np.arange(1500), np.ones(1500, int), 0.9)
    shard.widen(x[::40])
    n, a, b = shard.links(np.arange(1500), x)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert (n <= want).all() and n.sum() >= 0.98 * want.sum() and len(a) < 4000


def test_few_lists_hold_the_links():
    """A class asks a few lists and not all vectors, and these hold its links; parts lie together and share a heavy list."""
    from veriloom.llm import embedding_dedup as E
    from veriloom.llm.hnsw import Graph

    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((800, 32)), 5, axis=0) + rng.standard_normal((4000, 32)) * 0.15
    x = x[rng.permutation(len(x))]
    x /= np.linalg.norm(x, axis=1)[:, None]
    shard = E.Shard(Graph(x[:64]), np.arange(64), np.ones(64, int), 0.9)
    r, node, home = shard.asked(x, 4)
    assert len(r) < 6 * len(x) and (home == shard.homes(x)).all()
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    asked = np.zeros((len(x), 64), bool)
    asked[r, node] = True
    assert len(a) > 4000 and asked[a, home[b]].mean() >= 0.95
    lists = [(np.flatnonzero(asked[:, o]), np.flatnonzero(home == o), shard.graph.x[o]) for o in shard.nodes]
    n, left, right = E.compare(np.arange(len(x)), x, np.arange(len(x)), x, np.ones(len(x), int), 0.9, lists)
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert (n <= want).all() and n.sum() >= 0.95 * want.sum() and len(left) < len(x)
    weight = np.array([len(m) for _, m, _ in lists], float)
    weight[7] = weight.sum()
    parts = E.split(shard.graph.x[shard.nodes], weight, 8)
    assert all(len(p) for p in parts) and set(np.concatenate(parts).tolist()) == set(range(8)) and len(parts[7]) >= 4


def test_forest_connects_alike():
    from veriloom.llm.embedding_dedup import forest

    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 3000, (2, 1400)) * 7
    left, right = forest(a, b)

    def least(a, b):
        root = {int(i): int(i) for i in a.tolist() + b.tolist()}
        find = lambda i: i if root[i] == i else find(root[i])
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = sorted((find(i), find(j)))
            root[j] = i
        return {i: find(i) for i in root if find(i) != i}

    assert dict(zip(left.tolist(), right.tolist())) == least(a, b) == least(left, right) and len(left) == len(set(left.tolist()))
