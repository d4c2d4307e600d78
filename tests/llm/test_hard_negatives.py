"""Hard negatives against a comparison with every row; cover trees against their own rules."""

import math

import numpy as np

from marlpit.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score long, window int, cell int, vector string, anchor long"


def plain(rows):
    seen = {}
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        x = tuple(math.floor(256 * float(np.float32(v))) for v in vector)
        seen[(vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, x)] = None
    rows, out = list(seen), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda found: sorted(found, key=lambda r: (-r[0], r[1] is None, r[1]))[:5]
    for a in rows:
        if a[0] is None or a[0] % 100:
            continue
        for score, positive in first((dot(a[2], b[2]), b[0]) for b in rows if b[1] == a[1] and b is not a):
            found = first((s, b[0]) for b in rows if b[1] != a[1] and 80 * score <= 100 * (s := dot(a[2], b[2])) <= 100 * score)
            out += [(a[0], positive, k + 1, n, score, s) for k, (s, n) in enumerate(found)]
    return sorted(out, key=str)


def held(spark, rows):
    frame = spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], y, 1, 1, 1, "v", 1) for k, v, y in rows], SCHEMA).repartition(3)
    got = hn.hard_negatives(frame)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_no_rows_nulls_and_odd_vectors(spark):
    held(spark, [])
    held(spark, [(100, [1.0, 2.0], 1)])
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1, 2], 1), (100, [1, 2], 1), (100, [1, 1], 1), (1, [1, nan], 1), (2, [inf, 1], 1), (3, [None, 1], 2), (4, None, 2), (5, [1, 2], None), (None, [1, 2], 1), (None, [2, 1], 2), (6, [3], 1), (8, [1, 2], 2), (9, [], 2), (10, [-1, -2], 1), (0, [0, 0], 3), (7, [0.5, 0.1], 3), (11, [1, 1.9], 4)]
    held(spark, rows)


def test_clusters_copies_and_ties(spark):
    own = np.random.default_rng(3)
    middles = own.normal(size=(12, 16))
    rows = [(int(k), (middles[k % 12] + own.normal(size=16) * (0.05 if k % 3 else 0.6)).tolist(), int(own.integers(4))) for k in range(3000)]
    rows += [(int(k), middles[0].tolist(), int(k % 3)) for k in range(3000, 4200)]
    rows += [(int(k), (middles[1] * own.choice([1.0, 1.0, 2.0])).tolist(), int(k % 4)) for k in range(4200, 4700)]
    held(spark, rows)


def test_scores_past_what_doubles_hold(spark):
    own = np.random.default_rng(4)
    held(spark, [(int(k) * 50, (own.integers(1, 2**20, 3) * 1.0).tolist(), int(k % 2)) for k in range(40)])


def test_levels_cover_and_separate():
    own = np.random.default_rng(5)
    points = np.concatenate([own.normal(size=(20, 6))[k % 20][None] + own.normal(size=(1, 6)) * 0.01 for k in range(900)] + [np.zeros((200, 6))])
    order, nodes = hn.cover_tree(points)
    points = points[order]
    away = hn.distances(points, points)
    assert sorted(order) == list(range(len(points))) and nodes["level"].max() >= 2
    for level in range(nodes["level"].max() + 1):
        at = nodes[nodes["level"] == level]
        assert at["first"][0] == 0 and at["last"][-1] == len(points) and (at["first"][1:] == at["last"][:-1]).all()
        for node in at:
            assert away[node["centre"], node["first"] : node["last"]].max() <= node["radius"] + 1e-6
        if level:
            above = nodes[nodes["level"] == level - 1]
            assert (above["first"][at["parent"]] <= at["first"]).all() and (at["last"] <= above["last"][at["parent"]]).all()
            assert set(above["centre"]) <= set(at["centre"])
            between = away[np.ix_(at["centre"], at["centre"])][~np.eye(len(at), dtype=bool)]
            nearest = away[at["centre"]].min(0)
            assert between.min() > nearest.max()


def test_outside_nodes_are_skipped(monkeypatch):
    """Of well-parted groups only those within the windows are scored."""
    own = np.random.default_rng(6)
    middles = own.normal(size=(30, 8)) * 100
    vectors = np.round(middles[np.arange(1500) % 30] + own.normal(size=(1500, 8)))
    most = float((vectors**2).sum(1).max())
    order, nodes = hn.cover_tree(hn.augmented(vectors, most))
    shard = {"ids": np.arange(1500)[order], "labels": np.zeros(1500, int), "vectors": vectors[order], "nodes": nodes}
    q = vectors[:5]
    anchors = {"ids": np.full(5, -1), "labels": np.zeros(5, int), "vectors": q, "of": np.arange(5), "lo": np.full(5, -(2**62)), "hi": np.full(5, 2**62)}
    seen, real = [], hn.exact_scores
    monkeypatch.setattr(hn, "exact_scores", lambda a, b, plain: seen.append(len(a) * len(b)) or real(a, b, plain))
    query, row, score = hn.search_shard(shard, anchors, most, True)
    want = np.sort(q @ vectors.T, 1)[:, ::-1][:, :5]
    assert [sorted(score[query == k].tolist(), reverse=True) for k in range(5)] == want.astype(int).tolist()
    assert sum(seen) < 0.5 * 5 * 1500
