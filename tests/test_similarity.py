"""Similar texts: hashed sets against plain ones, and cells whose work does not grow with what is common."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marlpit.operators import similarity


def cell_of(sets, sizes, left):
    return pa.table({"left": left, "id": list(range(len(sets))), "n": pa.array(sizes, pa.int32()), "runs": pa.array([list(s) for s in sets], pa.list_(pa.int32()))})


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
@pytest.mark.parametrize("percent", [1, 30, 80, 100])
def test_cells_match_every_pair(percent, most):
    """all pairs at or above the threshold, and every row's most similar, whatever is rare, wide or looked up first."""
    own = random.Random(percent * most)
    line = list(range(10**6, 10**6 + 300))
    for diagonal in (True, False):
        sets = [own.sample(range(own.choice([20, 200])), own.randint(1, 18)) + (line if k % 5 == 0 else line[:4] if k % 5 == 1 else []) for k in range(90)]
        sets += [own.sample(s, len(s) - own.randint(0, len(s) // 2)) for s in own.sample(sets, 30)]
        sizes = [len(s) + own.choice([0, 0, 1, 9]) for s in sets]
        left = [own.random() < 0.5 for _ in sets]
        cell = cell_of(sets, sizes, left)
        alike = {}
        for a, x in enumerate(map(set, sets)):
            for b, y in enumerate(map(set, sets)):
                if x & y and (a < b if diagonal else left[a] and not left[b]):
                    alike[a, b] = len(x & y), sizes[a] + sizes[b] - len(x & y)
        close = {k: v for k, v in alike.items() if 100 * v[0] >= percent * v[1]}
        told = [[*zip(*(c.tolist() for c in similarity.cell_pairs(cell, diagonal, percent, nearest, most)))] for nearest in (False, True)]
        assert len(told[0]) == len(close) and {(x, y): (b, e) for x, y, b, e in told[0]} == close
        near = {(min(x, y), max(x, y)) if diagonal else (x, y): (b, e) for x, y, b, e in told[1]}
        assert near.items() <= alike.items() and close.items() <= near.items()
        best = lambda pairs: {k: max(b / e for ends, (b, e) in pairs.items() if k in ends) for k in {k for ends in pairs for k in ends}}  # noqa: E731, B023
        assert best(near) == best(alike)


def test_common_runs_are_not_looked_up():
    """2500 texts of which each shares 300 frequent runs with others, but no two are similar; counting every run of every pair is 900 million entries."""
    own = np.random.default_rng(5)
    sets = [np.concatenate([own.choice(600, 250, False), 10**5 + own.choice(10**5, 80, False)]) for _ in range(2500)]
    cell = cell_of(sets, [1000] * len(sets), [True] * len(sets))
    began = time.thread_time()
    assert len(similarity.cell_pairs(cell, True, 30, False)[0]) == 0
    assert time.thread_time() - began < 2


def test_a_shared_line_is_counted_once():
    """2500 texts with one line of 500 runs; its lists are not gathered for every text."""
    own = np.random.default_rng(6)
    sets = [np.concatenate([np.arange(500), 10**5 + own.choice(10**5, 20, False)]) for _ in range(2500)]
    cell = cell_of(sets, [3000] * len(sets), [True] * len(sets))
    began = time.thread_time()
    x, y, both, either = similarity.cell_pairs(cell, True, 30, True)
    assert set(x.tolist()) == set(range(len(sets))) and both.min() >= 500 and (both + either == 6000).all()
    assert time.thread_time() - began < 4


def test_hashed_texts_are_the_comparable_ones(spark):
    """the same texts, classes and pairs as from shingles as text."""
    own = random.Random(4)
    vocabulary = ["é", "É", "ﬁn", "²", "Ⅷ", "x_y", "ß", "日本", "a1", "l'été", "ñ-o", "é", "İ", "－", "١٢"] + [f"w{k}" for k in range(60)]
    texts = [" ".join(own.choice(vocabulary) for _ in range(own.choice([0, 1, 2, 39, 40, 41, 120]))) for _ in range(60)]
    texts += [t.upper() for t in texts[:20]] + [t + " more" for t in texts[20:40]] + [None, "", " ", "_" * 50, "a " * 39, "a " * 40, "\n".join(["b"] * 41)]
    df = spark.createDataFrame([(k % 3, k, k % 7 != 0, t) for k, t in enumerate(texts)], "workspace_id int, id int, published boolean, text string")
    for fold in (True, False):
        plain, hashed = similarity.comparable(df, fold), similarity.hashed_texts(df, fold)
        assert {(r.id, r.n) for r in plain.selectExpr("id", "size(shingles) n").collect()} == {(r.id, r.n) for r in hashed.selectExpr("id", "size(runs) n").collect()}
        assert {*similarity.hashed_classes(plain)[0].collect()} == {*similarity.hashed_classes(hashed)[0].collect()}
        pairs = {*similarity.similar_pairs(hashed).collect()}
        assert len(pairs) > 5 and pairs == {*similarity.similar_pairs(plain).collect()}


@pytest.mark.parametrize("bucket", [7, 100, similarity.BUCKET])
def test_shared_runs(spark, bucket):
    """what more than one text has, by whatever buckets, and no two runs of one number."""
    own = random.Random(bucket)
    seen = [own.randrange(-(1 << 63), 1 << 63) for _ in range(80)]
    rows = [("w", k, own.sample(seen[: 10 + k], own.randint(1, 9))) for k in range(70)] + [("w", 99, [])]
    docs = spark.createDataFrame([(w, k, len(x), x) for w, k, x in rows], "workspace_id string, id int, n int, runs array<long>")
    found = {}
    for r in similarity.shared_runs(docs, bucket).collect():
        found.setdefault(r.id, []).extend(r.runs)
    many = Counter(x for _, _, runs in rows for x in runs)
    want = {k: [x for x in runs if many[x] > 1] for _, k, runs in rows}
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items() if v}
    alike = lambda sets: {(a, b): len({*x} & {*y}) for a, x in sets.items() for b, y in sets.items() if a <= b and x and y}
    assert alike(found) == {k: v for k, v in alike(want).items()}


def test_verdicts_do_not_hang_on_the_nearest(spark):
    """the report's verdicts are T6's."""
    own = random.Random(9)
    texts = [" ".join(f"w{own.randrange(400)}" for _ in range(60)) for _ in range(12)]
    rows = [(k, k % 2, True, t) for k, t in enumerate(texts + texts[:2] + [texts[3] + " and more"] + ["short"])]
    df = spark.createDataFrame(rows, "id long, workspace_id int, published boolean, text string")
    near, far = (similarity.duplication_verdicts(df, nearest=n).select("id", "verdict", "matches").collect() for n in (True, False))
    assert sorted(near) == sorted(far) and Counter(r.verdict for r in near)["fail"] >= 4
    assert [tuple(r) for r in similarity.guardrail_report(similarity.duplication_verdicts(df, nearest=False)).collect()] == [("fail", len(rows))]
