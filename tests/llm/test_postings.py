from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from glyco.llm import postings

SCHEMA = "vec_id long, embedding array<float>, row string"


def brute(rows, k, asks):
    """Exact answers: (query_id, [(vec_id, score)]) of every asking row."""
    good = [(i, n, np.array(v, np.float32).astype(np.float64)) for n, (i, v, _) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    vectors = np.array([v for _, _, v in good])
    ids = [i if i is not None else 2**62 for i, _, _ in good]
    out = []
    for at, (i, _, v) in enumerate(good):
        if asks(i):
            scores = (vectors * v).sum(1)
            order = sorted((-s, ids[j]) for j, s in enumerate(scores) if j != at)[:k]
            out.append((i, [(None if d == 2**62 else d, -s) for s, d in order]))
    return out


def clustered(n, seed, lengths=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 16)) * 0.6
    if lengths:
        v *= rng.lognormal(0, 0.5, (n, 1))
    return [(i, v[i].tolist(), "clash") for i in range(n)]


def answers(df, k=20):
    got: dict = {}
    for r in postings.search(df, F.col("vec_id") % 20 == 0, k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def test_recall_and_scores(spark):
    for rows in (clustered(4000, 1), clustered(4000, 2, lengths=True)):
        got = answers(spark.createDataFrame(rows, SCHEMA))
        want = brute(rows, 20, lambda i: i % 20 == 0)
        assert set(got) == {i for i, _ in want}
        hits = 0
        vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows}
        for i, true in want:
            mine = got[i]
            assert [r for r, _, _ in mine] == list(range(1, 21)) and i not in [d for _, d, _ in mine]
            assert all(np.isclose(s, vectors[i] @ vectors[d], rtol=1e-12) for _, d, s in mine)
            assert mine == sorted(mine, key=lambda x: (-x[2], x[1]))
            hits += len({d for _, d, _ in mine} & {d for d, _ in true})
        assert hits / (20 * len(want)) >= 0.9


def test_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], "x") for i in range(1, 30)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0], "copy") for i in range(25)]  # ties go to the smaller id
    rows += [(None, [1.0, 2.0, 0.0, 0.0], "no id"), (40, [3.0, 1.0, 0.0, 0.0], "a"), (40, [3.0, 1.0, 0.0, 0.0], "again")]
    rows += [(60, None, ""), (80, [0.0] * 4, ""), (80, [1.0, None, 0.0, 0.0], ""), (80, [float("nan")] * 4, ""), (80, [float("inf")] * 4, ""), (80, [], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.query_id, r["rank"], -1 if r.vec_id is None else r.vec_id, r.score) for r in postings.search(df, F.col("vec_id") % 20 == 0, 20).collect())
    want = sorted((i, n, -1 if d is None else d, s) for i, best in brute(rows, 20, lambda i: i is not None and i % 20 == 0) for n, (d, s) in enumerate(best, 1))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_pieces_change_nothing(spark, monkeypatch):
    rows = clustered(1500, 7) + [(5000 + k, clustered(1, 8)[0][1], "copy") for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(postings, "BUNDLE_ROWS", 100)
    monkeypatch.setattr(postings, "QUERY_ROWS", 10)
    small = answers(df)
    monkeypatch.undo()
    assert small == answers(df)


def test_fewer_candidates_and_empty(spark):
    rows = [(20, [1.0, 0.0], ""), (1, [0.5, 0.5], ""), (2, [-1.0, 0.0], "")]
    got = answers(spark.createDataFrame(rows, SCHEMA))
    assert got == {20: [(1, 1, 0.5), (2, 2, -1.0)]}
    assert postings.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
    assert answers(spark.createDataFrame([(20, [1.0, 0.0], "")], SCHEMA)) == {}


def test_graph_search_meets_the_nearest_centroids():
    rng = np.random.default_rng(5)
    centroids = rng.normal(size=(256, 12))
    index = postings.Index(centroids, postings.centroid_graph(centroids), 1.0)
    points = rng.normal(size=(300, 12))
    dists, inside = postings.graph_search(index, points, 1.15, 8)
    true = postings.squared(points, centroids)
    wanted = true <= true.min(1, keepdims=True) * 1.15**2
    assert (inside & wanted).sum() >= 0.98 * wanted.sum()
    assert np.isfinite(dists).mean() < 0.9  # the walk leaves far centroids alone
    sizes = [len(g) for g in postings.balanced_leaves(points, 16)]
    assert max(sizes) - min(sizes) <= 1
