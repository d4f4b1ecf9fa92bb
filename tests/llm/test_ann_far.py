"""Nearest vectors far from the origin, of extreme size, and in tight clusters."""

import numpy as np
import pytest

from colforge.llm import ann


def recall(x, queries, k=10):
    graph = ann.Graph(x).build(ann._levels(np.arange(len(x))))
    hits = 0
    for q in queries:
        at = graph.search(graph.place(x[q]), k + 1, ann.BREADTH)
        score = ann._euclid(x[at] - x[q])
        best = at[np.lexsort((at, score))]
        found = [n for n in best.tolist() if n != q][:k]
        true = ann._euclid(x - x[q])
        true[q] = np.inf
        hits += len(set(found) & set(np.lexsort((np.arange(len(x)), true))[:k].tolist()))
    return hits / (k * len(queries))


@pytest.mark.parametrize("offset, size", [(0, 1), (100, 1), (3000, 1), (1e9, 1), (0, 1e39), (1e200, 1e198), (0, 1e-60)])
def test_recall_does_not_depend_on_place_or_size(offset, size):
    x = np.random.default_rng(3).normal(size=(1200, 24)) * size + offset
    assert recall(x, range(0, 1200, 40)) >= 0.95


def test_recall_in_tight_clusters_far_apart():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(40, 1, 16)) * 1000 + rng.normal(size=(40, 30, 16)) * 0.05).reshape(-1, 16)
    assert recall(x, range(0, 1200, 40)) >= 0.95


def test_a_query_far_from_its_shard_and_equal_vectors():
    graph = ann.Graph(np.array([[1e-300, 0.0], [0.0, 1e-300], [-1e-300, 0.0]])).build(np.zeros(3, int))
    assert sorted(graph.search(graph.place(np.array([1e300, 1.0])), 3, 8).tolist()) == [0, 1, 2]
    one = ann.Graph(np.array([[5.0, 5.0]])).build(np.zeros(1, int))
    assert one.search(one.place(np.array([1.0, 2.0])), 3, 8).tolist() == [0]


def test_four_shards_with_an_offset(spark):
    x = np.random.default_rng(5).normal(size=(1000, 16)) + 3000
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    hits = 0
    for r in ann.nearest(df, every=50, k=10, shard_rows=250).collect():
        true = np.sqrt(((x - x[r.query_id]) ** 2).sum(1))
        assert r.score == pytest.approx(true[r.vec_id], rel=1e-12)
        true[r.query_id] = np.inf
        hits += r.vec_id in np.argsort(true)[:10]
    assert hits >= 0.95 * 200
