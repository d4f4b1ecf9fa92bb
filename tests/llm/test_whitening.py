import math

import numpy as np
import pytest

from colforge.llm import whitening


@pytest.mark.parametrize("kind", ["random", "multiple", "diagonal", "rank", "close", "scaled"])
def test_slicing_equals_a_dense_solver(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 24):
        q = np.linalg.qr(rng.normal(size=(n, n)))[0]
        e = {
            "random": rng.random(n) * 9, "multiple": np.repeat([5.0, 2.0, 1.0], n)[:n], "diagonal": np.arange(n, 0, -1.0),
            "rank": np.r_[3.0, np.zeros(n - 1)], "close": 1 + 1e-9 * np.arange(n), "scaled": 10.0 ** -np.arange(n) * 1e6,
        }[kind]
        v = np.diag(e) if kind == "diagonal" else (q * e) @ q.T
        v = (v + v.T) / 2
        values, vectors = whitening.leading(v, 4)
        want = np.sort(np.linalg.eigvalsh(v))[::-1][:4]
        assert np.allclose(values, want, rtol=0, atol=1e-12 * want[0])
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-11 * want[0]


def test_inertia_counts_with_large_pivots():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a = rng.normal(size=(9, 9))
        a = a + a.T - np.diag(np.diag(a)) * rng.choice([0, 2])
        s = whitening.Shifted(a)
        assert s.above() == (np.linalg.eigvalsh(a) > 0).sum()
        assert np.allclose(a @ s.solve(np.arange(9.0)), np.arange(9.0), atol=1e-8)


def plain(rows, components=4):
    """Brute force with whole Python integers and a dense solver."""
    usable = {k: [math.floor(256 * c) for c in v] for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v)}
    distinct = sorted({tuple(x) for x in usable.values()})
    n, d = len(distinct), len(distinct[0])
    s = [sum(x[j] for x in distinct) for j in range(d)]
    y = np.array([[x[j] - s[j] / n for j in range(d)] for x in distinct])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    out = {}
    for k, x in usable.items():
        white = (np.array(x) - np.array(s) / n) @ q / np.sqrt(e)
        out[k] = (sum((n * x[j] - s[j]) ** 2 for j in range(d)), white)
    return n, out, e / np.trace(v)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) + 40
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1, rows[0][1])] * 400 + [(None, rows[5][1]), (7, None), (8, []), (9, [1.0] * 11 + [None]), (10, [1.0] * 11 + [float("nan")]), (11, [float("-inf")] * 12)]
    df = spark.createDataFrame([(i, v, 5, 0.5) for i, v in rows], "vec_id long, embedding array<double>, component int, whitened double").repartition(5)
    # The place of a row is not kept, so rows are told apart by id, vector and component.
    n, want, explained = plain(rows)
    by_id = {}
    for k, (dev, white) in want.items():
        by_id.setdefault(rows[k][0], []).append((dev, white))
    got = {}
    for r in whitening.whiten(df).collect():
        assert r.n == n and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        got.setdefault(r.vec_id, {}).setdefault(r.component, []).append((r.deviation, r.whitened))
    assert set(got) == set(by_id)
    signs = np.sign([got[3][c][0][1] * by_id[3][0][1][c - 1] for c in (1, 2, 3, 4)])
    for i, parts in by_id.items():
        for c in (1, 2, 3, 4):
            a = sorted(got[i][c])
            b = sorted((dev, white[c - 1] * signs[c - 1]) for dev, white in parts)
            assert [x[0] for x in a] == [x[0] for x in b]
            assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=1e-8)


def test_whitening_of_edge_cases(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(make([(1, [0.5, 0.25]), (2, [0.5, 0.25])])).count() == 0  # one distinct vector: no variance
    two = whitening.whiten(make([(1, [0.0, 0.0, 7.0]), (2, [3.0, 4.0, 7.0]), (2, [3.0, 4.0, 7.0]), (3, [1.0])])).collect()  # another length
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), round(r.explained, 9)) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    assert {r.deviation for r in two} == {(3 * 256) ** 2 + (4 * 256) ** 2}
    far = whitening.whiten(spark.createDataFrame([(1, [3e15, 0.0]), (2, [-3e15, 1.0]), (3, [1e300, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in far} == {1, 2} and {r.deviation for r in far} == {None}  # 1e300 has no whole number of 64 bits
    big = whitening.whiten(spark.createDataFrame([(1, [4e6, 0.0]), (2, [-4e6, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in big} == {(2 * 1024000000) ** 2 + 256**2}
