"""Attention and factored steps against enumeration and plain NumPy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.operators import attention as A
from lexforge.operators import optimize as P


def trees(n):
    """All parents of n nodes with one root (None) and no circle."""
    for parents in itertools.product([None, *range(n)], repeat=n):
        if parents.count(None) != 1:
            continue
        ok = True
        for j in range(n):
            at, seen = j, set()
            while at is not None and at not in seen:
                seen.add(at)
                at = parents[at]
            ok &= at is None
        if ok:
            yield parents


def enumerated(scores, epsilon):
    n = len(scores)
    w = np.exp(np.array(scores, float))
    out, whole = np.zeros((n, n)), 0.0
    for parents in trees(n):
        mass = math.prod(w[j, j] if p is None else w[p, j] + epsilon for j, p in enumerate(parents))
        whole += mass
        for j, p in enumerate(parents):
            i = j if p is None else p
            out[i, j] += mass * (1 if p is None else w[i, j] / (w[i, j] + epsilon))
    return out / whole


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_marginals_are_those_of_all_trees(spark, n):
    rng = np.random.default_rng(n)
    grids = [rng.normal(size=(n, n)).tolist() for _ in range(3)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "i int, g array<array<double>>")
    for epsilon in (1e-5, 0.3):
        for r in A.tree_marginals(df, "g", "m", epsilon).collect():
            assert np.allclose(r["m"], enumerated(grids[r["i"]], epsilon), atol=1e-9)
            assert epsilon > 0.1 or np.allclose(np.sum(r["m"], 0), 1, atol=1e-3)


def test_marginals_of_odd_rows(spark):
    rows = [(0, None), (1, []), (2, [[1.0, 2.0]]), (3, [[1.0, None], [0.0, 0.0]]), (4, [[1.0, float("nan")], [0.0, 0.0]]), (5, [[2.0]]), (6, [[1.0, 2.0], None]), (7, [[2.0]]), (8, [[1e4, 1.0], [1.0, 1.0]])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "`a.b` int, g array<array<double>>, m string")
    got = {r["a.b"]: r["m"] for r in A.tree_marginals(df, "g", "m").collect()}
    assert got == {0: None, 1: [], 2: None, 3: None, 4: None, 5: [[1.0]], 6: None, 7: [[1.0]], 8: None}
    assert A.tree_marginals(df.limit(0), "g", "m").count() == 0


def plain_attention(p, q, k, v, heads, relations, causal):
    q, k, v = (np.array(x, float) for x in (q, k, v))
    part = q.shape[1] // heads
    out, tops = np.zeros_like(q), np.zeros((len(q), heads))
    for h in range(heads):
        at = slice(h * part, (h + 1) * part)
        for i in range(len(q)):
            seen = [j for j in range(len(q)) if not causal or p[j] <= p[i]]
            r = np.zeros((len(seen), part))
            if relations is not None:
                far = len(relations) // 2
                r = np.array([relations[max(-far, min(far, p[j] - p[i])) + far] for j in seen])
            s = (k[seen][:, at] + r) @ q[i, at] / math.sqrt(part)
            a = np.exp(s - s.max())
            a /= a.sum()
            out[i, at], tops[i, h] = a @ (v[seen][:, at] + r), a.max()
    return out, tops


@pytest.mark.parametrize("causal", [False, True])
@pytest.mark.parametrize("related", [False, True])
@pytest.mark.parametrize(("block", "together"), [(4, 2), (256, 64)])
def test_heads_against_loops(spark, causal, related, block, together):
    """One long sequence among short ones; scores far apart, so that blocks differ in their tops."""
    rng = np.random.default_rng(7)
    lengths = {"long": 37, "one": 1, "five": 5}
    relations = rng.normal(size=(5, 3)).tolist() if related else None
    rows, want = [], {}
    for s, n in lengths.items():
        q, k, v = (rng.normal(size=(n, 6)) * scale for scale in (4, 4, 1))
        out, tops = plain_attention(range(n), q, k, v, 2, relations, causal)
        rows += [(s, i, q[i].tolist(), k[i].tolist(), v[i].tolist()) for i in range(n)]
        want |= {(s, i): (out[i], tops[i]) for i in range(n)}
    df = spark.createDataFrame(rows, "s string, p int, q array<double>, k array<double>, v array<double>").repartition(5)
    got = A.attend(df, "s", "p", "q", "k", "v", 2, relations, causal, block, together).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose(r["context"], want[r["s"], r["p"]][0], atol=1e-9)
        assert np.allclose(r["top"], want[r["s"], r["p"]][1], atol=1e-9)


def test_heads_on_odd_rows(spark):
    """Nulls are left out, equal positions are seen and kept, an empty table gives none."""
    schema = "s string, p int, q array<float>, x string"
    rows = [("a", 0, [1.0, 0.0], ""), ("a", 0, [1.0, 0.0], ""), ("a", 9, [0.0, 1.0], ""), ("a", None, [1.0, 1.0], ""), (None, 1, [1.0, 1.0], ""), ("a", 3, None, "")]
    df = spark.createDataFrame(rows, schema)
    got = A.attend(df, "s", "p", "q", "q", "q", 1, block=4).collect()
    out, _ = plain_attention([0, 0, 9], *[[[1, 0], [1, 0], [0, 1]]] * 3, 1, None, False)
    assert sorted((r["p"], *np.round(r["context"], 9)) for r in got) == sorted((p, *np.round(o, 9)) for p, o in zip([0, 0, 9], out, strict=True))
    assert A.attend(df.limit(0), "s", "p", "q", "q", "q", 1).collect() == []
    with pytest.raises(ValueError):
        A.attend(df, "s", "p", "q", "q", "q", 1, relations=[[0.0], [0.0]])


def plain_steps(value, gradients, how, matrix):
    """The rule, cell by cell of one parameter."""
    value = np.array(value, float)
    m, r, c, sq, peak = np.zeros_like(value), np.zeros(value.shape[-1]), np.zeros(value.shape[0]), np.zeros_like(value), np.zeros_like(value)
    for t, g in enumerate(gradients, 1):
        fall = lambda b: b if how.constant else b * (1 - b ** (t - 1)) / (1 - b**t)  # noqa: B023, E731
        b1, b2 = fall(how.beta1), fall(how.beta2)
        rate = how.rate * max(how.least_scale, math.sqrt((value**2).mean()))
        if matrix:
            r, c = r * b2 + (1 - b2) * (g * g + how.tiny).sum(0), c * b2 + (1 - b2) * (g * g + how.tiny).sum(1)
            v = np.outer(c, r) / r.sum()
        else:
            v = sq = sq * b2 + (1 - b2) * (g * g + how.tiny)
        m = m * b1 + (1 - b1) * g
        step = m / (1 - b1**t) if how.beta1 else g
        peak = np.maximum(peak, v)
        u = step / (np.sqrt(peak / (1 - b2**t)) + how.tiny) if how.constant else step / np.sqrt(v)
        u /= max(1, math.sqrt((u**2).mean()) / how.clip)
        value = value - rate * u
        value -= how.weight_decay * rate * value
    return value


@pytest.mark.parametrize("how", [P.Factored(0.1), P.Factored(0.2, weight_decay=0.05, clip=0.5), P.Factored(0.1, beta1=0.0), P.Factored(0.1, constant=True)])
def test_three_steps_against_numpy(spark, how, monkeypatch):
    monkeypatch.setattr(P, "HOT_CELLS", 10)
    rng = np.random.default_rng(3)
    start = {"m": rng.normal(size=(4, 5)), "v": rng.normal(size=6), "still": rng.normal(size=(2, 2))}
    slopes = {k: [rng.normal(size=x.shape) for _ in range(3)] for k, x in start.items() if k != "still"}

    def cells(name, x):
        return [(name, int(i), int(j), float(y)) for (i, j), y in np.ndenumerate(x)] if x.ndim == 2 else [(name, i, P.VECTOR, float(y)) for i, y in enumerate(x)]

    state = P.begin(spark.createDataFrame([r for k, x in start.items() for r in cells(k, x)], "name string, row int, col int, value double"))
    for t in range(3):
        rows = [r for k, x in slopes.items() for r in cells(k, x[t])] + [("unknown", 0, 0, 1.0)]
        state = P.step(state, spark.createDataFrame(rows, "name string, row int, col int, gradient double"), how)
    got = {(r["name"], r["row"], r["col"]): r["value"] for r in state.cells.collect()}
    for k, x in start.items():
        want = plain_steps(x, slopes[k], how, x.ndim == 2) if k in slopes else x
        for name, i, j, y in cells(k, want):
            assert math.isclose(got.pop((name, i, j)), y, rel_tol=1e-9, abs_tol=1e-12)
    assert not got


def test_cells_without_a_gradient(spark):
    state = P.begin(spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 2.0), ("b", 0, 0, 3.0)], "name string, row int, col int, value double"))
    slopes = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 0, None)], "name string, row int, col int, gradient double")
    got = {(r["name"], r["col"]): (r["value"], r["step"]) for r in P.step(state, slopes, P.Factored(0.1)).cells.collect()}
    assert got["a", 1] == (2.0, 1) and got["b", 0] == (3.0, 0) and got["a", 0][0] < 1.0
    empty = P.begin(state.cells.limit(0))
    assert P.step(empty, slopes, P.Factored(0.1)).cells.count() == 0


def test_norms(spark):
    g = spark.createDataFrame([("a", 0, 0, 3.0), ("a", 0, 1, 4.0), ("b", 0, 0, None)], "name string, row int, col int, gradient double")
    assert P.global_norm(g) == 5.0
    assert P.clip_norm(g, 10.0).agg(F.max("gradient")).first()[0] == 4.0
    assert math.isclose(P.clip_norm(g, 1.0).agg(F.max("gradient")).first()[0], 0.8, rel_tol=1e-6)
    assert P.clip_norm(g, 0.0) is g
    assert P.global_norm(g.limit(0)) == 0.0
