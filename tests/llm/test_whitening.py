import math

import numpy as np
import pytest

from tests.llm.helpers import rows_of
from tickerloom.llm import whitening
from tickerloom.llm.whitening import leading_components, packed, sturm_counts, tridiagonal, unpacked, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n string, x int"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "n", 1) for i, v in vectors], schema)


def brute(vectors, k=4):
    """Rows by plain Python integers and numpy's own solver; signs are left to the caller."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    size = max(len(v) for _, v in good)
    x = [[math.floor(256 * float(np.float32(c))) for c in v] + [0] * (size - len(v)) for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in fit])
    cov = c.T @ c / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    out = []
    for (i, _), r in zip(good, x, strict=True):
        d = [n * a - s for a, s in zip(r, sums, strict=True)]
        w = np.array(d) / n @ vecs / np.sqrt(values)
        out += [(i, j + 1, n, sum(a * a for a in d), float(w[j]), float(values[j] / np.trace(cov))) for j in range(min(k, size))]
    return sorted(out)


def same(spark, vectors, schema=SCHEMA, k=4):
    got = sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in whiten(frame(spark, vectors, schema), k).collect())
    want = brute(vectors, k)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for j in range(1, k + 1):
        a, b = (np.array([r[4] for r in rows if r[1] == j]) for rows in (got, want))
        sign = 1.0 if a @ b >= 0 else -1.0
        assert np.allclose(a * sign, b, rtol=1e-8, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert {r[6] for r in got} == {got[0][6]} and got[0][6] < 1e-9


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = (rng.standard_normal((300, 12)) * np.linspace(1, 3, 12)).astype(np.float32).tolist()
    vectors = [(i, r) for i, r in enumerate(rows)] + [(1000 + i, rows[7]) for i in range(200)]
    vectors += [(2000, None), (2001, [*rows[3][:11], None]), (2002, [*rows[3][:11], math.nan]), (2003, [*rows[3][:11], math.inf]), (7, rows[7])]
    same(spark, vectors)


def test_many_slices_and_a_far_centre(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((200, 6)) * [1, 2, 3, 4, 5, 6] + 3e5).astype(np.float32).tolist()
    same(spark, list(enumerate(rows)))
    monkeypatch.setattr(whitening, "_SLICE", 40)
    monkeypatch.setattr(whitening, "_PIECE", 5)
    monkeypatch.setattr(whitening, "_FAN", 2)
    same(spark, list(enumerate(rows)))


def test_unequal_lengths_count_as_followed_by_zeros(spark):
    rng = np.random.default_rng(3)
    same(spark, [(i, rng.standard_normal(4 + i % 3).astype(np.float32).tolist()) for i in range(60)] + [(70, []), (71, [0.0, 0.0])])


def test_huge_entries_stay_exact(spark):
    rows = [[1e30, -1e30, 1.0], [3e15, 5.0, -2.0], [1.0, 2.0, 3.0], [-0.0, 0.0, 0.5]]
    got = whiten(frame(spark, list(enumerate(rows)), "vec_id long, embedding array<double>, label int, n string, x int")).collect()
    x = [[max(-(2**63), min(2**63 - 1, math.floor(256 * c))) for c in r] for r in rows]
    n, sums = 4, [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        want = sum((n * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (want if want < 2**63 else None)
        assert r["deviation_exact"] is None or int(r["deviation_exact"]) == want


def test_without_variance_or_rows(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None), (2, [None])])).collect() == []
    assert whiten(frame(spark, [(1, []), (None, [])])).collect() == []
    one = whiten(frame(spark, [(1, [0.5, 0.25]), (None, [0.5, 0.25])]))
    assert rows_of(one, "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error") == sorted(
        [(i, j, 1, 0, None, 0.0, None) for i in (1, None) for j in (1, 2)], key=repr
    )
    line = whiten(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 2.0]), (3, [2.0, 4.0])])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) and r["identity_error"] < 1e-9 for r in line)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_solver(n):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n))
    for v in (a @ a.T, a + a.T, np.diag(np.arange(n, dtype=float)), np.eye(n), np.ones((n, n)), 1e-200 * (a @ a.T), np.zeros((n, n))):
        values, vectors = leading_components(v, 4)
        k, size = len(values), max(np.abs(v).max(), 1e-300)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], rtol=0, atol=1e-13 * n * size)
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
        assert np.abs(v @ vectors - vectors * values).max() <= 1e-12 * n * size


def test_sturm_counts():
    a = np.random.default_rng(5).standard_normal((20, 20))
    d, e, _ = tridiagonal(a + a.T)
    at = np.linspace(-15, 15, 101)
    assert (sturm_counts(d, e, at) == (np.linalg.eigvalsh(a + a.T)[:, None] < at).sum(axis=0)).all()


def test_packed_rows_come_back():
    x = np.array([[0, 0, 0], [1, -128, 0], [128, 0, -5], [1 << 40, -(2**63), 2**63 - 1], [-32769, 3, 0], [2**31, 0, 0], [-(2**31), 0, 1]])
    cells = packed(x)
    assert (unpacked(cells, 3) == x).all() and len(set(cells)) == len(x)
    assert packed(np.pad(x, ((0, 0), (0, 2)))) == cells
