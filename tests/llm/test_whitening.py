"""The bidiagonal solver against a dense one, and whitening against plain numpy."""

import numpy as np
import pytest

from siteval.llm import whitening


@pytest.mark.parametrize("d,n", [(1, 4), (2, 9), (17, 60), (64, 300), (30, 12)])
def test_directions(d, n):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(n, d)) * np.exp(rng.normal(size=d))
    x -= x.mean(axis=0)
    r = whitening._triangular([x])
    values, vectors = whitening.directions(r)
    want = np.linalg.eigvalsh(x.T @ x)[::-1]
    kept = min(d, n - 1, 16)
    assert len(values) == kept
    assert np.allclose(values, want[:kept], rtol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(kept)).max() < 1e-12
    assert np.abs(x.T @ (x @ vectors) - vectors * values).max() < 1e-12 * want[0]
    diagonal, above, _ = whitening.bidiagonal(r)
    least = np.linalg.svd(r, compute_uv=False)[::-1] ** 2
    assert np.allclose(whitening.dqds(diagonal, above)[::-1][-kept:], least[-kept:], rtol=1e-11)


@pytest.mark.parametrize("spectrum", [[3, 3, 3, 1, 1, 0, 0], [1] * 7, [5, 5 * (1 + 1e-13), 2, 2, 1e-6, 1e-7, 0], [0] * 7])
def test_equal_and_zero_values(spectrum):
    rng = np.random.default_rng(7)
    right, _ = np.linalg.qr(rng.normal(size=(7, 7)))
    left, _ = np.linalg.qr(rng.normal(size=(30, 7)))
    a = left * np.sqrt(np.array(spectrum, float)) @ right.T
    values, vectors = whitening.directions(whitening._triangular([a]))
    assert len(values) == sum(v > 0 for v in spectrum)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max(initial=0) < 1e-12 * max(1, max(spectrum))


def brute(rows):
    """(vec_id, component) -> the columns, by exact sums and a dense eigensolver."""
    good = [(i, [int(np.floor(64.0 * c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in good}:
        some = [(i, x) for i, x in good if len(x) == d]
        fit = sorted({tuple(x) for _, x in some})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        y = np.array([[n * c - t for c, t in zip(x, s)] for x in fit], dtype=float) / n
        v = y.T @ y / n
        e, u = np.linalg.eigh(v)
        e, u = e[::-1], u[:, ::-1]
        for i, x in some:
            dev = sum((n * c - t) ** 2 for c, t in zip(x, s))
            for k in range(min(16, d)):
                if e[k] > e[0] * 1e-13:
                    whitened = np.array([(n * c - t) / n for c, t in zip(x, s)]) @ u[:, k] / np.sqrt(e[k])
                    out.append((i, k + 1, n, dev, abs(whitened), e[k] / np.trace(v)))
    return out


def test_whiten(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=20) * np.linspace(1, 3, 20)).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(7, rows[9][1]), (None, rows[1][1])]
    rows += [(300, None), (301, []), (302, [None] * 20), (303, [float("nan")] * 20), (304, [float("inf")] + [0.0] * 19)]
    rows += [(400 + i, rng.normal(size=3).tolist()) for i in range(10)]  # another length
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, component string, _d int").repartition(7)
    got = whitening.whiten(df).collect()
    key = lambda r: (r[0] is None, r[0], r[1], r[2], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r[4]) for r in got], [r[4] for r in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)
    assert max(r[6] for r in got) < 1e-10
    merged = whitening.triangular_factor(whitening.whole_numbers(df, "embedding", []).distinct(), {
        20: (150, [0] * 20), 3: (10, [0] * 3)}, fan_in=2)
    assert merged[20].shape == (20, 20)


def test_signs_agree_over_rows(spark):
    rows = [(i, [float(i), float(-i), 0.5]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("vec_id").collect()
    assert {r["component"] for r in got} == {1}  # the other two directions have no variance
    steps = np.diff([r["whitened"] for r in got])
    assert np.allclose(steps, steps[0])


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == 0


def test_large_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0]), (4, [0.0, -1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert by[1, 1]["deviation"] is None and by[3, 1]["deviation"] is not None
    assert by[1, 1]["whitened"] == pytest.approx(-by[2, 1]["whitened"])
