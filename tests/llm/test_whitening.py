import math

import numpy as np
import pytest

from sigloom.llm import whitening


def plain(vectors):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(0)
    deviation = [(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    y = (x * n - sums).astype(float) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return deviation, y, values[::-1], axes[:, ::-1]


def check(spark, vectors, components=32, parts=4, fan=2):
    df = spark.createDataFrame([(k, [float(c) for c in v], "x", k) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, x string, n long").repartition(parts)
    got = whitening.whiten(df, components, fan=fan).toPandas()
    deviation, y, values, axes = plain(vectors)
    n, k = len(vectors), min(components, int((values > values[0] * 1e-13).sum()))
    assert len(got) == n * k and set(got.component) == set(range(1, k + 1)) and set(got.n) == {n}
    assert dict(zip(got.vec_id, got.deviation)) == dict(enumerate(deviation))
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    explained = got.groupby("component").explained.first().to_numpy()
    np.testing.assert_allclose(explained, values[:k] / values.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9 and np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    want = y @ (axes[:, :k] / np.sqrt(values[:k]))
    apart = np.append(np.diff(-values[: k + 1]), 1)[:k] / values[0] > 1e-3
    apart &= np.insert(apart[:-1], 0, True)
    signs = np.sign((w * want).sum(0))
    assert np.abs(w * signs - want)[:, apart].max(initial=0) < 1e-6
    return got


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=(300, 48)) * np.linspace(5, 0.5, 48) + rng.normal(size=48))
    check(spark, rng.normal(size=(150, 6)), components=4, parts=20, fan=3)


def test_repeated_correlated_and_short_of_rank(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (60, 10)) / 4
    x[:, 3] = 2 * x[:, 1]
    x[:, 7] = 5
    check(spark, np.concatenate([x, np.repeat(x[:1], 100, 0), x[:5]]))
    check(spark, rng.normal(size=(5, 12)))


def test_updates_follow_the_covariance():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(80, 20)), np.repeat(rng.normal(size=(4, 20)), 5, 0), np.eye(20), rng.normal(size=(60, 20)) * 10.0 ** -np.arange(20)):
        s, t = whitening.empty(20), whitening.empty(20)
        for k, v in enumerate(x):
            if k % 3:
                s = whitening.add(s, v)
            else:
                t = whitening.add(t, v)
        both = whitening.combine(s, t)
        y = x - x.mean(0)
        size = np.linalg.norm(y.T @ y)
        assert both.n == len(x) and np.allclose(both.mean, x.mean(0))
        assert np.linalg.norm(both.vectors @ np.diag(both.values) @ both.vectors.T - y.T @ y) < 1e-11 * size
        assert np.abs(both.vectors.T @ both.vectors - np.eye(20)).max() < 1e-11 and (np.diff(both.values) >= 0).all()


def test_secular_roots():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        poles, z = np.sort(rng.normal(size=n)), rng.normal(size=n)
        got, _ = whitening.roots(poles, z)
        np.testing.assert_allclose(got, np.linalg.eigvalsh(np.diag(poles) + np.outer(z, z)), rtol=1e-12, atol=1e-12)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 2.0]), (None, [2.0, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (9, [0.0, 0.0]), (9, [0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "9", "9", "9", "9", "None", "None"] and {r.n for r in got} == {4}
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0


@pytest.mark.parametrize("size", [1, 1e9, 1e14])
def test_deviations_are_exact(size):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(20, 5)) * size).astype(np.int64) + 1_000_000
    sums = [int(s) for s in x.astype(object).sum(0)]
    want = [sum((20 * int(e) - s) ** 2 for e, s in zip(row, sums)) for row in x]
    assert whitening.deviations(x, 20, sums) == [v if v < 2**63 else None for v in want]
