import math
from fractions import Fraction

import numpy as np
import pytest

from cellshift.llm import whitening
from cellshift.llm.queries import op13_whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, x int, n string, component double"


def brute(vectors):
    """The contract in exact fractions, with numpy's own eigenvalues."""
    kept = {i: [math.floor(256 * c) for c in v] for i, v in vectors}
    fitted = sorted({tuple(x) for x in kept.values()})
    n, d = len(fitted), len(fitted[0])
    s = [sum(x[j] for x in fitted) for j in range(d)]
    mean = [Fraction(a, n) for a in s]
    v = [[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fitted) / n) for j in range(d)] for i in range(d)]
    e, q = np.linalg.eigh(np.array(v))
    out = {}
    for i, x in kept.items():
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        centred = np.array([float(a - m) for a, m in zip(x, mean, strict=True)])
        for c in range(min(4, d)):
            out[i, c + 1] = (n, deviation, centred @ q[:, -1 - c] / np.sqrt(e[-1 - c]), e[-1 - c] / np.trace(v))
    return out


def check(found, expected):
    assert {(r.id, r.component) for r in found} == set(expected)
    signs = {}
    for r in found:
        n, deviation, whitened, explained = expected[r.id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(whitened), rel=1e-7, abs=1e-7)
        if abs(whitened) > 1e-3:
            assert signs.setdefault(r.component, math.copysign(1, r.whitened * whitened)) * r.whitened * whitened > 0
        assert r.identity_error < 1e-10


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, (rng.standard_normal(6) * [1, 2, 3, 4, 5, 6] + 1000).tolist()) for i in range(300)]
    vectors += [(1000 + i, v) for i, v in vectors[:40]]  # copies count once
    bad = [(-1, None), (-2, [1.0, None, 3.0, 4.0, 5.0, 6.0]), (-3, [math.nan] * 6), (-4, [math.inf] + [0.0] * 5),
           (-5, []), (-6, [1.0, 2.0]), (-7, [1e300] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, "a", 0.5) for i, v in vectors + bad], SCHEMA).repartition(5)
    check(whitening.whiten(df).collect(), brute(vectors))


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    usable = [(r[0], list(r[1])) for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    found = op13_whitening(spark, SF).withColumnRenamed("vec_id", "id").collect()
    check(found, brute(usable))
    assert len(found) == 4 * len(usable)


def test_large_numbers_stay_exact(spark):
    vectors = [(i, [float(2**40 + i * i), float(-(2**44) + 3 * i), float(i % 5)]) for i in range(50)]
    df = spark.createDataFrame([(i, v, 1, "a", 0.5) for i, v in vectors], SCHEMA)
    expected = brute(vectors)
    for r in whitening.whiten(df, components=3).collect():
        n, deviation, whitened, _ = expected[r.id, r.component]
        assert (r.n, r.deviation) == (n, deviation if deviation < 2**63 else None)
        assert abs(r.whitened) == pytest.approx(abs(whitened), rel=1e-6, abs=1e-6)
    far = spark.createDataFrame([(1, [2.0**44], 1, "a", 0.5), (2, [-(2.0**44)], 1, "a", 0.5)], SCHEMA)
    assert [r.deviation for r in whitening.whiten(far).collect()] == [None, None]


def test_tables_with_nothing_to_tell_apart(spark):
    for rows in ([], [(1, None)], [(1, []), (2, [])]):
        df = spark.createDataFrame([(*r, 1, "a", 0.5) for r in rows], SCHEMA)
        assert whitening.whiten(df).collect() == []
    same = spark.createDataFrame([(i, [0.5, -0.0], 1, "a", 0.5) for i in (1, 1, None)], SCHEMA)
    found = whitening.whiten(same).collect()
    assert len(found) == 6
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found} == {(1, 0, None, None, None)}
    flat = spark.createDataFrame([(i, [float(i), 7.0], 1, "a", 0.5) for i in range(4)], SCHEMA)
    found = whitening.whiten(flat).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in found)
    assert {r.explained for r in found} == {1.0, 0.0}


@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_spectrum(d):
    a = np.random.default_rng(d).standard_normal((d, d + 2))
    a = a @ a.T
    values, vectors = whitening.spectrum(a)
    assert values == pytest.approx(np.linalg.eigvalsh(a)[::-1], rel=1e-11, abs=1e-11)
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13
    assert np.abs(vectors * values @ vectors.T - a).max() < 1e-12 * values[0]


@pytest.mark.parametrize("a", [np.zeros((3, 3)), np.eye(4), np.diag([1.0, 1, 2, 2, 5]), np.ones((5, 5)), np.diag([1, 1 + 1e-13, 3])])
def test_spectrum_of_equal_eigenvalues(a):
    values, vectors = whitening.spectrum(a)
    assert np.abs(vectors * values @ vectors.T - a).max() < 1e-14 * max(1, values[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-14


def test_polar_factor_near_a_singular_matrix():
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((6, 6)))[0]
    u = whitening.polar_factor(q @ np.diag([1, 1e-6, 1e-13, -1, -1e-4, -1e-12]) @ q.T)
    assert np.abs(u @ u - np.eye(6)).max() < 1e-12
    assert round(np.trace(u)) == 0
