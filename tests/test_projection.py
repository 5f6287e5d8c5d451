import numpy as np
import pytest

from orrery.errors import CoordinateError
from orrery.operators import statistics
from orrery.operators.projection import Projection, solve

ROWS = [[-2, -2], [-1, 2], [0, -1], [1, 1], [2, -2], [3, 2]]
SCHEMA = "vec_id long, embedding array<double>, relation array<double>"


def table(spark, x=ROWS, y=None):
    y = [[v[0]] for v in x] if y is None else y
    return spark.createDataFrame([(i, [float(a) for a in v], [float(a) for a in w]) for i, (v, w) in enumerate(zip(x, y, strict=True))], SCHEMA)


def test_first_coordinate_is_recovered(spark):
    p = Projection.fit(table(spark), alpha=1e-10)
    assert p.relation_median == 0.5 and p.relation_scale == 2.5
    assert np.allclose(p.coefficients, [[0.4, 0]], atol=1e-9) and np.allclose(p.intercept, -0.2, atol=1e-9)
    assert p.relation_names == ("relation_0",)


def test_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 9)), rng.normal(size=(300, 3)) * 10
    p = Projection.fit(table(spark, x.tolist(), y.tolist()), alpha=2.0, relation_names=("a", "b", "c"))
    q25, med, q75 = np.percentile(y, (25, 50, 75), axis=0)
    z = (y - med) / np.maximum(q75 - q25, 1)
    xc, zc = x - x.mean(0), z - z.mean(0)
    w = np.linalg.solve(xc.T @ xc + 2 * np.eye(9), xc.T @ zc)
    assert np.allclose(p.coefficients, w.T, atol=1e-12) and np.allclose(p.intercept, z.mean(0) - x.mean(0) @ w, atol=1e-12)
    plain = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r.relation for r in p.project(plain).orderBy("vec_id").collect()])
    lit = np.array([r[0] for r in plain.orderBy("vec_id").select(p.column(plain.embedding)).collect()])
    assert np.allclose(got, x @ w + p.intercept, atol=1e-12) and np.allclose(got, lit, atol=1e-12)
    back = plain.select(p.unscaled(p.scaled(p.column(plain.embedding))).alias("v"), p.column(plain.embedding).alias("w")).head()
    assert np.allclose(back.v, back.w)


def test_stored_twice_and_read_back(spark, tmp_path):
    p = Projection.fit(table(spark), relation_names=["depth"])
    p.save(spark, str(tmp_path / "p"))
    p.save_archive(str(tmp_path / "p.npz"))
    for q in (Projection.load(spark, str(tmp_path / "p")), Projection.load_archive(str(tmp_path / "p.npz"))):
        assert all(np.array_equal(getattr(p, n), getattr(q, n)) for n in ("coefficients", "intercept", "relation_median", "relation_scale", "embedding_mean"))
        assert (q.alpha, q.relation_names) == (p.alpha, ("depth",))


def test_singular_equations_use_the_pseudo_inverse(spark):
    assert np.allclose(solve(np.zeros((2, 2)), np.ones((2, 1)), 0.0), 0)
    p = Projection.fit(table(spark, [[1, 1], [2, 2], [3, 3]], [[0], [2], [4]]), alpha=0.0)
    assert np.allclose(p.coefficients, p.coefficients[0, 0])


@pytest.mark.parametrize(
    "x, y, options",
    [
        ([[1, 2]], [[1]], {}),
        ([[1, 2], [1]], [[1], [2]], {}),
        ([[1, 2], [1, float("nan")]], [[1], [2]], {}),
        ([[1, 2], [3, 4]], [[1], [2, 3]], {}),
        (ROWS, None, {"alpha": -1}),
        (ROWS, None, {"alpha": float("inf")}),
        (ROWS, None, {"minimum_relation_scale": 0}),
        (ROWS, None, {"relation_names": ["a", "b"]}),
        (ROWS, None, {"relation_names": [""]}),
    ],
)
def test_refused_fits(spark, x, y, options):
    with pytest.raises(CoordinateError):
        Projection.fit(table(spark, x, y), **options)


def test_refused_projections(spark):
    good = dict(coefficients=[[1.0, 2.0]], intercept=[0.0], relation_median=[0.0], relation_scale=[1.0], embedding_mean=[0.0, 0.0], alpha=1.0, relation_names=("a",))
    Projection(**good)
    for bad in ({"relation_scale": [0.0]}, {"alpha": -1.0}, {"intercept": [1.0, 2.0]}, {"relation_names": ("a", "b")}, {"embedding_mean": [1.0]}, {"intercept": [float("nan")]}):
        with pytest.raises(CoordinateError):
            Projection(**(good | bad))
    with pytest.raises(CoordinateError):
        Projection(**(good | {"coefficients": [[1.0, 2.0]] * 2, "intercept": [0.0] * 2, "relation_median": [0.0] * 2, "relation_scale": [1.0] * 2, "relation_names": ("a", "a")}))


def test_narrowed_percentiles_are_exact(spark):
    rng = np.random.default_rng(1)
    for values in (rng.normal(size=5000), np.repeat([1.0, 2.0, 3.0], 1500), rng.integers(0, 9, 4000).astype(float)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        shares = (0.0, 0.25, 0.5, 0.75, 0.999, 1.0)
        assert np.allclose(statistics.percentiles(df, [df.v], shares, direct_rows=200)[0], np.percentile(values, np.array(shares) * 100), atol=1e-12)
    assert statistics.percentiles(df.limit(0), [df.v], (0.5,)) == [[None]]
