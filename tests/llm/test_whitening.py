import math

import numpy as np
import pytest

from tallyloom.llm import whitening as w

TABLE = "vec_id long, embedding array<float>, n long, vector string, key int"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, 1, "x", 2) for i, v in enumerate(vectors)], TABLE).repartition(3)


def drawn(rows, width, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(rows, width)) * np.linspace(0.1, 2, width)).astype(np.float32)


def plain(vectors):
    """Whole numbers, covariance and its eigenvectors by numpy."""
    x = np.floor(64 * np.asarray(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums) / n
    matrix = centred.T @ centred / n
    values, columns = np.linalg.eigh(matrix)
    return x, centred, matrix, values[::-1], columns[:, ::-1].T


def test_against_numpy(spark):
    vectors = drawn(500, 7)
    rows = w.whitened_rows(table(spark, vectors.tolist())).toPandas().sort_values(["vec_id", "component"])
    x, centred, matrix, values, components = plain(vectors)
    assert len(rows) == 500 * 7 and set(rows.n) == {500}
    got = rows.whitened.to_numpy().reshape(500, 7)
    want = centred @ components.T / np.sqrt(values)
    want *= np.sign((want * got).sum(axis=0))
    assert np.abs(got - want).max() < 1e-9
    assert np.allclose(rows.explained.to_numpy().reshape(500, 7)[0], values / matrix.trace(), rtol=1e-12)
    deviations = ((x * 500 - x.sum(axis=0)) ** 2).sum(axis=1)
    assert (rows.deviation.to_numpy().reshape(500, 7)[:, 0] == deviations).all()
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-10


def test_more_components_than_asked_for(spark):
    rows = w.whitened_rows(table(spark, drawn(60, 9).tolist()), components=4)
    assert rows.count() == 240 and rows.agg({"component": "max"}).first()[0] == 4


def test_nulls_and_odd_entries_take_no_part(spark):
    good = drawn(20, 3).tolist()
    odd = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 0.0], [0.0, -math.inf, 0.0]]
    both = table(spark, good).unionByName(table(spark, odd, 100))
    got = {(r.vec_id, r.component): r.whitened for r in w.whitened_rows(both).collect()}
    assert got == {(r.vec_id, r.component): r.whitened for r in w.whitened_rows(table(spark, good)).collect()}


def test_repeated_rows_and_null_ids_count(spark):
    good = drawn(10, 3).tolist()
    twice = table(spark, good).unionByName(table(spark, good))
    lost = twice.selectExpr("cast(null as long) as vec_id", *twice.columns[1:])
    rows = w.whitened_rows(twice.unionByName(lost)).toPandas()
    assert len(rows) == 40 * 3 and set(rows.n) == {40} and rows.vec_id.isna().sum() == 60


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[], None]])
def test_nothing_to_turn(spark, vectors):
    frame = table(spark, vectors) if vectors else table(spark, [[1.0]]).filter("false")
    assert w.whitened_rows(frame).collect() == []


def test_flat_directions_have_no_component(spark):
    rng = np.random.default_rng(3)
    low = rng.integers(-50, 50, size=(200, 2)) @ np.array([[1, 2, 3, 0], [0, 1, -1, 0]])
    rows = w.whitened_rows(table(spark, low.astype(float).tolist())).toPandas()
    assert rows.component.max() == 2 and rows.identity_error.iloc[0] < 1e-9
    assert abs(rows.groupby("component").explained.first().sum() - 1) < 1e-12


def test_lengths_must_agree(spark):
    with pytest.raises(Exception, match="differ in length"):
        w.whitened_rows(table(spark, [[1.0, 2.0], [1.0]])).collect()


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for most in (5, 2**20, 2**26, 2**31, 2**40):
        rows = rng.integers(-most, most, size=(300, 3))
        wide = rows.astype(object)
        assert w.products(rows) == wide.T.dot(wide).tolist()


def test_deviation_beyond_a_long_is_null():
    model = w.Whitening(10**9, (0,), np.ones((1, 1)), np.ones(1), 1.0, 2**70)
    assert w._deviations(np.array([[1], [10]]), model).to_pylist() == [10**18, None]


@pytest.mark.parametrize("width", [1, 2, 3, 8, 33])
def test_cholesky_and_jacobi(width):
    rng = np.random.default_rng(width)
    half = rng.normal(size=(width, width)) * np.logspace(0, -3, width)
    matrix = half @ half.T
    factor, order = w.pivoted_cholesky(matrix)
    assert np.allclose(factor @ factor.T, matrix[order][:, order], atol=1e-13)
    assert (np.diff(factor.diagonal()) <= 1e-12).all() and np.allclose(factor, np.tril(factor))
    turned = w.jacobi(factor)
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(gram.diagonal())).max() < 1e-12 * gram.max()
    found, values = w.components_of(matrix)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][: len(values)], rtol=1e-9, atol=1e-15)
    assert np.allclose(found @ found.T, np.eye(len(found)), atol=1e-12)


def test_equal_eigenvalues():
    found, values = w.components_of(np.eye(5) * 3)
    assert np.allclose(values, 3) and np.allclose(found @ found.T, np.eye(5))


def test_same_numbers_however_rows_are_dealt(spark):
    vectors = drawn(300, 5, seed=9).tolist()
    one = w.fit(table(spark, vectors).coalesce(1))
    many = w.fit(table(spark, vectors).repartition(17))
    assert (one.components == many.components).all() and (one.eigenvalues == many.eigenvalues).all()
