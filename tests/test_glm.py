import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import arrays as A
from seqloom.operators import glm


def _series(spark, y):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(y)], "voxel_id long, ts array<double>")


def test_autoregression_of_a_known_series(spark):
    df = _series(spark, np.array([[1, 2, 0, -1, -2, 0, 1, 1.0]]))
    x = glm.autocorrelation(df, 2)
    row = x.withColumn("ar", glm.yule_walker_2("xcorr")).select("xcorr", "ar", glm.sse_from_autocorrelation("xcorr", "ar").alias("sse")).first()
    assert row.xcorr == [12.0, 5.0, -4.0] and row.ar == pytest.approx([-0.672269, 0.613445], abs=1e-6) and row.sse == pytest.approx(6.184874, abs=1e-6)
    assert glm.yule_walker(x).first().ar == pytest.approx(row.ar)


def test_precision_is_product_of_its_factor():
    factor = glm.precision_factor(np.array([-0.5]), 4)
    assert np.allclose(factor @ factor.T, [[1, -0.5, 0, 0], [-0.5, 1.25, -0.5, 0], [0, -0.5, 1.25, -0.5], [0, 0, -0.5, 1.25]])


def test_look_ahead_filter_is_the_factor(spark):
    r = np.random.default_rng(2)
    y, a = r.normal(size=9), np.array([0.4, -0.2])
    found = _series(spark, y[None]).select(A.ahead_filter("ts", F.array(F.lit(0.4), F.lit(-0.2))).alias("w")).first().w
    assert np.allclose(found, glm.precision_factor(a, 9).T @ y)


@pytest.mark.parametrize("order", [0, 1, 4])
def test_generalised_least_squares_against_dense_matrices(spark, order):
    r = np.random.default_rng(order)
    n, x = 40, np.stack([np.ones(40), np.linspace(-1, 1, 40), r.normal(size=40)], axis=1)
    y = r.normal(size=(5, n)).cumsum(axis=1)
    rows = glm.fit(_series(spark, y), x, order).orderBy("voxel_id").collect()
    for i, row in enumerate(rows):
        b0 = np.linalg.pinv(x) @ y[i]
        e = y[i] - x @ b0
        v = np.eye(n)
        if order:
            lags = np.array([(e[: n - k] * e[k:]).sum() for k in range(order + 1)])
            a = -np.linalg.solve(lags[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))], lags[1:])
            v = glm.precision_factor(a, n) @ glm.precision_factor(a, n).T
        cov = np.linalg.pinv(x.T @ v @ x)
        assert np.allclose(row.beta, cov @ x.T @ v @ y[i]) and np.allclose(row["cov"], cov) and np.isclose(row.sse, e @ v @ e) and row.dof == 37


def test_t_map_pads_and_boosts(spark):
    r = np.random.default_rng(5)
    x, y = np.stack([np.ones(20), r.normal(size=20)], axis=1), r.normal(size=(3, 20))
    fits = glm.fit(_series(spark, y), x)
    contrast = spark.createDataFrame([(0, [1.0], [[True]]), (1, [0.5, 0.5], [[True, True]])], "contrast_id int, weights array<double>, boost_masks array<array<boolean>>")
    for boost in (False, True):
        for row in glm.t_map(fits, contrast, boost).collect():
            b = np.linalg.pinv(x) @ y[row.voxel_id]
            c = np.array([1.0, 0.0]) if row.contrast_id == 0 else np.array([0.5, 0.5])
            e = y[row.voxel_id] - x @ b
            est = c @ b if not boost else np.sign(b[0]) * (abs(b[0]) if row.contrast_id == 0 else np.hypot(*b))
            assert np.isclose(row.t, est / np.sqrt(e @ e / 18 * (c @ np.linalg.inv(x.T @ x) @ c)))


def test_odd_series_give_nan_and_empty_tables_nothing(spark):
    x = np.stack([np.ones(4), np.arange(4.0)], axis=1)
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.0] * 4)], "voxel_id long, ts array<double>")
    rows = {r.voxel_id: r for r in glm.fit(df, x, 1).collect()}
    assert rows[0].sse is None and rows[1].beta == [None, None] and rows[2].sse == 0.0 and rows[2].ar == [0.0]
    assert glm.fit(df.limit(0), x).count() == 0
    with pytest.raises(ValueError):
        glm.fit(df, x, -1)


def test_outliers_are_interpolated(spark):
    cells = spark.createDataFrame([(0, f, v) for f, v in enumerate([9.0, 1.0, 50.0, 60.0, 7.0, 99.0])], "voxel_id int, frame int, value double")
    out = spark.createDataFrame([(0,), (2,), (3,), (5,)], "frame int")
    found = [r.value for r in glm.interpolate_outliers(cells, out).orderBy("frame").collect()]
    assert found == pytest.approx(np.interp(range(6), [1, 4], [1.0, 7.0]))


def test_symmetric_root_and_masks(spark):
    m = [[2.0, 1.0], [1.0, 2.0]]
    root = np.array(glm.symmetric_root(spark.createDataFrame([(m,)], "precision array<array<double>>")).first().root)
    assert np.allclose(root @ root, m)
    df = _series(spark, np.array([[1.0, 2.0], [0.0, 3.0]]))
    assert glm.in_every_frame(df).count() == 1 and glm.in_every_frame(df, -1.0).count() == 2


def test_design_matrix_from_rows(spark):
    df = spark.createDataFrame([(0, "b", 2.0), (2, "a", 3.0)], "frame int, regressor string, value double")
    x, names = glm.design_matrix(df, 3)
    assert names == ["a", "b"] and x.tolist() == [[0, 2], [0, 0], [3, 0]]
