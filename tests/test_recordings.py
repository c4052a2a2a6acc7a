"""Models of many runs against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import design, events, glm, recordings

N, FRAME_S, SHAPE = 40, 2.0, (4, 3, 3)


@pytest.fixture(scope="module")
def inputs(spark):
    r = np.random.default_rng(0)
    rows, image = [], {}
    for run in (1, 2):
        row = 0
        t = 1.0
        while t < 60:
            kind = ["tap", "rest", "foot"][r.integers(3)]
            d = float(r.integers(1, 6))
            rows.append((run, row, kind, "a", t, d))
            row, t = row + 1, t + d
        image[run] = r.normal(5, 1, (*SHAPE, N))
        image[run][0, 0, 0, 3] = -1.0  # outside the mask
    ev = spark.createDataFrame(rows, "run_id long, row_idx long, trial_type string, letter string, onset double, duration double")
    cells = [
        (run, int(np.ravel_multi_index(at, SHAPE)), *at, image[run][at].tolist()) for run in image for at in np.ndindex(*SHAPE)
    ]
    images = spark.createDataFrame(cells, "run_id long, voxel_id long, x int, y int, z int, ts array<double>").repartition(5)
    conf = [(run, f, float(r.normal()) if f else float("nan")) for run in image for f in range(N)]
    conf = spark.createDataFrame(conf, "run_id long, frame int, trans_x double")
    return ev, images, conf, image


def dense(rows, width):
    x = {run: np.zeros((N, width)) for run in (1, 2)}
    for r in rows:
        x[r.run_id][r.frame, r.reg_idx] = r.value
    return x


def whitened(y, x, order, a=None):
    e = y - x @ np.linalg.pinv(x) @ y
    lags = [e[: N - k] @ e[k:] for k in range(order + 1)]
    if a is None:
        m = np.array([[lags[abs(i - j)] for j in range(order)] for i in range(order)])
        a = -np.linalg.solve(m, lags[1:]) if order else np.zeros(0)
    white = glm.precision_factor(a, N).T
    cov = np.linalg.pinv((white @ x).T @ (white @ x))
    return cov @ (white @ x).T @ white @ y, cov, a, ((white @ e) ** 2).sum()


def smooth(field, kernel):
    half = max(abs(k[0]) for k in kernel)
    padded = np.pad(field, [(half, half)] * 3 + [(0, 0)])
    out = np.zeros_like(field)
    for dx, dy, dz, w in kernel:
        a = [half - d for d in (dx, dy, dz)]
        out += w * padded[a[0] : a[0] + SHAPE[0], a[1] : a[1] + SHAPE[1], a[2] : a[2] + SHAPE[2]]
    return out


def test_designs_of_all_runs(spark, inputs):
    ev, _, conf, _ = inputs
    rows = recordings.run_designs(spark, ev, N, FRAME_S, conf, resolution_s=0.1, method="epoch").collect()
    names = dict(sorted({(r.reg_idx, r.regressor) for r in rows}))
    n_drift = design.drift_order(N, FRAME_S, 1 / 128)
    assert list(names.values()) == [f"{t}_{k}" for t in ("foot", "tap") for k in range(3)] + [f"drift_{k}" for k in range(n_drift)] + ["trans_x"]
    assert list(names) == list(range(6 + n_drift + 1))
    basis = design.scaled_basis(design.response_basis(spark, 0.1))
    on = events.sampled_onsets(events.merge_adjacent(ev), N * FRAME_S, 0.1, "epoch")
    want = {(r.run_id, r.frame, f"{r.trial_type}_{r.basis_idx}"): r.value for r in design.convolve(on, basis, FRAME_S, N * FRAME_S, 0.1).collect()}
    got = {(r.run_id, r.frame, r.regressor): r.value for r in rows if r.reg_idx < 6}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("order,smoothed", [(0, False), (2, False), (0, True), (2, True)])
def test_fits_and_t_maps_against_numpy(spark, inputs, order, smoothed):
    ev, images, conf, field = inputs
    fwhm = 2.0 if smoothed else 0.0
    found = recordings.analyse(
        spark, images, ev, N, FRAME_S, (1.5,) * 3, conf, threshold=0.0, fwhm_mm=fwhm, ar_order=order, resolution_s=0.1, method="epoch"
    )
    rows = found.designs.collect()
    x = dense(rows, 1 + max(r.reg_idx for r in rows))
    kernel = [tuple(r) for r in design.smoothing_kernel(spark, (2.0,) * 3, (1.5,) * 3).collect()]
    fits = {(r.run_id, r.voxel_id): r for r in found.fits.collect()}
    t = {(r.run_id, r.voxel_id, r.contrast_id): r for r in found.t.collect()}
    contrasts = [(r.contrast_id, np.array(r.weights)) for r in found.contrasts.collect()]
    assert len(contrasts) == 3
    inside = [(run, at) for run in field for at in np.ndindex(*SHAPE) if (field[run][at] > 0).all()]
    assert set(fits) == {(run, int(np.ravel_multi_index(at, SHAPE))) for run, at in inside} and len(t) == 3 * len(fits)
    for run, at in inside:
        y = (smooth(field[run], kernel) if smoothed else field[run])[at]
        beta, cov, a, sse = whitened(y, x[run], order)
        got = fits[run, int(np.ravel_multi_index(at, SHAPE))]
        assert np.allclose(got.beta, beta) and np.allclose(got.ar, a) and got.sse == pytest.approx(sse)
        for k, w in contrasts:
            w = np.pad(w, (0, len(beta) - len(w)))
            up, down = (np.flatnonzero(m) for m in (w > 0, w < 0))
            estimate = sum(np.sign(beta[m[0]]) * np.sqrt((beta[m] ** 2).sum()) * w[m].sum() for m in (up, down) if len(m))
            one = t[run, got.voxel_id, k]
            assert one.estimate == pytest.approx(estimate)
            assert one.t == pytest.approx(estimate / np.sqrt(sse / got.dof * (w @ cov @ w)))


def test_smoothed_parameters_and_known_ones(spark, inputs):
    ev, images, _, field = inputs
    designs = recordings.run_designs(spark, ev, N, FRAME_S, resolution_s=0.1, method="epoch").cache()
    rows = designs.collect()
    x = dense(rows, 1 + max(r.reg_idx for r in rows))
    kernel = design.smoothing_kernel(spark, (2.0,) * 3, (0.7,) * 3)
    mask = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "x int, y int, z int")
    cells = [tuple(r) for r in kernel.collect()]
    assert max(c[0] for c in cells) == 1
    found = {(r.run_id, r.voxel_id): r for r in recordings.fit_images(images, designs, N, mask, ar_kernel=kernel, ar_order=2).collect()}
    only = {(r.run_id, r.voxel_id): r.ar for r in recordings.fit_images(images, designs, N, mask, ar_kernel=kernel, ar_order=2, ar_only=True).collect()}
    grown = {(a + i * 1, b + j, c + k) for a, b, c in [(1, 1, 1), (2, 1, 1)] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)}
    for run in field:
        ar = np.zeros((*SHAPE, 2))
        for at in grown:
            if all(0 <= v < n for v, n in zip(at, SHAPE, strict=True)):
                ar[at] = whitened(field[run][at], x[run], 2)[2]
        ar = smooth(ar, cells)
        for at in [(1, 1, 1), (2, 1, 1)]:
            got = found[run, int(np.ravel_multi_index(at, SHAPE))]
            assert np.allclose(got.ar, ar[at]) and np.allclose(only[run, got.voxel_id], ar[at])
            beta, _, _, sse = whitened(field[run][at], x[run], 2, ar[at])
            assert np.allclose(got.beta, beta) and got.sse == pytest.approx(sse)
    known = images.withColumn("a", F.array(F.lit(-0.3)))
    for r in recordings.fit_images(known, designs, N, mask, ar="a").collect():
        at = np.unravel_index(r.voxel_id, SHAPE)
        assert r.ar == [-0.3] and np.allclose(r.beta, whitened(field[r.run_id][at], x[r.run_id], 1, np.array([-0.3]))[0])


def test_blocks_and_runs_without_design(spark, inputs):
    ev, images, _, _ = inputs
    designs = recordings.run_designs(spark, ev.where("run_id = 1"), N, FRAME_S, resolution_s=0.1, method="epoch")
    packed = glm.packed_designs(designs, N)
    plain = {r.voxel_id: r for r in glm.fit_runs(images, packed, 1).collect()}
    dealt = {r.voxel_id: r for r in glm.fit_runs(images, packed, 1, per_block=5, batch_rows=2).collect()}
    assert len(plain) == np.prod(SHAPE) and set(plain) == set(dealt)
    assert all(np.allclose(plain[k].beta, dealt[k].beta) and plain[k].run_id == 1 for k in plain)
