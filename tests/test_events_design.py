import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import design, events

EVENTS = "run_id int, row_idx long, onset double, duration double, trial_type string, letter string"


def _events(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], EVENTS)


def test_adjacent_events_merge_and_rest_goes(spark):
    df = _events(spark, [(0.0, 1.0, "t", "a"), (1.0, 2.0, "t", "b"), (3.0, 1.0, "rest", "_"), (4.0, 1.0, "t", "c"), (4.5, 1.0, "t", "d")])
    found = sorted((r.onset_s, r.duration_s) for r in events.merge_adjacent(df).collect())
    assert found == [(0.0, 3.0), (4.0, 1.0), (4.5, 1.0)]
    assert events.merge_adjacent(df, merge=False).count() == 4
    assert events.merge_adjacent(df.limit(0)).count() == 0


def test_letters_and_code_book(spark):
    df = _events(spark, [(0.0, 1.0, "h", "a"), (0.0, 1.0, "t", "a"), (1.0, 1.0, "h", "_"), (2.0, 1.0, "b", "a")])
    assert [r.letter for r in events.distinct_onsets(df).orderBy("row_idx").collect()] == ["a", " ", "a"]
    book = {(r.letter, r.region): r.bit for r in events.code_book(df).collect()}
    assert book == {("a", "h"): 1, ("a", "t"): 1, ("a", "b"): 0, (" ", "h"): 1, (" ", "t"): 0, (" ", "b"): 0}
    assert [r.pair for r in events.letter_transitions(events.distinct_onsets(df)).orderBy("row_idx").collect()] == ["a ", " a"]


def test_nonlinear_onsets(spark):
    merged = spark.createDataFrame([(1, "t", 0, 2.0, 3.0), (1, "t", 1, 8.0, 2.0)], "run_id int, trial_type string, event_idx long, onset_s double, duration_s double")
    found = {r["sample"]: r["value"] for r in events.sampled_onsets(merged, 12, 1.0).collect()}
    want = {2: 1, 3: 0.665800, 4: 0.499841, 8: 0.964574, 9: 0.630374}
    assert found == pytest.approx(want, abs=1e-6)


def test_nonlinear_onsets_over_blocks_of_the_running_sum(spark):
    r = np.random.default_rng(3)
    times = sorted(r.choice(2000, 300, replace=False).tolist())
    rows = [(1, "t", i, float(t), 1.0) for i, t in enumerate(times)]  # each is the first impulse of its event
    df = spark.createDataFrame(rows, "run_id int, trial_type string, event_idx long, onset_s double, duration_s double")
    found = {x["sample"]: x["value"] for x in events.sampled_onsets(df, 2000, 1.0).collect()}
    g = lambda lag: (1 - 0.6658) * math.exp(-0.7 * (lag - 1))
    want = {t: max(0.0, 1 - sum(g(t - s + 1) for s in times if s < t)) for t in times}
    assert found == pytest.approx(want, abs=1e-9)


def test_epochs_overwrite_and_unknown_methods_fail(spark):
    df = spark.createDataFrame([(1, "t", 0, 0.0, 4.0), (1, "t", 1, 2.0, 1.0)], "run_id int, trial_type string, event_idx long, onset_s double, duration_s double")
    found = {r["sample"]: r["value"] for r in events.sampled_onsets(df, 10, 1.0, "epoch").collect()}
    assert found == {0: 0.25, 1: 0.25, 2: 1.0, 3: 0.25}
    with pytest.raises(ValueError):
        events.sampled_onsets(df, 10, 1.0, "other")


def test_response_functions(spark):
    rows = design.response_basis(spark, 1.0).orderBy("sample").collect()
    assert [r.hrf for r in rows[:10]] == pytest.approx([0, 0.003066, 0.036089, 0.100819, 0.156291, 0.175441, 0.160475, 0.127165, 0.090099, 0.057488], abs=1e-6)
    assert [r.d_hrf for r in rows[:6]] == pytest.approx([0, 0.003066, 0.033024, 0.064729, 0.055472, 0.019150], abs=1e-6)
    assert [r.dd_hrf for r in rows[:6]] == pytest.approx([0, -0.016306, -0.074918, -0.064329, 0.012945, 0.073257], abs=1e-6)
    fine = design.response_basis(spark, 0.01)
    row = fine.agg(F.count("*").alias("n"), F.max("hrf").alias("m"), F.sum("hrf").alias("s"), F.max_by("sample", "hrf").alias("at")).first()
    assert (row.n, row.at) == (3200, 500) and row.m == pytest.approx(0.001754412, abs=1e-9) and row.s == pytest.approx(0.833444, abs=1e-6)


def test_drift(spark):
    rows = design.drift_basis(spark, 10, 20.0, 1 / 128).orderBy("k", "frame").collect()
    assert len(rows) == 20
    assert [r.value for r in rows[10:15]] == pytest.approx([0.987688, 0.891007, 0.707107, 0.453990, 0.156434], abs=1e-6)


def test_convolution_against_numpy(spark):
    r = np.random.default_rng(0)
    onset = np.where(r.random(200) < 0.1, r.random(200), 0.0)
    basis = design.scaled_basis(design.response_basis(spark, 1.0))
    weights = np.zeros((32, 3))
    for b in basis.collect():
        weights[b.sample, b.basis_idx] = b.weight
    df = spark.createDataFrame([(1, "t", int(i), float(onset[i])) for i in np.flatnonzero(onset)], "run_id int, trial_type string, sample long, value double")
    out = np.zeros((66, 3))
    for x in design.convolve(df, basis, 3.0, 200, 1.0).collect():
        out[x.frame, x.basis_idx] = x.value
    want = np.stack([np.convolve(onset, weights[:, k])[:200:3][:66] for k in range(3)], axis=1)
    assert np.allclose(out, want)


def test_confounds(spark):
    rows = [(1, f, "1.0", str(f), "n/a" if f == 0 else str(f), str(2.0 * f), 1.0 if f == 2 else 0.0) for f in range(4)]
    df = spark.createDataFrame(rows, "run_id int, frame int, trans_x string, csf string, csf_derivative1 string, trans_x_derivative1 string, motion_outlier00 double")
    lacking = {c: F.lit("0") for c in (*design.MOTION, *(f"{m}_derivative1" for m in design.MOTION), *design.CSF) if c not in df.columns}
    found = design.confounds(df.withColumns(lacking), motion_squared=False, motion_derivative_squared=False).orderBy("frame").collect()
    assert [r.csf for r in found] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert [r.trans_x_derivative1 for r in found] == [2.0, 2.0, 4.0, 6.0]
    assert [r.csf_derivative1 for r in found] == pytest.approx([1 / 3, 1 / 3, 2 / 3, 1])
    assert [r.frame for r in design.outlier_frames(df).collect()] == [2]
    assert design.outlier_frames(df.drop("motion_outlier00")).count() == 0


def test_contrasts(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",)], "trial_type string")
    rows = design.contrasts(df, per_type=2).orderBy("contrast_id").collect()
    assert [r.name for r in rows] == ["a", "b", "a - b"]
    assert rows[2].weights == [0.5, 0.5, -0.5, -0.5] and rows[2].boost_masks == [[True, True, False, False], [False, False, True, True]]


@pytest.mark.parametrize("method", ["epoch", "epoch_2s"])
def test_boxes_are_what_their_samples_give(spark, method):
    """With events that overlap, reach over the run's end, begin before it, or have no length."""
    rows = [(1, "a", 0, 0.0, 7.3), (1, "a", 1, 20.0, 0.0), (1, "a", 2, 30.5, 40.0), (1, "b", 0, 3.0, 9.0), (1, "b", 1, 5.0, 2.0), (1, "b", 2, 6.0, 20.0),
            (2, "a", 0, -3.0, 5.0), (2, "a", 1, 57.9, 30.0), (2, "a", 2, 61.0, 4.0), (3, "a", 0, 10.0, 1.0), (3, "a", 1, 11.0, 1.0)]
    merged = spark.createDataFrame(rows, "run_id int, trial_type string, event_idx int, onset_s double, duration_s double")
    basis = design.scaled_basis(design.response_basis(spark, 0.1))
    want = design.convolve(events.sampled_onsets(merged, 60.0, 0.1, method), basis, 2.0, 60.0, 0.1)
    got = design.convolve_epochs(merged, basis, 2.0, 60.0, 0.1, method)
    of = lambda df: {(r.run_id, r.trial_type, r.frame, r.basis_idx): r.value for r in df.collect()}
    a, b = of(want), of(got)
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a) and len(a) > 100


def test_tasks_of_event_queries_grow_with_the_events(spark, monkeypatch):
    """Spark would join these small partitions to a few, however many events there are."""
    from seqloom.plans import registry, views

    monkeypatch.setattr(views, "EVENTS_PER_TASK", 20)
    n = spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert n > 20 * 40
    for name in ("onset_variable_epoch", "onset_impulse", "onset_nonlinear", "design_convolved"):
        found = registry.queries()[name](spark, "/root/testdata/sf0.001")
        assert found.rdd.getNumPartitions() >= n / 20, name


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nonlinear_onsets_read_the_events_once(spark):
    """What a block hands to the next comes from a window; a join would sort and shuffle all impulses twice."""
    rows = [(1, "t", 0, 2.0, 3.0), (1, "t", 1, 254.0, 4.0), (1, "t", 2, 600.0, 1.0), (2, "t", 0, 257.0, 1.0), (2, "u", 0, 10.0, 1.0)]
    merged = spark.createDataFrame(rows, "run_id int, trial_type string, event_idx long, onset_s double, duration_s double")
    found = events.sampled_onsets(merged, 720, 1.0)
    assert "Join" not in _plan(found)
    value = {(r.run_id, r.trial_type, r.sample): r.value for r in found.collect()}
    seconds = [(2, 1), (3, 0), (4, 0), (254, 1), (255, 0), (256, 0), (257, 0), (600, 1)]  # with whether an event begins
    past = lambda t, first: sum((1 - 0.6658) * math.exp(-0.7 * (t + first - s - 1)) for s, _ in seconds if s < t)
    want = {(1, "t", t): max(0, 1 - past(t, first)) for t, first in seconds} | {(2, "t", 257): 1.0, (2, "u", 10): 1.0}
    assert value == pytest.approx(want, abs=1e-9)


def test_drift_is_rounded_once_for_all_runs(spark):
    stimuli = spark.createDataFrame([(1, "t", 2.0), (2, "u", 7.0)], "run_id int, trial_type string, onset_s double")
    plain = design.stimulus_design(spark, stimuli, 360, 0.5, resolution_s=1.0)
    short = design.stimulus_design(spark, stimuli, 360, 0.5, resolution_s=1.0, digits=6)
    want = plain.withColumn("value", F.round("value", 6))
    assert sorted(map(tuple, short.collect())) == sorted(map(tuple, want.collect()))
    join = _plan(short).split("Join", 1)[1]  # of runs with the drift
    assert "round(" in join and "round(" not in _plan(plain)
