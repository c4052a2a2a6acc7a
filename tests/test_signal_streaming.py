import cmath
import math

import numpy as np
import pytest

from seqloom.operators import signal
from seqloom.streaming import windows


def _gain(sections, hz, fs):
    z = cmath.exp(2j * math.pi * hz / fs)
    return math.prod(abs((b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)) for b0, b1, b2, a1, a2 in sections)


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_butterworth_gains(order):
    low, high = signal.butterworth(order, None, 10.0, 100.0), signal.butterworth(order, 10.0, None, 100.0)
    band = signal.butterworth(order, 5.0, 20.0, 100.0)
    for sections, ends in ((low, [10.0]), (high, [10.0]), (band, [5.0, 20.0])):
        for hz in ends:
            assert _gain(sections, hz, 100.0) == pytest.approx(math.sqrt(0.5))
        assert all(abs(x) < 1 for _, _, _, a1, a2 in sections for x in np.roots([1, a1, a2]))
    assert _gain(low, 0.0, 100.0) == pytest.approx(1) and _gain(low, 49.999, 100.0) < 0.01
    assert _gain(high, 49.9999, 100.0) == pytest.approx(1) and _gain(high, 1e-3, 100.0) < 0.01
    assert _gain(band, 1e-3, 100.0) < 0.01 and _gain(band, 49.999, 100.0) < 0.01
    with pytest.raises(ValueError):
        signal.butterworth(2, None, None, 1.0)


def test_known_second_order_section():
    (found,) = signal.butterworth(2, None, 25.0, 100.0)  # tan(pi / 4) = 1
    assert found == pytest.approx((1 / (2 + math.sqrt(2)), 2 / (2 + math.sqrt(2)), 1 / (2 + math.sqrt(2)), 0, (2 - math.sqrt(2)) / (2 + math.sqrt(2))))


def test_both_filters_and_the_stream_agree(spark):
    r = np.random.default_rng(1)
    x = [r.normal(size=30).tolist(), r.normal(size=7).tolist(), []]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)] + [(9, None)], "run_id int, ts array<double>")
    sections = signal.butterworth(4, 0.05, 0.2, 1.0)
    fold = {q.run_id: q.ts for q in df.select("run_id", signal.filter_array("ts", sections).alias("ts")).collect()}
    rows = {q.run_id: q.ts for q in signal.ButterworthFilter(0.05, 0.2, 1.0).transform(df).collect()}
    assert fold[9] is None and rows[9] is None
    for i in range(3):
        assert np.allclose(fold[i], rows[i])


def test_stream_carries_its_state(spark, tmp_path):
    sections = signal.butterworth(2, None, 0.1, 1.0)
    x = np.random.default_rng(2).normal(size=20)
    source = tmp_path / "in"
    for k in range(4):
        part = spark.createDataFrame([(1, f, float(x[f])) for f in range(5 * k, 5 * k + 5)], "run_id int, frame long, value double")
        part.coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("run_id int, frame long, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        windows.filter_stream(stream, sections).writeStream.format("memory").queryName("filtered").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    found = [r.value for r in spark.table("filtered").orderBy("frame").collect()]
    whole = spark.createDataFrame([(x.tolist(),)], "ts array<double>").select(signal.filter_array("ts", sections).alias("y")).first().y
    assert np.allclose(found, whole)


def test_event_windows_stream(spark, tmp_path):
    from datetime import datetime

    rows = [("a", datetime(2024, 1, 1, 0, m), float(m)) for m in range(0, 50, 5)]
    spark.createDataFrame(rows, "kind string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("kind string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    query = (
        windows.event_windows(stream, "20 minutes", "10 minutes", "1 minute", ["kind"]).writeStream.format("memory").queryName("counted")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert {r.n for r in spark.table("counted").collect()} <= {2, 4} and spark.table("counted").count() >= 3


def test_normaliser_knows_training_subjects_only(spark):
    rows = [("a", 0, 1.0), ("a", 0, 3.0), ("b", 0, 10.0), ("b", 0, 10.0), ("b", 1, 5.0)]
    df = spark.createDataFrame(rows, "sub string, feature int, value double")
    model = signal.SubjectNormalizer().fit(df.where("sub = 'a' OR feature = 0"))
    found = {(r["sub"], r.feature): r.value for r in model.transform(spark.createDataFrame([("a", 0, 3.0), ("c", 0, 6.0), ("b", 0, 11.0)], df.schema)).collect()}
    assert found[("a", 0)] == 1.0 and found[("c", 0)] == 0.0 and found[("b", 0)] is None


def test_trim_and_slice(spark):
    sizes = spark.createDataFrame([(1, 30, 5), (2, 31, 5)], "run_id int, n_frames int, n_labels int")
    model = signal.Trimmer(delay=3, per_label=4).fit(sizes)
    assert model.trim == 7
    cells = spark.createDataFrame([(1, f, float(f)) for f in range(30)], "run_id int, frame int, value double")
    found = model.transform(cells).orderBy("frame").collect()
    assert [r.value for r in found] == [float(f) for f in range(3, 23)] and found[0].frame == 0
    df = spark.createDataFrame([(list(map(float, range(20))),)], "ts array<double>")
    slices = signal.Slicer(event_len=4, n_labels=4, delay=1, extra=2).transform(df).orderBy("event_idx").collect()
    assert [s.window for s in slices] == [list(map(float, range(1 + 4 * i, 11 + 4 * i))) for i in range(3)]
    assert signal.Slicer(event_len=4, n_labels=1).transform(df).count() == 0


def _long_rows(lengths, gaps=False, seed=0):
    r = np.random.default_rng(seed)
    out = {}
    for run, n in enumerate(lengths):
        frames = np.cumsum(r.integers(1, 5, n)) if gaps else np.arange(n)
        out[run] = (frames, r.normal(size=n))
    return out


@pytest.mark.parametrize("cutoffs", [(None, 0.1), (0.05, None), (0.02, 0.2)])
@pytest.mark.parametrize("order,block,gaps", [(1, 3, False), (4, 16, True), (3, 64, False)])
def test_long_runs_equal_whole_ones(spark, cutoffs, order, block, gaps):
    sections = signal.butterworth(order, *cutoffs, 1.0)
    runs = _long_rows([1, block - 1, block, block + 1, 7 * block + 2, 900], gaps)
    rows = [(k, int(f), float(v), "x") for k, (frames, values) in runs.items() for f, v in zip(frames, values, strict=True)]
    df = spark.createDataFrame(rows, "run_id int, frame int, value double, feature string").repartition(5)
    got = {(x.run_id, x.frame): x.value for x in signal.filter_long_runs(df, sections, ("run_id", "feature"), block).collect()}
    arrays = spark.createDataFrame([(k, v.tolist()) for k, (_, v) in runs.items()], "run_id int, ts array<double>")
    want = {x.run_id: x.y for x in arrays.select("run_id", signal.filter_rows(sections)("ts").alias("y")).collect()}
    assert len(got) == len(rows)
    for k, (frames, _) in runs.items():
        assert np.allclose([got[k, int(f)] for f in frames], want[k], rtol=0, atol=1e-9)


def test_long_runs_with_nulls(spark):
    rows = [(None, f, 1.0) for f in range(10)] + [(1, f, None if f == 4 else 1.0) for f in range(10)]
    df = spark.createDataFrame(rows, "run_id int, frame int, value double")
    got = {(x.run_id, x.frame): x.value for x in signal.filter_long_runs(df, signal.butterworth(2, None, 0.1, 1.0), block=3).collect()}
    assert all(np.isnan(got[1, f]) == (f >= 4) for f in range(10)) and all(got[None, f] == pytest.approx(got[1, f]) for f in range(4))
    assert signal.filter_long_runs(df.where("false"), signal.butterworth(2, None, 0.1, 1.0)).collect() == []


def test_one_run_of_a_million_frames_is_filtered_in_many_tasks(spark):
    sections = signal.butterworth(2, 0.01, 0.2, 1.0)
    df = spark.range(1_000_000).selectExpr("0 AS run_id", "id AS frame", "sin(id * 0.37) + (id % 11) / 7.0 AS value")
    got = signal.filter_long_runs(df, sections, block=8192).orderBy("frame").select("value").toArrow().column(0).to_numpy()
    t = np.arange(1_000_000)
    x, state = np.sin(t * 0.37) + (t % 11) / 7.0, [(0.0, 0.0)] * len(sections)
    for i in range(200_000):
        v = x[i]
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            p, q = state[k]
            y = b0 * v + p
            state[k] = (b1 * v - a1 * y + q, b2 * v - a2 * y)
            v = y
        if i % 997 == 0 or i > 199_900:
            assert abs(v - got[i]) < 1e-9
    assert len(got) == 1_000_000
