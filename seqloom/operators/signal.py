"""Filters, normalisation, trimming and slicing of runs, as ``pyspark.ml`` stages.

Runs are long tables ``run_id, frame, feature, value`` or one array of frames for each run and
feature. Recursive filters work on arrays with a fold, so they need neither Python nor a shuffle
once a run's frames are in one array; ``filter_long_runs`` cuts runs into blocks instead, so that no row holds one.
"""

from __future__ import annotations

import cmath
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.storage import cut_lineage

RUN = "run_id"


def butterworth(order: int, low_hz: float | None, high_hz: float | None, sampling_hz: float) -> list[tuple[float, ...]]:
    """Second-order sections (b0, b1, b2, a1, a2) of a Butterworth filter by the bilinear transform.

    Only ``low_hz``: high-pass; only ``high_hz``: low-pass; both: band-pass.
    """
    warp = lambda hz: 2 * sampling_hz * math.tan(math.pi * hz / sampling_hz)
    analog = [cmath.exp(1j * math.pi * (2 * k + order + 1) / (2 * order)) for k in range(order)]
    if low_hz is None and high_hz is None:
        raise ValueError("a filter needs a cutoff")
    if low_hz is None:
        poles, zeros = [p * warp(high_hz) for p in analog], [-1.0] * order
    elif high_hz is None:
        poles, zeros = [warp(low_hz) / p for p in analog], [1.0] * order
    else:
        low, high = warp(low_hz), warp(high_hz)
        half, centre = (high - low) / 2, low * high
        poles = [q for p in analog for q in (p * half + cmath.sqrt((p * half) ** 2 - centre), p * half - cmath.sqrt((p * half) ** 2 - centre))]
        zeros = [1.0, -1.0] * order
    digital = [(2 * sampling_hz + p) / (2 * sampling_hz - p) for p in poles]
    upper = sorted((p for p in digital if p.imag > 1e-12), key=abs)
    real = sorted(p.real for p in digital if abs(p.imag) <= 1e-12)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper]
    pairs += [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=False)]
    lone = real[-1:] if len(real) % 2 else []
    zeros = sorted(zeros)
    both = low_hz is not None and high_hz is not None
    numerators = [(1.0, 0.0, -1.0)] * len(pairs) if both else [(1.0, -2 * zeros[0], 1.0)] * len(pairs)
    sections = [(*n, *d) for n, d in zip(numerators, pairs, strict=True)]
    sections += [(1.0, -zeros[0], 0.0, -p, 0.0) for p in lone]
    # the gain is 1 in the middle of what passes
    if both:
        at = 2 * math.atan(math.sqrt(warp(low_hz) * warp(high_hz)) / (2 * sampling_hz))
    else:
        at = math.pi if high_hz is None else 0.0
    z = cmath.exp(1j * at)
    gain = 1.0
    for b0, b1, b2, a1, a2 in sections:
        gain *= abs((b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2))
    b0, b1, b2, a1, a2 = sections[0]
    return [(b0 / gain, b1 / gain, b2 / gain, a1, a2), *sections[1:]]


def filter_array(ts: Column | str, sections: list[tuple[float, ...]]) -> Column:
    """Causal filter of an array, starting at rest: one fold over the array for each section."""
    out = F.col(ts) if isinstance(ts, str) else ts
    for b0, b1, b2, a1, a2 in sections:
        rest = F.struct(F.array().cast("array<double>").alias("y"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
        out = F.aggregate(out, rest, _section_step(b0, b1, b2, a1, a2), lambda s: s["y"])
    return out


def _section_step(b0: float, b1: float, b2: float, a1: float, a2: float):
    def step(s: Column, x: Column) -> Column:
        y = F.lit(b0) * x + s["p"]
        p, q = F.lit(b1) * x - F.lit(a1) * y + s["q"], F.lit(b2) * x - F.lit(a2) * y
        return F.struct(F.concat(s["y"], F.array(y)).alias("y"), p.alias("p"), q.alias("q"))

    return step


def filter_rows(sections: list[tuple[float, ...]]):
    """The same filter as a pandas UDF: linear in the number of frames, for long runs.

    (The fold above copies its result at each frame, which is the faster way only for short arrays.)
    """

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        out = [None if r is None else np.array(r, dtype=float) for r in rows]
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(out):
            if r is not None:
                by_length.setdefault(len(r), []).append(i)
        for n, members in by_length.items():
            x = np.stack([out[i] for i in members]) if n else np.zeros((len(members), 0))
            for b0, b1, b2, a1, a2 in sections:
                p = q = np.zeros(len(members))
                y = np.empty_like(x)
                for t in range(n):
                    y[:, t] = b0 * x[:, t] + p
                    p, q = b1 * x[:, t] - a1 * y[:, t] + q, b2 * x[:, t] - a2 * y[:, t]
                x = y
            for i, r in zip(members, x, strict=True):
                out[i] = r
        return pd.Series(out, dtype=object)

    return run


def state_space(sections: list[tuple[float, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The sections one after another as one linear system with two numbers of state for each section:
    s' = A s + B x, y = C s + D x."""
    n = 2 * len(sections)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        # what comes into this section is c s + d x
        p, q = 2 * k, 2 * k + 1
        out_c, out_d = b0 * c, b0 * d
        out_c[p] += 1
        for row, bk, ak, nxt in ((p, b1, a1, q), (q, b2, a2, None)):
            a[row] = bk * c - ak * out_c
            b[row] = bk * d - ak * out_d
            if nxt is not None:
                a[row, nxt] += 1
        c, d = out_c, out_d
    return a, b, c, d


def filter_long_runs(cells: DataFrame, sections: list[tuple[float, ...]], keys: tuple[str, ...] = (RUN,), block: int = 4096) -> DataFrame:
    """The causal filter of runs of any length: keys, frame, value for every row of ``cells`` (keys, frame, value).

    A run's values stand in order of frame, whatever gaps the numbers have. Each block is filtered from rest;
    what the state before it adds is A^t of that state, and the states at the beginnings of blocks follow
    from each other by one matrix for a block's length and the block's own end, a few numbers for each
    block, which are chained in order. No task holds a run. Values that are null or NaN give NaN from there on.
    """
    a, b, c, d = state_space(sections)
    n = len(b)
    # C A^t for the places of a block: what a state before it adds to them
    reach = np.zeros((block, n))
    row = c.copy()
    for t in range(block):
        reach[t] = row
        row = row @ a
    rows = cells.select(*keys, F.col("frame").cast("long").alias("frame"), F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
    part = rows.withColumn("__block", F.floor(F.col("frame") / block))
    packed = part.groupBy(*keys, "__block").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("__v"))
    packed = packed.select(*keys, "__block", F.col("__v.frame").alias("__frames"), F.col("__v.value").alias("__values"))
    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)

    def from_rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch["__values"]])
            ends, values = [None] * len(batch), [None] * len(batch)
            for size in np.unique(sizes).tolist():  # blocks of one length at once
                at = np.flatnonzero(sizes == size)
                x = np.stack([np.asarray(batch["__values"].iloc[i], dtype=float) for i in at])
                state, y = np.zeros((len(at), n)), np.empty_like(x)
                for t in range(size):
                    y[:, t] = state @ c + d * x[:, t]
                    state = state @ a.T + x[:, t, None] * b
                for i, e, v in zip(at.tolist(), state, y, strict=True):
                    ends[i], values[i] = e.tolist(), v
            yield pd.DataFrame({**{k: batch[k] for k in keys}, "__block": batch["__block"], "__frames": batch["__frames"], "__y": values, "__end": ends})

    ddl = f"{kinds}, __block long, __frames array<long>, __y array<double>, __end array<double>"
    filtered = cut_lineage(packed.mapInPandas(from_rest, ddl), "filtered")
    powers: dict[int, np.ndarray] = {}

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, state = None, np.zeros(n)
        for batch in batches:
            out = []
            for key, size, end in zip(zip(*(batch[k] for k in keys), strict=True), batch["__n"], batch["__end"], strict=True):
                key = tuple(None if pd.isna(v) else v for v in key)
                if key != of:
                    of, state = key, np.zeros(n)
                out.append(state.tolist())
                if size not in powers:
                    powers[size] = np.linalg.matrix_power(a, int(size))
                state = powers[size] @ state + np.asarray(end, dtype=float)
            yield pd.DataFrame({**{k: batch[k] for k in keys}, "__block": batch["__block"], "__state": out})

    thin = filtered.select(*keys, "__block", F.size("__y").alias("__n"), "__end").repartition(*keys).sortWithinPartitions(*keys, "__block")
    states = thin.mapInPandas(chained, f"{kinds}, __block long, __state array<double>")

    def corrected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = [np.asarray(y, dtype=float) + reach[: len(y)] @ np.asarray(s, dtype=float) for y, s in zip(batch["__y"], batch["__state"], strict=True)]
            yield pd.DataFrame({**{k: batch[k] for k in keys}, "frame": batch["__frames"], "value": values})

    same = None
    for k in keys:  # a null key is a run too
        one = filtered[k].eqNullSafe(states[k])
        same = one if same is None else same & one
    both = filtered.join(states, same & (filtered["__block"] == states["__block"])).select(*[filtered[k] for k in keys], "__frames", "__y", "__state")
    done = both.mapInPandas(corrected, f"{kinds}, frame array<long>, value array<double>")
    value = F.transform("value", lambda v: F.coalesce(v, F.lit(float("nan"))))
    return done.select(*keys, F.inline(F.arrays_zip("frame", value.alias("value"))))


class ButterworthFilter(Transformer):
    """Filters the array column ``inputCol`` of each row into ``outputCol``."""

    def __init__(self, low_hz: float | None, high_hz: float | None, sampling_hz: float, order: int = 4, inputCol: str = "ts", outputCol: str = "ts"):
        super().__init__()
        self.sections = butterworth(order, low_hz, high_hz, sampling_hz)
        self.columns = inputCol, outputCol

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source, out = self.columns
        return dataset.withColumn(out, filter_rows(self.sections)(source))


class SubjectNormalizerModel(Model):
    """Normalises (sub, feature, value) with the statistics of the training runs; subjects that these
    don't know get the defaults. Which rows were trained on makes no difference."""

    def __init__(self, statistics: DataFrame, mean: float, deviation: float):
        super().__init__()
        self.statistics, self.mean, self.deviation = statistics, mean, deviation

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = self.statistics.select("sub", "feature", "mean", "deviation")
        joined = dataset.join(known, ["sub", "feature"], "left")
        z = F.try_divide(
            F.col("value") - F.coalesce("mean", F.lit(self.mean)), F.coalesce("deviation", F.lit(self.deviation))
        )
        return joined.withColumn("value", z).drop("mean", "deviation")


class SubjectNormalizer(Estimator):
    """Mean and population deviation of each subject and feature."""

    def _fit(self, dataset: DataFrame) -> SubjectNormalizerModel:
        statistics = subject_statistics(dataset)
        row = defaults_of(statistics).first()
        return SubjectNormalizerModel(statistics, row["mean"] or 0.0, row["deviation"] or 1.0)


def subject_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy("sub", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))


def defaults_of(statistics: DataFrame) -> DataFrame:
    """One row for unknown subjects: the mean of the means and the norm of all deviations."""
    return statistics.agg(F.avg("mean").alias("mean"), F.sqrt(F.sum(F.col("deviation") * F.col("deviation"))).alias("deviation"))


class Trimmer(Estimator):
    """Learns how many frames to cut at the end: the mean over runs of frames - labels * per_label - delay,
    without its fraction."""

    def __init__(self, delay: int, per_label: int):
        super().__init__()
        self.delay, self.per_label = delay, per_label

    def _fit(self, dataset: DataFrame) -> TrimmerModel:
        """``dataset`` has a row for each run: run_id, n_frames, n_labels."""
        return TrimmerModel(self.delay, dataset.agg(tail_trim(self.delay, self.per_label).alias("t")).first()["t"] or 0)


def tail_trim(delay: int, per_label: int) -> Column:
    return F.avg(F.col("n_frames") - F.col("n_labels") * per_label - delay).cast("int")


class TrimmerModel(Model):
    """Keeps the frames from the delay to the trimmed end of each run, numbered from 0 again."""

    def __init__(self, delay: int, trim: int):
        super().__init__()
        self.delay, self.trim = delay, trim

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return trim_frames(dataset, self.delay, F.lit(self.trim))


def trim_frames(cells: DataFrame, delay: int, trim: Column) -> DataFrame:
    n = F.max("frame").over(Window.partitionBy(RUN)) + 1
    kept = cells.withColumn("__end", n - trim).where((F.col("frame") >= delay) & (F.col("frame") < F.col("__end")))
    return kept.withColumn("frame", F.col("frame") - delay).drop("__end")


class Slicer(Transformer):
    """Overlapping windows of an array of frames: one row for each of the n - 1 transitions between n labels.

    Window i starts at delay + i * event_len and has 2 * event_len + extra frames, fewer at the end of
    the run. ``outputCol`` holds the window, ``event_idx`` its number.
    """

    extra = Param(Params._dummy(), "extra", "frames after both events", TypeConverters.toInt)

    def __init__(self, event_len: int, n_labels: int, delay: int = 0, extra: int = 0, inputCol: str = "ts", outputCol: str = "window"):
        super().__init__()
        self.event_len, self.n_labels, self.delay = event_len, n_labels, delay
        self._set(extra=extra)
        self.columns = inputCol, outputCol

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source, out = self.columns
        if self.n_labels < 2:
            return dataset.withColumn("event_idx", F.lit(0)).withColumn(out, F.col(source)).limit(0)
        length = 2 * self.event_len + self.getOrDefault(self.extra)
        rows = dataset.withColumn("event_idx", F.explode(F.sequence(F.lit(0), F.lit(self.n_labels - 2))))
        return rows.withColumn(out, F.slice(source, F.lit(self.delay + 1) + F.col("event_idx") * self.event_len, length))
