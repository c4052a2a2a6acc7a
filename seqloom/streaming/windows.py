"""Streams of frames: recursive filters that carry their state, and overlapping event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def filter_stream(frames: DataFrame, sections: list[tuple[float, ...]], key: str = "run_id") -> DataFrame:
    """Causal filter of a stream (key, frame, value): key, frame, value, with two numbers of state for
    each section and key. Frames of a key must come in order, batch after batch."""
    kind = frames.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = list(state.get[0]) if state.exists else [0.0] * (2 * len(sections))
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        out = []
        for v in rows["value"]:
            for i, (b0, b1, b2, a1, a2) in enumerate(sections):
                y = b0 * v + memory[2 * i]
                memory[2 * i], memory[2 * i + 1] = b1 * v - a1 * y + memory[2 * i + 1], b2 * v - a2 * y
                v = y
            out.append(float(v))
        state.update((memory,))
        yield pd.DataFrame({key: k[0], "frame": rows["frame"].to_numpy(), "value": out})

    return frames.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, frame long, value double", "memory array<double>", "append", GroupStateTimeout.NoTimeout
    )


def event_windows(events: DataFrame, length: str, every: str, late: str, by: list[str]) -> DataFrame:
    """Counts and means over overlapping windows of event time, each given out once when it is past."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", length, every), *by)
    return windows.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "mean"
    )
