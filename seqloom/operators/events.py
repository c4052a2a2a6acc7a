"""Event rows: merging, letters, code books and sampled onsets.

An event row has the columns ``run_id, row_idx, onset, duration, trial_type, letter``; ``row_idx``
gives the order of the file. All windows are by run, so runs are independent of each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scalar import SATURATION_DECAY, letter_from_mark, saturation

RUN = "run_id"


def merge_adjacent(events: DataFrame, ignore: tuple[str, ...] = ("rest",), merge: bool = True) -> DataFrame:
    """Events by type; one that starts exactly where its forerunner of the same type ends continues it.

    Overlapping events are not merged. Returns run_id, trial_type, event_idx, onset_s, duration_s.
    """
    kept = events.where(~F.col("trial_type").isin(*ignore)) if ignore else events
    by_type = Window.partitionBy(RUN, "trial_type").orderBy("row_idx")
    follows = F.lag(F.col("onset") + F.col("duration")).over(by_type) == F.col("onset") if merge else F.lit(False)
    islands = kept.withColumn("event_idx", F.sum(F.when(follows, 0).otherwise(1)).over(by_type) - 1)
    return islands.groupBy(RUN, "trial_type", "event_idx").agg(
        F.min("onset").alias("onset_s"), F.sum("duration").alias("duration_s")
    )


def distinct_onsets(events: DataFrame, onset: str = "onset", out: str = "letter") -> DataFrame:
    """Rows whose onset differs from the row before: one row for each letter of the run.

    ``onset`` may be a text column; then '1.0' and '1.00' differ. The mark '_' becomes a space.
    """
    in_order = Window.partitionBy(RUN).orderBy("row_idx")
    changed = ~F.lag(onset).over(in_order).eqNullSafe(F.col(onset)) | (F.row_number().over(in_order) == 1)
    return events.withColumn("__changed", changed).where("__changed").drop("__changed").withColumn(
        out, letter_from_mark("letter")
    )


def letter_transitions(letters: DataFrame) -> DataFrame:
    """Each letter with the next one of its run, as one string; the last letter of a run has none."""
    in_order = Window.partitionBy(RUN).orderBy("row_idx")
    pair = F.concat("letter", F.lead("letter").over(in_order))
    return letters.withColumn("pair", pair).where("pair IS NOT NULL").select(RUN, "row_idx", "pair")


def code_book(events: DataFrame) -> DataFrame:
    """letter, region, bit: the regions (trial types) that are active at a letter's first onset."""
    rows = events.withColumn("letter", letter_from_mark("letter"))
    first = rows.groupBy("letter").agg(F.min(F.struct(RUN, "onset")).alias("first"))
    at_first = rows.join(first, "letter").where(
        (F.col(RUN) == F.col("first")[RUN]) & (F.col("onset") == F.col("first")["onset"])
    )
    active = at_first.select("letter", F.col("trial_type").alias("region")).distinct().withColumn("bit", F.lit(1))
    # as many letters and regions as the alphabet has
    grid = rows.select("letter").distinct().crossJoin(rows.select(F.col("trial_type").alias("region")).distinct())
    return grid.join(active, ["letter", "region"], "left").select("letter", "region", F.coalesce("bit", F.lit(0)).alias("bit"))


def label_events(events: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """Letters of each run with the bit of each region: run_id, row_idx, letter, region, bit.

    Without a code book it is learned from the events themselves.
    """
    letters = distinct_onsets(events).select(RUN, "row_idx", "letter")
    return letters.join(code_book(events) if book is None else book, "letter")


def _sample(seconds: Column, resolution_s: float) -> Column:
    return F.floor(seconds / F.lit(resolution_s)).cast("long")


def epoch_spans(resolution_s: float, method: str) -> tuple[Column, Column, Column]:
    """First sample, end and height (from columns start and stop) of an event's box of area 1."""
    if method not in ("epoch", "epoch_2s"):
        raise ValueError(f"unknown method {method!r}")
    length = F.lit(2) if method == "epoch_2s" else F.col("duration_s")
    height = F.lit(1.0) / F.nullif(F.col("stop") - F.col("start"), F.lit(0))
    return _sample(F.col("onset_s"), resolution_s), _sample(F.col("onset_s") + length, resolution_s), height


def sampled_onsets(
    events: DataFrame, run_len_s: float, resolution_s: float = 0.01, method: str = "nonlinear"
) -> DataFrame:
    """The samples of each run and type that aren't 0: run_id, trial_type, sample, value.

    Takes the rows of ``merge_adjacent``. Methods: ``impulse`` (1 every 4 s of each event),
    ``epoch_2s`` (1 / length over two seconds), ``epoch`` (the same over the duration) and
    ``nonlinear`` (an impulse each second, lowered by those before it in proportion to their
    saturation). Where events overlap, the later one counts. Samples outside the run are left out.
    """
    start = _sample(F.col("onset_s"), resolution_s)
    keys = [RUN, "trial_type"]
    if method == "nonlinear":
        return _nonlinear(events, run_len_s, resolution_s)
    if method == "impulse":
        stop = _sample(F.col("onset_s") + F.col("duration_s"), resolution_s)
        step, value = int(4 / resolution_s), F.lit(1.0)
    else:
        start, stop, value = epoch_spans(resolution_s, method)
        step = 1
    spans = events.withColumn("start", start).withColumn("stop", stop).where("stop > start")
    samples = spans.select(*keys, "event_idx", value.alias("value"), F.explode(F.expr(f"sequence(start, stop - 1, {step}L)")).alias("sample"))
    inside = samples.where((F.col("sample") >= 0) & (F.col("sample") < int(run_len_s / resolution_s)))
    return inside.groupBy(*keys, "sample").agg(F.max_by("value", "event_idx").alias("value"))


#: Seconds in a block of the running sum: within it no power leaves the range of a double.
_BLOCK = 256


def _nonlinear(events: DataFrame, run_len_s: float, resolution_s: float) -> DataFrame:
    """v(t) = max(0, 1 - sum of the saturation at the lags of the impulses before t, in whole seconds).

    For the first impulse of an event the lags count one second more.

    Saturation falls geometrically, so the sum over all earlier impulses is one running sum,
    g(first) / e(t) * sum of e(s) over s < t with e(s) = exp(decay * s); no pair of impulses is joined.
    It runs in blocks: of the blocks before the last one less than 1e-77 is left.
    """
    keys = [RUN, "trial_type"]
    second = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.round("duration_s").cast("int")) - 1))
    impulses = events.select(*keys, "event_idx", "onset_s", second.alias("second"))
    impulses = impulses.select(
        *keys,
        (F.floor("onset_s") + F.col("second")).cast("long").alias("t"),
        F.struct("event_idx", (F.col("second") == 0).cast("int").alias("first")).alias("last"),
        (_sample(F.col("onset_s"), resolution_s) + (F.col("second") / F.lit(resolution_s)).cast("long")).alias("sample"),
    )
    # impulses of one second count once
    impulses = impulses.groupBy(*keys, "t").agg(F.max("sample").alias("sample"), F.max("last")["first"].alias("first")).withColumn("block", F.floor(F.col("t") / _BLOCK))
    power = F.exp(F.lit(SATURATION_DECAY) * (F.col("t") - _BLOCK * (F.col("block") + 1)))
    impulses = impulses.withColumn("power", power)
    earlier = Window.partitionBy(*keys, "block").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    # the sort of the first window serves the second, so rows are neither read twice nor joined
    block_before = Window.partitionBy(*keys).orderBy("block").rangeBetween(-1, -1)
    summed = impulses.withColumn("past", F.coalesce(F.sum("power").over(earlier), F.lit(0.0)))
    carried = F.coalesce(F.sum("power").over(block_before), F.lit(0.0)) * math.exp(-SATURATION_DECAY * _BLOCK)
    left = F.greatest(F.lit(0.0), 1 - saturation(F.col("first")) * (F.col("past") + carried) / F.col("power"))
    values = summed.withColumn("value", left)
    inside = values.where((F.col("sample") >= 0) & (F.col("sample") < int(run_len_s / resolution_s)))
    return inside.groupBy(*keys, "sample").agg(F.max_by("value", "t").alias("value"))
