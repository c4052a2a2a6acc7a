"""Design matrices: response functions, drift, convolution, confounds and contrasts.

A design is a long table ``run_id, frame, regressor, value``; response functions and drift are small
tables that depend on parameters alone and are made by expressions over ``spark.range``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.scalar import fwhm_to_sigma
from seqloom.operators.events import epoch_spans, sampled_onsets

RUN = "run_id"


def _gamma_density(t: Column, shape: float, scale: float) -> Column:
    """Density of the gamma distribution, 0 below 0; the constants come from the driver."""
    log_norm = math.lgamma(shape) + shape * math.log(scale)
    inside = F.exp((shape - 1) * F.log(F.greatest(t, F.lit(1e-300))) - t / scale - log_norm)
    at_zero = 1 / scale if shape == 1 else 0.0
    return F.when(t > 0, inside).when(t == 0, F.lit(at_zero)).otherwise(F.lit(0.0))


def response(
    t: Column, resolution_s: float, onset_s: float = 0.0, peak_delay_s: float = 6, undershoot_delay_s: float = 16,
    peak_dispersion: float = 1, undershoot_dispersion: float = 1, ratio: float = 6,
) -> Column:
    """Difference of two gamma densities at sample ``t``; not normalised."""
    at = t.cast("double") - F.lit(onset_s / resolution_s)
    peak = _gamma_density(at, peak_delay_s / peak_dispersion, peak_dispersion / resolution_s)
    under = _gamma_density(at, undershoot_delay_s / undershoot_dispersion, undershoot_dispersion / resolution_s)
    return peak - under / ratio


def response_basis(
    spark: SparkSession, resolution_s: float, length_s: float = 32, onset_s: float = 0.0, delta_t_s: float = 1.0,
    d_dispersion: float = 0.01, **shape,
) -> DataFrame:
    """sample, seconds, hrf, d_hrf (in time) and dd_hrf (in dispersion), as they are.

    The derivative in time is the difference to the response at ``delta_t_s`` and isn't divided; that
    in dispersion is always divided by 0.01.
    """
    t = F.col("sample")
    plain = response(t, resolution_s, onset_s, **shape)
    wider = shape | {"peak_dispersion": shape.get("peak_dispersion", 1) + d_dispersion}
    return spark.range(math.ceil(length_s / resolution_s)).select(F.col("id").alias("sample")).select(
        "sample",
        ((t - onset_s / resolution_s) * resolution_s).alias("seconds"),
        plain.alias("hrf"),
        (plain - response(t, resolution_s, delta_t_s, **shape)).alias("d_hrf"),
        ((plain - response(t, resolution_s, onset_s, **wider)) / 0.01).alias("dd_hrf"),
    )


def scaled_basis(basis: DataFrame) -> DataFrame:
    """(sample, basis_idx, weight): the three responses, all divided by the largest value of the first."""
    top = basis.agg(F.max("hrf").alias("__top"))
    parts = F.array("hrf", "d_hrf", "dd_hrf")
    return basis.crossJoin(F.broadcast(top)).select("sample", F.posexplode(parts).alias("basis_idx", "weight"), "__top").select(
        "sample", "basis_idx", (F.col("weight") / F.col("__top")).alias("weight")
    )


def drift_order(n_frames: int, frame_s: float, cutoff_hz: float = 0.008) -> int:
    return max(math.floor(2 * cutoff_hz * (n_frames - 1) * frame_s), 1)


def drift_basis(spark: SparkSession, n_frames: int, frame_s: float, cutoff_hz: float = 0.008) -> DataFrame:
    """frame, k, value: cosines that are slower than the cutoff; k = 0 is constant."""
    order = drift_order(n_frames, frame_s, cutoff_hz)
    grid = spark.range(n_frames * order).select(
        F.expr(f"id div {order}").alias("frame"), F.expr(f"id % {order}").cast("int").alias("k")
    )
    value = F.cos(F.lit(math.pi / n_frames) * (F.col("frame") + 0.5) * F.col("k"))
    return grid.withColumn("value", F.when(F.col("k") == 0, 1.0).otherwise(value))


def convolve(onsets: DataFrame, basis: DataFrame, frame_s: float, run_len_s: float, resolution_s: float = 0.01) -> DataFrame:
    """Causal convolution of sampled onsets, read at every frame: run_id, trial_type, frame, basis_idx, value.

    Only samples that aren't 0 are worked on. Each gives a row for every frame that it reaches, which
    meets the basis by lag: an equi-join with a table as long as the basis, then a sum that is
    combined before it is shuffled. Frames that nothing reaches have no row.
    """
    steps = int(frame_s / resolution_s)
    n_frames = int(run_len_s / resolution_s) // steps
    size = basis.agg(F.max("sample").alias("reach"), F.max("basis_idx").alias("k")).first()  # of a table as long as the response
    if size["k"] is None:
        return onsets.limit(0).select(RUN, "trial_type", F.col("sample").alias("frame"), F.lit(0).alias("basis_idx"), "value")
    first = F.expr(f"(sample + {steps - 1}) div {steps}")
    last = F.least(F.expr(f"(sample + {size['reach']}) div {steps}"), F.lit(n_frames - 1))
    spread = onsets.withColumn("__first", first).withColumn("__last", last).where("__first <= __last")
    spread = spread.withColumn("frame", F.explode(F.sequence("__first", "__last")))
    hits = spread.select(RUN, "trial_type", "frame", (F.col("frame") * steps - F.col("sample")).alias("lag"), F.col("value").alias("__v"))
    # all functions of a lag side by side, so that a hit is one row
    indices = range(size["k"] + 1)
    by_lag = basis.groupBy(F.col("sample").alias("lag")).agg(*[F.sum(F.when(F.col("basis_idx") == k, F.col("weight"))).alias(f"__w{k}") for k in indices])
    sums = hits.join(F.broadcast(by_lag), "lag").groupBy(RUN, "trial_type", "frame").agg(
        *[F.sum(F.col("__v") * F.col(f"__w{k}")).alias(f"__s{k}") for k in indices]
    )
    values = F.posexplode(F.array(*[f"__s{k}" for k in indices])).alias("basis_idx", "value")
    return sums.select(RUN, "trial_type", "frame", values)


def convolve_epochs(
    merged: DataFrame, basis: DataFrame, frame_s: float, run_len_s: float, resolution_s: float = 0.01, method: str = "epoch"
) -> DataFrame:
    """What ``convolve`` gives for the ``epoch`` or ``epoch_2s`` onsets of merged events, without their samples.

    An epoch is a box, so at a frame it adds the difference of two running sums of the basis: a row for
    each frame that an event reaches, whatever the resolution. Runs in which events of a type overlap
    (there the later one counts) are sampled.
    """
    steps = int(frame_s / resolution_s)
    n_samples = int(run_len_s / resolution_s)
    n_frames = n_samples // steps
    size = basis.agg(F.max("sample").alias("reach"), F.max("basis_idx").alias("k")).first()  # of a table as long as the response
    if size["k"] is None:
        return convolve(sampled_onsets(merged, run_len_s, resolution_s, method), basis, frame_s, run_len_s, resolution_s)
    start, stop, value = epoch_spans(resolution_s, method)
    spans = merged.select(RUN, "trial_type", "event_idx", "onset_s", "duration_s", start.alias("start"), stop.alias("stop")).where("stop > start")
    spans = spans.withColumn("__v", value)
    earlier = Window.partitionBy(RUN, "trial_type").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(RUN, "trial_type")
    marked = spans.withColumn("__meets", F.coalesce(F.max("stop").over(earlier) > F.col("start"), F.lit(False)))
    marked = marked.withColumn("__overlap", F.max("__meets").over(whole))
    boxes = marked.where("NOT __overlap").select(
        RUN, "trial_type", F.greatest("start", F.lit(0)).alias("a"), F.least("stop", F.lit(n_samples)).alias("z"), "__v"
    ).where("z > a")
    last = F.least(F.expr(f"(z - 1 + {size['reach']}) div {steps}"), F.lit(n_frames - 1))
    hits = boxes.withColumn("__first", F.expr(f"(a + {steps - 1}) div {steps}")).withColumn("__last", last).where("__first <= __last")
    hits = hits.withColumn("frame", F.explode(F.sequence("__first", "__last")))
    lag = lambda c: F.least(F.col("frame") * steps - F.col(c), F.lit(size["reach"])).alias(f"__lag_{c}")
    hits = hits.select(RUN, "trial_type", "frame", "__v", lag("a"), lag("z"))
    indices = range(size["k"] + 1)
    so_far = Window.orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)  # over a table as long as the response
    wide = basis.groupBy("sample").agg(*[F.sum(F.when(F.col("basis_idx") == k, F.col("weight"))).alias(f"__w{k}") for k in indices])
    sums = wide.select("sample", *[F.sum(f"__w{k}").over(so_far).alias(f"__c{k}") for k in indices])
    side = lambda c: F.broadcast(sums.select(F.col("sample").alias(f"__lag_{c}"), *[F.col(f"__c{k}").alias(f"__{c}{k}") for k in indices]))
    met = hits.join(side("a"), "__lag_a").join(side("z"), "__lag_z", "left")
    totals = met.groupBy(RUN, "trial_type", "frame").agg(
        *[F.sum(F.col("__v") * (F.col(f"__a{k}") - F.coalesce(f"__z{k}", F.lit(0.0)))).alias(f"__s{k}") for k in indices]
    )
    values = F.posexplode(F.array(*[f"__s{k}" for k in indices])).alias("basis_idx", "value")
    found = totals.select(RUN, "trial_type", "frame", values)
    rest = marked.where("__overlap").select(RUN, "trial_type", "event_idx", "onset_s", "duration_s")
    sampled = convolve(sampled_onsets(rest, run_len_s, resolution_s, method), basis, frame_s, run_len_s, resolution_s)
    return found.unionByName(sampled.select(*found.columns))


def stimulus_design(
    spark: SparkSession, stimuli: DataFrame, n_frames: int, sampling_hz: float, cutoff_hz: float = 1 / 128, resolution_s: float = 0.1,
    digits: int | None = None,
) -> DataFrame:
    """Long design of unit impulses at the stimuli (run_id, trial_type, onset_s), three responses each,
    and drift: run_id, frame, regressor, value. An impulse stands at the sample at or after its time.
    With ``digits`` values are rounded where they are made: those of the drift once, not for each run."""
    short = lambda c: c if digits is None else F.round(c, digits)
    frame_s = 1 / sampling_hz
    run_len_s = n_frames * frame_s
    impulses = stimuli.select(
        RUN, "trial_type", F.ceil(F.col("onset_s") / F.lit(resolution_s)).cast("long").alias("sample"), F.lit(1.0).alias("value")
    ).distinct()
    basis = scaled_basis(response_basis(spark, resolution_s))
    shaped = convolve(impulses, basis, frame_s, run_len_s, resolution_s)
    named = shaped.select(RUN, "frame", F.concat_ws("_", "trial_type", "basis_idx").alias("regressor"), short(F.col("value")).alias("value"))
    drift = drift_basis(spark, n_frames, frame_s, cutoff_hz).select("frame", F.concat(F.lit("drift_"), "k").alias("regressor"), short(F.col("value")).alias("value"))
    runs = stimuli.select(RUN).distinct()
    return named.unionByName(runs.crossJoin(F.broadcast(drift)).select(RUN, "frame", "regressor", "value"))


#: Fixed names of confound columns, by group.
MOTION = ["trans_x", "trans_y", "trans_z", "rot_x", "rot_y", "rot_z"]
CSF = ["csf", "csf_derivative1", "csf_derivative1_power2", "csf_power2"]
WHITE_MATTER = ["white_matter", "white_matter_derivative1", "white_matter_derivative1_power2", "white_matter_power2"]


def confounds(
    df: DataFrame, motion: bool = True, motion_derivative: bool = True, motion_squared: bool = True,
    motion_derivative_squared: bool = True, csf: bool = True, white_matter: bool = False, motion_outlier: bool = True,
    run: str = RUN, frame: str = "frame",
) -> DataFrame:
    """The chosen confound columns in their order, cleaned.

    'n/a' becomes NaN; the first frame of a column with ``derivative1`` in its name takes the value of
    the second; CSF and white matter are divided by their largest value in the run (NaN if it is).
    """
    wanted = [c for on, group in (
        (motion, MOTION), (motion_derivative, [f"{c}_derivative1" for c in MOTION]), (motion_squared, [f"{c}_power2" for c in MOTION]),
        (motion_derivative_squared, [f"{c}_derivative1_power2" for c in MOTION]), (csf, CSF), (white_matter, WHITE_MATTER),
        (motion_outlier, [c for c in df.columns if c.startswith("motion_outlier")]),
    ) if on for c in group]
    in_order, whole = Window.partitionBy(run).orderBy(frame), Window.partitionBy(run)

    def number(c: str) -> Column:
        raw = F.col(f"`{c}`").cast("string")
        return F.when(raw == "n/a", F.lit(float("nan"))).otherwise(raw.cast("double"))

    filled = df.select(run, frame, *[number(c).alias(c) for c in wanted])
    # F.lead is of the run's own rows, so the first frame is the one without a row before it
    derived = [c for c in wanted if "derivative1" in c]
    first = F.row_number().over(in_order) == 1
    filled = filled.select(
        *[c for c in filled.columns if c not in derived],
        *[F.when(first, F.lead(c).over(in_order)).otherwise(F.col(c)).alias(c) for c in derived],
    )
    scaled = [c for c in wanted if c in CSF or c in WHITE_MATTER]
    parts = {c: F.try_divide(F.col(c), F.max(c).over(whole)) for c in scaled}
    return filled.select(run, frame, *[parts.get(c, F.col(c)).alias(c) for c in wanted])


def outlier_frames(df: DataFrame, run: str = RUN, frame: str = "frame") -> DataFrame:
    """(run, frame) of every marked cell of the ``motion_outlier`` columns; NaN counts as marked."""
    marks = [c for c in df.columns if c.startswith("motion_outlier")]
    if not marks:
        return df.select(run, frame).limit(0)
    cells = F.explode(F.array(*[F.col(f"`{c}`").cast("double") for c in marks]))
    return df.select(run, frame, cells.alias("__mark")).where("__mark <> 0").select(run, frame)


def contrasts(types: DataFrame, per_type: int = 3) -> DataFrame:
    """Each type against the baseline and each pair of types.

    ``types`` has one column trial_type; the regressors of the k-th type in sorted order stand at
    k * per_type and following. Returns contrast_id, name, weights, and boost_masks: for each sign the
    regressors whose derivatives may lend their strength.
    """
    # as many types as the experiment has, so one task may number them
    ordered = types.select("trial_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("trial_type")) - 1)
    numbered = ordered.crossJoin(F.broadcast(ordered.agg(F.count(F.lit(1)).cast("int").alias("n"))))
    width = F.sequence(F.lit(0), F.col("n") * per_type - 1)
    of = lambda k: F.transform(width, lambda i: F.floor(i / per_type) == F.col(k))
    unit = 1.0 / per_type
    single = numbered.select(
        F.lit(0).alias("kind"), F.col("k").alias("a"), F.lit(-1).alias("b"), F.col("trial_type").alias("name"),
        F.transform(of("k"), lambda x: F.when(x, unit).otherwise(0.0)).alias("weights"), F.array(of("k")).alias("boost_masks"),
    )
    other = ordered.select(F.col("trial_type").alias("other"), F.col("k").alias("k2"))
    pairs = numbered.join(F.broadcast(other), F.col("k") < F.col("k2")).select(
        F.lit(1).alias("kind"), F.col("k").alias("a"), F.col("k2").alias("b"), F.concat_ws(" - ", "trial_type", "other").alias("name"),
        F.zip_with(of("k"), of("k2"), lambda x, y: F.when(x, unit).when(y, -unit).otherwise(0.0)).alias("weights"),
        F.array(of("k"), of("k2")).alias("boost_masks"),
    )
    number = F.row_number().over(Window.orderBy("kind", "a", "b")) - 1
    return single.unionByName(pairs).select(number.alias("contrast_id"), "name", "weights", "boost_masks")


def smoothing_kernel(spark: SparkSession, fwhm_mm: tuple, resolution_mm: tuple) -> DataFrame:
    """dx, dy, dz, weight of a Gaussian smoothing kernel, not normalised.

    The half length of an axis is int(0.75 * fwhm * resolution); the variance of an axis, in cells, is
    the sigma of fwhm * resolution (not its square).
    """
    axes = []
    for name, fwhm, res in zip(("dx", "dy", "dz"), fwhm_mm, resolution_mm, strict=True):
        half = int(0.75 * fwhm * res)
        variance = fwhm_to_sigma(F.lit(float(fwhm * res)))
        axis = spark.range(-half, half + 1).select(F.col("id").cast("int").alias(name))
        density = F.exp(-F.col(name) * F.col(name) / (2 * variance)) / F.sqrt(2 * math.pi * variance)
        axes.append(axis.withColumn(f"w_{name}", density))
    return axes[0].crossJoin(axes[1]).crossJoin(axes[2]).select("dx", "dy", "dz", F.expr("w_dx * w_dy * w_dz").alias("weight"))
