"""From recordings and events to fits and t maps: designs of all runs, masks, smoothing, models, contrasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.operators import design, events, glm, volume
from seqloom.sources import image_parts, images, tables
from seqloom.sources.storage import cut_lineage

RUN = "run_id"


def run_designs(
    spark: SparkSession, event_rows: DataFrame, n_frames: int, frame_s: float, confound_rows: DataFrame | None = None,
    cutoff_hz: float = 1 / 128, resolution_s: float = 0.01, method: str = "nonlinear", ignore: tuple[str, ...] = ("rest",),
) -> DataFrame:
    """The designs of all runs: run_id, frame, reg_idx, regressor, value.

    Columns in order: the types of events by name, three responses each; drift; the confounds that
    ``design.confounds`` gives, in their order. All runs have the same columns; a cell without a row is
    0, as are a type's columns in a run without it. A confound that is NaN or null counts as 0.
    """
    run_len_s = n_frames * frame_s
    merged = events.merge_adjacent(event_rows, ignore)
    basis = design.scaled_basis(design.response_basis(spark, resolution_s))
    if method in ("epoch", "epoch_2s"):
        shaped = design.convolve_epochs(merged, basis, frame_s, run_len_s, resolution_s, method)
    else:
        shaped = design.convolve(events.sampled_onsets(merged, run_len_s, resolution_s, method), basis, frame_s, run_len_s, resolution_s)
    # as many types as the experiment has
    types = merged.select("trial_type").distinct().withColumn("k", F.row_number().over(Window.orderBy("trial_type")) - 1)
    types = cut_lineage(types, "types")
    n_types = types.count()
    stimuli = shaped.join(F.broadcast(types), "trial_type").select(
        RUN, "frame", (F.col("k") * 3 + F.col("basis_idx")).cast("int").alias("reg_idx"), F.concat_ws("_", "trial_type", "basis_idx").alias("regressor"), "value"
    )
    n_drift = design.drift_order(n_frames, frame_s, cutoff_hz)
    drift = design.drift_basis(spark, n_frames, frame_s, cutoff_hz).select(
        "frame", (F.col("k") + 3 * n_types).cast("int").alias("reg_idx"), F.concat(F.lit("drift_"), "k").alias("regressor"), "value"
    )
    runs = event_rows.select(RUN).distinct()
    found = stimuli.unionByName(runs.crossJoin(F.broadcast(drift)).select(RUN, "frame", "reg_idx", "regressor", "value"))
    if confound_rows is not None:
        names = [c for c in confound_rows.columns if c not in (RUN, "frame")]
        at = 3 * n_types + n_drift
        cells = F.explode(F.array(*[F.struct(F.lit(at + i).alias("reg_idx"), F.lit(c).alias("regressor"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(names)]))
        more = confound_rows.select(RUN, "frame", cells.alias("c")).select(RUN, "frame", "c.*") if names else None
        if more is not None:
            found = found.unionByName(more.where("value IS NOT NULL AND NOT isnan(value)"))
    return found.where(F.col("frame") < n_frames)


def _reach(*kernels: DataFrame | None) -> int:
    """How far, in cells, the widest kernel reaches."""
    ends = [k.agg(F.max(F.greatest(F.abs("dx"), F.abs("dy"), F.abs("dz"))).alias("r")).first()["r"] or 0 for k in kernels if k is not None]
    return max(ends, default=0)


def _smoothed(series: DataFrame, kernel: DataFrame, ts: str = "ts") -> DataFrame:
    """Series (run_id, voxel_id, x, y, z, ts) smoothed over the cells that are there."""
    cells = glm.to_cells(series, ts)
    found = volume.smooth(cells, kernel)
    ids = series.select(RUN, "voxel_id", *volume.XYZ)
    return glm.to_series(found, [RUN, *volume.XYZ]).join(ids, [RUN, *volume.XYZ]).select(RUN, "voxel_id", *volume.XYZ, F.col("ts").alias(ts))


def fit_images(
    series: DataFrame, designs: DataFrame, n_frames: int, mask: DataFrame | None = None, threshold: float = 0.0, image_kernel: DataFrame | None = None,
    ar_kernel: DataFrame | None = None, ar_order: int = 4, ar: str | None = None, ar_only: bool = False, ar_sse: bool = False,
    contrasts: glm.Contrasts | None = None,
) -> DataFrame:
    """Models of all runs' images (``series``: run_id, voxel_id, x, y, z, ts) in a mask: run_id, voxel_id and the columns of ``glm.fit``.

    Without a mask (x, y, z) it is the cells above ``threshold`` in every frame of the run. With a kernel
    the image is cut to the box around the mask, widened by the widest kernel's reach, and smoothed there.
    With ``ar_kernel`` autoregressions are estimated in the mask grown by that reach, smoothed, and used in
    the mask. ``ar`` names a column of ``series`` with known parameters, which replace order and smoothing.
    ``ar_only`` stops at the parameters. With ``contrasts`` estimates and t stand in place of the covariance.
    """
    if ar:
        ar_kernel = None
    here = [RUN, *volume.XYZ]
    inside = glm.in_every_frame(series, threshold).select(*here) if mask is None else series.join(mask.select(*volume.XYZ).distinct(), volume.XYZ, "left_semi").select(*here)
    far = _reach(image_kernel, ar_kernel)
    if far:
        inside = cut_lineage(inside, "mask")
        box = volume.mask_range(inside, [RUN])
        near = " AND ".join(f"{c} BETWEEN min_{c} - {far} AND max_{c} + {far}" for c in volume.XYZ)
        series = series.join(box, RUN).where(near).drop(*[c for c in box.columns if c != RUN])
    known = series.select(*here, F.col(ar).alias("ar")) if ar else None
    series = series.select(RUN, "voxel_id", *volume.XYZ, "ts")
    if image_kernel is not None:
        series = cut_lineage(_smoothed(series, image_kernel), "smoothed")
    packed = cut_lineage(glm.packed_designs(designs, n_frames), "designs")
    keys = ("voxel_id", *volume.XYZ)
    if ar_kernel is not None:
        shape = series.agg(*[(F.max(c) + 1).alias(c) for c in volume.XYZ]).first()
        grown = volume.grow(inside, far, tuple(int(v or 0) for v in shape), [RUN])
        first = glm.fit_runs(series.join(grown, here, "left_semi"), packed, ar_order, keys, ar_only=True)
        known = _smoothed(first, ar_kernel, "ar").select(*here, "ar")
    rows = series.join(inside, here, "left_semi")
    if known is not None:
        rows = rows.join(known, here)
        if ar_only:
            return rows.select(RUN, "voxel_id", "ar")
    return glm.fit_runs(rows, packed, ar_order, ar="ar" if known is not None else None, ar_sse=ar_sse, ar_only=ar_only, contrasts=contrasts)


@dataclass(frozen=True)
class Analysis:
    """What ``analyse`` gives. ``fits`` has run_id, voxel_id, beta, ar, sse, dof and the estimates and t of all
    contrasts; ``t`` a row for each fit and contrast. For covariances call ``fit_images``."""

    designs: DataFrame
    contrasts: DataFrame
    fits: DataFrame
    t: DataFrame


def analyse(
    spark: SparkSession, runs: DataFrame, event_rows: DataFrame, n_frames: int, frame_s: float, voxel_mm: tuple[float, float, float] = (2.0, 2.0, 2.0),
    confound_rows: DataFrame | None = None, mask: DataFrame | None = None, threshold: float = 0.0, fwhm_mm: float = 2.0, ar_fwhm_mm: float = 0.0,
    ar_order: int = 4, boost: bool = True, resolution_s: float = 0.01, method: str = "nonlinear",
) -> Analysis:
    """From images, events and confounds of many runs to t maps of each type and each pair of types.

    ``runs`` are the images: run_id, voxel_id, x, y, z, ts; ``event_rows`` as in ``operators.events``; ``confound_rows``
    as ``design.confounds`` returns them. ``frame_s`` and ``voxel_mm`` stand in an image's header. A width
    (full width at half maximum) of 0 is no smoothing. t: run_id, voxel_id, contrast_id, estimate, t.
    """
    kernel = lambda fwhm: design.smoothing_kernel(spark, (fwhm,) * 3, voxel_mm) if fwhm > 0 else None
    designs = cut_lineage(run_designs(spark, event_rows, n_frames, frame_s, confound_rows, resolution_s=resolution_s, method=method), "run-designs")
    contrasts = cut_lineage(design.contrasts(events.merge_adjacent(event_rows)), "contrasts")
    some = glm.Contrasts(contrasts, boost)
    fits = fit_images(runs, designs, n_frames, mask, threshold, kernel(fwhm_mm), kernel(ar_fwhm_mm), ar_order, contrasts=some)
    fits = cut_lineage(fits, "fits")
    ids = F.array(*[F.lit(i) for i in some.ids]).cast(T.ArrayType(some.kind)).alias("ids")
    each = fits.select(RUN, "voxel_id", F.inline(F.arrays_zip(ids, "estimates", "t")).alias("contrast_id", "estimate", "t"))
    t = F.when(F.col("t").isNull() & F.col("estimate").isNotNull(), F.lit(float("nan"))).otherwise(F.col("t"))
    return Analysis(designs, contrasts, fits, each.withColumn("t", t))


def image_runs(spark: SparkSession, path: str, skip_zero: bool = False, in_parts: bool = False) -> DataFrame:
    """Cells of all images under ``path`` with what their names tell: run_id, sub, x, y, z, frame, value.

    run_id is subject, session, task and run, with a line between those that the name has. With ``in_parts``
    many tasks read a file (``image_parts``), which must then lie where ``pyarrow.fs`` reaches it.
    """
    cells = (image_parts.read_image_parts if in_parts else images.read_images)(spark, path, skip_zero)
    named = cells.select(*tables.recording_fields("path"), *volume.XYZ, "frame", "value")
    return named.select(F.concat_ws("_", "sub", "ses", "task", "run").alias(RUN), "sub", *volume.XYZ, "frame", "value")


@dataclass(frozen=True)
class Labelled:
    """Features (run_id, sub, region_idx, frame, value) and labels (run_id, row_idx, letter, region, bit) of runs."""

    features: DataFrame
    labels: DataFrame


def features_and_labels(
    cells: DataFrame, event_rows: DataFrame, roi: DataFrame, calibration: DataFrame, book: DataFrame | None = None
) -> Labelled:
    """Calibrated mean signals of the runs in ``cells`` (rows of ``image_runs``) and the labels of their events.

    ``roi`` and ``calibration`` have sub, region_idx, x, y, z; a run of a subject without regions is an
    error. For a test set give the code book that was learned from the training set's events.
    """
    volume.assert_known_subjects(cells.select("sub").distinct(), roi)
    runs = cells.select(RUN).distinct()
    labels = events.label_events(event_rows.join(runs, RUN, "left_semi"), book)
    return Labelled(volume.region_features(cells, roi, calibration, ["sub"]), labels.select(RUN, "row_idx", "letter", "region", "bit"))
