"""Mass-univariate linear models with autocorrelated errors.

A series is one row ``voxel_id, ts array<double>``. Rows are independent, so a fit needs no shuffle:
the design (frames x regressors, of one run, so of bounded size) goes to the tasks with the closure,
and numpy works on Arrow batches. What needs no linear solver is a column expression.

For an autoregression a1..ap the banded precision matrix of the errors is L L', with L unit lower
triangular Toeplitz of (1, a1, ..., ap). Whitening is therefore a filter that looks ahead,
w(y)[t] = y[t] + a1 y[t+1] + ...; no frames x frames matrix is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from seqloom.functions import arrays as A

#: Bytes of a design that may be sent to the tasks.
DESIGN_LIMIT = 64 << 20
#: Contrasts that may be sent to the tasks.
CONTRAST_LIMIT = 100_000
FIT_SCHEMA = "beta array<double>, cov array<array<double>>, ar array<double>, sse double, dof int"
CONTRAST_SCHEMA = "beta array<double>, estimates array<double>, t array<double>, ar array<double>, sse double, dof int"


def in_every_frame(df: DataFrame, threshold: float | None = None, ts: str = "ts") -> DataFrame:
    """Rows whose series exceeds ``threshold`` in every frame; without one, rows that are nowhere 0."""
    test = (lambda x: x != 0) if threshold is None else (lambda x: x > threshold)
    return df.where(F.forall(F.col(ts), test))


def to_series(cells: DataFrame, keys: list[str], frame: str = "frame", value: str = "value") -> DataFrame:
    """Long cells as one array for each key, in frame order. A series is bounded by the length of a run."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(frame), F.col(value).cast("double").alias("v"))))
    return cells.groupBy(*keys).agg(F.transform(pairs, lambda p: p["v"]).alias("ts"))


def to_cells(series: DataFrame, ts: str = "ts", frame: str = "frame", value: str = "value") -> DataFrame:
    return series.select(*[c for c in series.columns if c != ts], F.posexplode(ts).alias(frame, value))


def autocorrelation(df: DataFrame, order: int, ts: str = "ts", out: str = "xcorr") -> DataFrame:
    """Lagged products at lags 0 to ``order``, not normalised."""
    return df.withColumn(out, F.array(*[A.lagged_product(ts, k) for k in range(order + 1)]))


def yule_walker_2(xcorr: Column | str) -> Column:
    """Parameters of an autoregression of order 1 or 2 in closed form; null where it has no solution."""
    r = A.col(xcorr)
    r0, r1, r2 = r[0], r[1], F.get(r, F.lit(2))
    d = r0 * r0 - r1 * r1
    two = F.array(F.try_divide(r1 * r2 - r0 * r1, d), F.try_divide(r1 * r1 - r0 * r2, d))
    return F.when(F.size(r) == 2, F.array(F.try_divide(-r1, r0))).otherwise(two)


def sse_from_autocorrelation(xcorr: Column | str, ar: Column | str) -> Column:
    """r0 + sum a_i r_i."""
    r = A.col(xcorr)
    return r[0] + A.dot(F.slice(r, 2, F.size(A.col(ar))), ar)


def _solve_yule_walker(xcorr: np.ndarray) -> np.ndarray:
    """Row-wise Toeplitz systems; rows with a lag of exactly 0 get zeros."""
    p = xcorr.shape[1] - 1
    out = np.zeros((len(xcorr), p))
    good = (xcorr != 0).all(axis=1) & np.isfinite(xcorr).all(axis=1)
    if p and good.any():
        lag = np.abs(np.subtract.outer(np.arange(p), np.arange(p)))
        r = xcorr[good]
        out[good] = -(np.linalg.pinv(r[:, lag]) @ r[:, 1:, None])[:, :, 0]
    return out


def yule_walker(df: DataFrame, xcorr: str = "xcorr", out: str = "ar") -> DataFrame:
    """Parameters of any order from lagged products, as a column."""

    @F.pandas_udf("array<double>")
    def solve(rows: pd.Series) -> pd.Series:
        return pd.Series(list(_solve_yule_walker(np.stack(rows.to_list()))) if len(rows) else [])

    return df.withColumn(out, solve(xcorr))


def smooth_parameters(ar: DataFrame, kernel: DataFrame, key: str = "voxel_id") -> DataFrame:
    """Autoregression parameters smoothed over neighbours in the volume: rows (x, y, z, key, ar)."""
    from seqloom.operators.volume import smooth

    long = ar.select("x", "y", "z", key, F.posexplode("ar").alias("frame", "value"))
    return to_series(smooth(long, kernel, keep=[key]), [key]).withColumnRenamed("ts", "ar")


def _look_ahead(values: np.ndarray, ar: np.ndarray) -> np.ndarray:
    """The whitening filter on values[row, frame, ...] with the parameters of each row."""
    out = values.copy()
    tail = (1,) * (values.ndim - 2)
    for k in range(min(ar.shape[1], values.shape[1] - 1)):
        out[:, : -(k + 1)] += ar[:, k].reshape(-1, 1, *tail) * values[:, k + 1 :]
    return out


def design_matrix(design: DataFrame, n_frames: int) -> tuple[np.ndarray, list[str]]:
    """The long design (frame, regressor, value) of one run as a matrix, columns by name.

    A design is as large as a run, whatever the number of series; above ``DESIGN_LIMIT`` it is refused.
    """
    names = [r[0] for r in design.select("regressor").distinct().orderBy("regressor").toLocalIterator()]
    if 8 * n_frames * len(names) > DESIGN_LIMIT:
        raise ValueError(f"a design of {n_frames} frames and {len(names)} regressors is too large to send to every task")
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((n_frames, len(names)))
    for row in design.select("frame", "regressor", "value").toLocalIterator():
        x[row[0], at[row[1]]] = row[2]
    return x, names


def fit(
    series: DataFrame, design: np.ndarray, ar_order: int = 0, key: str = "voxel_id", ts: str = "ts", ar: str | None = None,
    ar_sse: bool = False, block: int = 256,
) -> DataFrame:
    """Least squares, then generalised least squares with an autoregression of the residuals.

    One row for each series: key, beta, cov (the inverse of the whitened X'X), ar, sse, dof. Order 0 is
    ordinary least squares. ``ar`` names a column with parameters that are already known (smoothed ones,
    say). The sum of squares is of the whitened first residual, or r0 + sum a_i r_i with ``ar_sse``.
    dof is frames minus the rank of the design. Series that are null, of another length or with NaN give
    null estimates and a null sum of squares.
    """
    solver = _Solver(np.ascontiguousarray(design, dtype=float), ar_order, ar_sse)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), block):
                some = batch.iloc[lo : lo + block]
                yield pd.DataFrame({key: some["key"].to_numpy(), **solver.estimates(some["ts"], some["ar"] if ar else None)})

    rows = series.select(F.col(key).alias("key"), F.col(ts).alias("ts"), *([F.col(ar).alias("ar")] if ar else []))
    return rows.mapInPandas(run, f"{key} {series.schema[key].dataType.simpleString()}, {FIT_SCHEMA}")


class _Solver:
    """Estimates of series under one design."""

    def __init__(self, x: np.ndarray, ar_order: int, ar_sse: bool):
        if ar_order < 0:
            raise ValueError("the order can't be negative")
        self.x, self.order, self.ar_sse = x, ar_order, ar_sse
        self.first, self.dof = np.linalg.pinv(x), len(x) - int(np.linalg.matrix_rank(x))
        self.plain_cov = np.linalg.pinv(x.T @ x)

    def estimates(self, ts: pd.Series, known_ar: pd.Series | None, contrasts: Contrasts | None = None) -> dict:
        x, (n, r) = self.x, self.x.shape
        y = np.stack([np.asarray(v, dtype=float) if v is not None and len(v) == n else np.full(n, np.nan) for v in ts])
        beta = y @ self.first.T
        e = y - beta @ x.T
        lags = np.stack([(e[:, : n - k] * e[:, k:]).sum(axis=1) for k in range(self.order + 1)], axis=1)
        a = _solve_yule_walker(lags) if known_ar is None else np.stack([np.asarray(v, dtype=float) for v in known_ar])
        cov = np.broadcast_to(self.plain_cov, (len(y), r, r))
        if a.shape[1]:
            xw = _look_ahead(np.broadcast_to(x, (len(y), n, r)), a)
            cov = np.linalg.pinv(xw.transpose(0, 2, 1) @ xw)
            beta = (cov @ (xw.transpose(0, 2, 1) @ _look_ahead(y, a)[:, :, None]))[:, :, 0]
        if self.ar_sse:
            more = [(e[:, : n - k] * e[:, k:]).sum(axis=1) for k in range(1, a.shape[1] + 1)]
            sse = lags[:, 0] + sum(a[:, k] * v for k, v in enumerate(more))
        else:
            sse = (_look_ahead(e, a) ** 2).sum(axis=1)
        found = {"beta": list(beta), "ar": list(a), "sse": sse, "dof": self.dof}
        if contrasts is None:
            return found | {"cov": [[list(q) for q in c] for c in cov]}
        estimates, t = contrasts.values(beta, cov, sse, self.dof)
        return found | {"estimates": list(estimates), "t": list(t)}

    def parameters(self, ts: pd.Series) -> list:
        """Only the autoregression of the residuals."""
        n = len(self.x)
        y = np.stack([np.asarray(v, dtype=float) if v is not None and len(v) == n else np.full(n, np.nan) for v in ts])
        e = y - y @ self.first.T @ self.x.T
        return list(_solve_yule_walker(np.stack([(e[:, : n - k] * e[:, k:]).sum(axis=1) for k in range(self.order + 1)], axis=1)))


def packed_designs(design: DataFrame, n_frames: int, run: str = "run_id") -> DataFrame:
    """The long designs of many runs (run, frame, reg_idx, value) as one row for each run: run, n_frames, width,
    places (frame * width + reg_idx) and x, the values there; elsewhere the matrix is 0. Every run has the
    columns that any run has."""
    width = design.agg((F.max("reg_idx") + 1).cast("int").alias("w")).first()["w"] or 0
    if 8 * n_frames * width > DESIGN_LIMIT:
        raise ValueError(f"a design of {n_frames} frames and {width} regressors is too large for a task")
    place = (F.col("frame") * width + F.col("reg_idx")).cast("int")
    cells = design.where(F.col("value") != 0).select(run, place.alias("at"), F.col("value").cast("double").alias("value"))
    # as large as a run, whatever the number of series
    rows = cells.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("m"))
    return rows.select(run, F.lit(n_frames).alias("n_frames"), F.lit(width).alias("width"), F.col("m.at").alias("places"), F.col("m.value").alias("x"))


class Contrasts:
    """A small table of contrasts (contrast_id, weights and, for ``boost``, boost_masks) for evaluation in tasks."""

    def __init__(self, table: DataFrame, boost: bool):
        rows = table.select("contrast_id", "weights", *(["boost_masks"] if boost else [])).limit(CONTRAST_LIMIT + 1).collect()
        if len(rows) > CONTRAST_LIMIT:
            raise ValueError(f"there are more than {CONTRAST_LIMIT} contrasts")
        rows.sort(key=lambda r: r[0])
        self.ids, self.kind = [r[0] for r in rows], table.schema["contrast_id"].dataType
        self.weights = [np.array(r[1], dtype=float) for r in rows]
        self.masks = [[np.array(m, dtype=bool) for m in r[2]] for r in rows] if boost else None

    def values(self, beta: np.ndarray, cov: np.ndarray, sse: np.ndarray, dof: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Estimates and t of rows of beta (series x regressors) and cov; weights are padded with zeros."""
        n, r = beta.shape
        w = np.zeros((len(self.ids), r))
        for k, c in enumerate(self.weights):
            w[k, : len(c)] = c[:r]
        estimates = beta @ w.T if self.masks is None else np.zeros((n, len(w)))
        for k, masks in enumerate(self.masks or []):
            for mask in masks:
                inside = np.flatnonzero(mask[:r])
                strength = np.sqrt((beta[:, inside] ** 2).sum(axis=1))
                estimates[:, k] += np.sign(beta[:, inside[0]]) * strength * w[k, inside].sum() if len(inside) else np.nan
        estimates[:, [k for k, c in enumerate(self.weights) if len(c) > r]] = np.nan  # there is no such regressor
        factor = ((w @ cov) * w).sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            return estimates, estimates / np.sqrt((sse / dof)[:, None] * factor)


def fit_runs(
    series: DataFrame, designs: DataFrame, ar_order: int = 4, keys: tuple[str, ...] = ("voxel_id",), run: str = "run_id", ts: str = "ts",
    ar: str | None = None, ar_sse: bool = False, ar_only: bool = False, per_block: int = 4096, batch_rows: int = 256,
    contrasts: Contrasts | None = None,
) -> DataFrame:
    """As ``fit`` for series of many runs, each with its own design (a row of ``packed_designs``).

    A run's series are dealt into blocks of about ``per_block``, to each of which the design goes once,
    so a run may have any number of series. Returns run, keys and the columns of ``fit``; with ``ar_only``
    run, keys and ar, without whitening. With ``contrasts`` the covariance stays in the task: in its place
    there are estimates and t, one of each for each contrast. Series of runs without a design have no row.
    """
    held = [F.col(c) for c in keys]
    counts = series.groupBy(run).agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("__blocks"))
    rows = series.join(counts, run).select(
        run, F.pmod(F.xxhash64(*held), F.col("__blocks")).cast("int").alias("__block"), F.lit(1).alias("__kind"), *held,
        F.col(ts).alias("ts"), (F.col(ar) if ar else F.lit(None)).cast("array<double>").alias("ar"), F.lit(None).cast("array<int>").alias("places"),
        F.lit(None).cast("int").alias("n_frames"), F.lit(None).cast("int").alias("width"),
    )
    empty = [F.lit(None).cast(series.schema[c].dataType).alias(c) for c in keys]
    sent = designs.join(counts, run).select(
        run, F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"), F.lit(0).alias("__kind"), *empty,
        F.col("x").alias("ts"), F.lit(None).cast("array<double>").alias("ar"), "places", "n_frames", "width",
    )
    n = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.unionByName(sent).repartition(n, run, "__block").sortWithinPartitions(run, "__block", "__kind")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solver, of = None, None
        for batch in batches:
            where = list(zip(batch[run], batch["__block"], strict=True))
            lo = 0
            while lo < len(batch):
                if batch["__kind"].iloc[lo] == 0:
                    if of is None or of[0] != where[lo][0]:
                        shape = int(batch["n_frames"].iloc[lo]), int(batch["width"].iloc[lo])
                        x = np.zeros(shape[0] * shape[1])
                        x[np.asarray(batch["places"].iloc[lo], dtype=int)] = batch["ts"].iloc[lo]
                        solver = _Solver(x.reshape(shape), ar_order, ar_sse)
                    of = where[lo]
                    lo += 1
                    continue
                hi = lo
                while hi < min(len(batch), lo + batch_rows) and where[hi] == where[lo] and batch["__kind"].iloc[hi]:
                    hi += 1
                some = batch.iloc[lo:hi]
                if of == where[lo]:
                    found = {"ar": solver.parameters(some["ts"])} if ar_only else solver.estimates(some["ts"], some["ar"] if ar else None, contrasts)
                    yield pd.DataFrame({c: some[c].to_numpy() for c in (run, *keys)} | found)
                lo = hi

    kinds = ", ".join(f"{c} {series.schema[c].dataType.simpleString()}" for c in (run, *keys))
    found = "ar array<double>" if ar_only else FIT_SCHEMA if contrasts is None else CONTRAST_SCHEMA
    return both.mapInPandas(solve, f"{kinds}, {found}")


def boosted(beta: Column | str, weights: Column | str, boost_masks: Column | str) -> Column:
    """A contrast's estimate with the strength of derivatives: for each mask the sign of its first
    estimate, times the root of the sum of squares, times the sum of its weights; summed over masks."""
    b, c = A.col(beta), A.col(weights)

    def of(mask: Column) -> Column:
        inside = lambda v: F.zip_with(F.slice(v, 1, F.size(mask)), mask, lambda x, m: F.when(m, x))
        relevant = F.filter(inside(b), lambda x: x.isNotNull())
        total = A.total(F.filter(inside(c), lambda x: x.isNotNull()))
        return F.signum(F.get(relevant, F.lit(0))) * F.sqrt(A.total(F.transform(relevant, lambda x: x * x))) * total

    return A.total(F.transform(A.col(boost_masks), of))


def t_value(estimate: Column | str, error_variance: Column | str, factor: Column | str) -> Column:
    """estimate / sqrt(variance * factor), as IEEE gives it for a root of 0."""
    root = F.sqrt(A.col(error_variance) * A.col(factor))
    e = A.col(estimate)
    odd = F.when(e == 0, F.lit(float("nan"))).when(e > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(root == 0, odd).otherwise(e / F.nullif(root, F.lit(0.0)))


def t_map(fits: DataFrame, contrast: DataFrame, boost: bool = False, key: str | list[str] = "voxel_id") -> DataFrame:
    """key (or keys), contrast_id, estimate, t for every fit and contrast (a small table: contrast_id, weights
    and, with ``boost``, boost_masks). Weights are padded with zeros; the error variance is sse / dof.

    With ``boost`` an estimate has the strength of derivatives: for each mask the sign of its first
    estimate, times the root of the sum of squares, times the sum of its weights; summed over masks. All
    contrasts of a fit are evaluated where the fit is, so its covariance is sent nowhere. t is
    estimate / sqrt(variance * factor) as IEEE gives it for a root of 0; a fit that is null gives nulls.
    """
    keys = [key] if isinstance(key, str) else key
    some = Contrasts(contrast, boost)
    rows = fits.select(*keys, "beta", "cov", "sse", "dof")
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("contrast_id", some.kind), T.StructField("estimate", T.DoubleType()), T.StructField("t", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(len(keys)).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for r in np.unique(size).tolist():
                at = np.flatnonzero(size == r)
                for lo in range(0, len(at), 1024):
                    part = batch.take(pa.array(at[lo : lo + 1024]))
                    n, m = part.num_rows, len(some.ids)
                    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
                    sse, dof = (part.column(len(keys) + k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
                    if r > 0 and part.column(len(keys) + 1).null_count == 0:
                        cov = flat(part.column(len(keys) + 1).flatten()).reshape(n, r, r)
                        estimate, t = some.values(flat(part.column(len(keys))).reshape(n, r), cov, sse, dof)
                    else:
                        estimate = t = np.full((n, m), np.nan)
                    estimate, t, gone = estimate.ravel(), t.ravel(), np.isnan(estimate).ravel()
                    held = part.take(pa.array(np.repeat(np.arange(n), m)))
                    columns = [held.column(k) for k in range(len(keys))] + [pa.array(some.ids * n, to_arrow_type(some.kind)), pa.array(estimate, mask=gone), pa.array(t, mask=gone)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def interpolate_outliers(cells: DataFrame, outliers: DataFrame, key: str = "voxel_id", run: str | None = None) -> DataFrame:
    """Values at outlier frames from a line between the nearest other frames, the nearest one at the ends.

    ``cells`` has key, frame, value; ``outliers`` has frame and, if ``run`` is given, that column.
    """
    on = ["frame", *([run] if run else [])]
    marked = cells.join(outliers.select(*on).distinct().withColumn("__out", F.lit(True)), on, "left")
    good = F.when(F.col("__out").isNull(), F.struct("frame", "value"))
    keys = [key, *([run] if run else [])]
    back = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("frame").rowsBetween(0, Window.unboundedFollowing)
    near = marked.withColumn("__a", F.last(good, ignorenulls=True).over(back)).withColumn("__b", F.first(good, ignorenulls=True).over(ahead))
    a, b = F.col("__a"), F.col("__b")
    line = a["value"] + (b["value"] - a["value"]) * (F.col("frame") - a["frame"]) / F.nullif(b["frame"] - a["frame"], F.lit(0))
    value = F.when(F.col("__out").isNull(), F.col("value")).otherwise(F.coalesce(line, a["value"], b["value"]))
    return near.select(*keys, "frame", value.alias("value"))


def precision_factor(ar: np.ndarray, n: int) -> np.ndarray:
    """L, the unit lower triangular Toeplitz matrix of (1, a1, ..., ap); L L' is the precision matrix.

    Of the size of one short series; the operators above never make it.
    """
    out = np.eye(n)
    for k, a in enumerate(ar, 1):
        out += a * np.eye(n, k=-k)
    return out


def symmetric_root(matrices: DataFrame, column: str = "precision", out: str = "root") -> DataFrame:
    """The symmetric square root of each row's positive semidefinite matrix."""

    @F.pandas_udf("array<array<double>>")
    def root(rows: pd.Series) -> pd.Series:
        def one(m):
            w, v = np.linalg.eigh(np.array([list(r) for r in m], dtype=float))
            return [list(r) for r in (v * np.sqrt(np.maximum(w, 0))) @ v.T]

        return rows.map(one)

    return matrices.withColumn(out, root(column))
