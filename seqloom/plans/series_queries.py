"""Queries on series: autocorrelation, whitening, models, normalisation, trimming and slicing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import arrays as A
from seqloom.operators import glm, signal
from seqloom.plans.registry import query
from seqloom.plans.views import CELLS_SQL, SERIES_SQL, cells, rounded, series

_LAG = "list_sum(list_transform(range(1, len({x}) - {k} + 1), lambda q: {x}[q] * {x}[q + {k}]))"


def _lag_sql(x: str, k: int) -> str:
    return _LAG.format(x=x, k=k)


@query("residual_autocorr", f"WITH {SERIES_SQL} SELECT voxel_id, " + ", ".join(f"round({_lag_sql('ts', k)}, 6) AS r{k}" for k in range(5)) + " FROM s")
def residual_autocorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = glm.autocorrelation(series(spark, sf_dir), 4)
    return found.select("voxel_id", *[F.round(F.col("xcorr")[k], 6).alias(f"r{k}") for k in range(5)])


_YW_SQL = f"""WITH {SERIES_SQL},
q AS (SELECT voxel_id, ts, {_lag_sql('ts', 0)} AS r0, {_lag_sql('ts', 1)} AS r1, {_lag_sql('ts', 2)} AS r2 FROM s),
a AS (SELECT *, (r1 * r2 - r0 * r1) / (r0 * r0 - r1 * r1) AS a1, (r1 * r1 - r0 * r2) / (r0 * r0 - r1 * r1) AS a2 FROM q)"""


def _ar2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glm.autocorrelation(series(spark, sf_dir), 2).withColumn("ar", glm.yule_walker_2("xcorr"))


@query("ar2_yule_walker", _YW_SQL + " SELECT voxel_id, round(a1, 6) AS a1, round(a2, 6) AS a2 FROM a")
def ar2_yule_walker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ar2(spark, sf_dir).select("voxel_id", F.col("ar")[0].alias("a1"), F.col("ar")[1].alias("a2")), "a1", "a2")


@query("ar2_by_solver", _YW_SQL + " SELECT voxel_id, round(a1, 6) AS a1, round(a2, 6) AS a2 FROM a")
def ar2_by_solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = glm.yule_walker(glm.autocorrelation(series(spark, sf_dir), 2))
    return rounded(found.select("voxel_id", F.col("ar")[0].alias("a1"), F.col("ar")[1].alias("a2")), "a1", "a2")


@query("ar_sse", _YW_SQL + " SELECT voxel_id, round(r0 + a1 * r1 + a2 * r2, 6) AS sse FROM a")
def ar_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ar2(spark, sf_dir).select("voxel_id", glm.sse_from_autocorrelation("xcorr", "ar").alias("sse")), "sse")


@query("prewhiten_fir", _YW_SQL + """ SELECT voxel_id, unnest(range(len(ts)))::INT AS frame,
  round(unnest(list_transform(range(1, len(ts) + 1), lambda q: ts[q] + a1 * coalesce(ts[q + 1], 0) + a2 * coalesce(ts[q + 2], 0))), 6) AS value FROM a""")
def prewhiten_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = _ar2(spark, sf_dir).select("voxel_id", A.ahead_filter("ts", "ar").alias("ts"))
    return rounded(glm.to_cells(white), "value")


def _line_design() -> np.ndarray:
    return np.stack([np.ones(64), np.arange(64.0)], axis=1)


@query("ols_two_regressors", f"""WITH {CELLS_SQL}
SELECT voxel_id, round(regr_intercept(value, frame), 6) AS b0, round(regr_slope(value, frame), 8) AS b1,
  round(regr_syy(value, frame) - regr_slope(value, frame) * regr_sxy(value, frame), 6) AS sse, 62 AS dof FROM c GROUP BY voxel_id""")
def ols_two_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = glm.fit(series(spark, sf_dir), _line_design())
    return fits.select("voxel_id", F.round(F.col("beta")[0], 6).alias("b0"), F.round(F.col("beta")[1], 8).alias("b1"), F.round("sse", 6).alias("sse"), "dof")


@query("t_map_simple", f"""WITH {CELLS_SQL},
g AS (SELECT voxel_id, regr_intercept(value, frame) AS b0, regr_slope(value, frame) AS b1, regr_sxx(value, frame) AS sxx, avg(frame) AS m,
  (regr_syy(value, frame) - regr_slope(value, frame) * regr_sxy(value, frame)) / 62 AS v FROM c GROUP BY voxel_id)
SELECT voxel_id, 0::BIGINT AS contrast_id, round(b1, 8) AS estimate, round(b1 / sqrt(v / sxx), 6) AS t FROM g
UNION ALL SELECT voxel_id, 1, round(b0, 8), round(b0 / sqrt(v * (1 / 64::DOUBLE + m * m / sxx)), 6) FROM g""")
def t_map_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrast = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0])], "contrast_id long, weights array<double>")
    found = glm.t_map(glm.fit(series(spark, sf_dir), _line_design()), contrast)
    return rounded(rounded(found, "estimate", digits=8), "t")


@query("boosted_contrast", f"""WITH {CELLS_SQL},
g AS (SELECT voxel_id, regr_intercept(value, frame) AS b0, regr_slope(value, frame) AS b1 FROM c GROUP BY voxel_id)
SELECT voxel_id, round(sign(b0) * sqrt(b0 * b0 + b1 * b1) * 1.5, 6) AS estimate FROM g""")
def boosted_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    contrast = spark.createDataFrame([(0, [0.75, 0.75], [[True, True]])], "contrast_id long, weights array<double>, boost_masks array<array<boolean>>")
    found = glm.t_map(glm.fit(series(spark, sf_dir), _line_design()), contrast, boost=True)
    return rounded(found.select("voxel_id", "estimate"), "estimate")


@query("gls_autoregressive")
def gls_autoregressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised least squares with an autoregression of order 4; held against numpy in the tests."""
    fits = glm.fit(series(spark, sf_dir), _line_design(), ar_order=4)
    return fits.select("voxel_id", F.round(F.col("beta")[0], 6).alias("b0"), F.round(F.col("beta")[1], 8).alias("b1"), F.round("sse", 6).alias("sse"), "dof")


def _gls_1_sql() -> str:
    """Whitened by the residuals' autoregression of order 1, then two equations for each series."""
    ahead = lambda x: f"{x} + a * coalesce(lead({x}) OVER (PARTITION BY voxel_id ORDER BY frame), 0)"
    return f"""WITH {CELLS_SQL},
g AS (SELECT voxel_id, regr_intercept(value, frame) AS b0, regr_slope(value, frame) AS b1 FROM c GROUP BY voxel_id),
e AS (SELECT voxel_id, frame, value, value - b0 - b1 * frame AS e FROM c JOIN g USING (voxel_id)),
l AS (SELECT *, e * lead(e) OVER (PARTITION BY voxel_id ORDER BY frame) AS e1 FROM e),
ar AS (SELECT voxel_id, -sum(e1) / sum(e * e) AS a FROM l GROUP BY voxel_id),
j AS (SELECT e.*, a, 1::DOUBLE AS one, frame::DOUBLE AS t FROM e JOIN ar USING (voxel_id)),
w AS (SELECT voxel_id, {ahead('value')} AS y, {ahead('one')} AS u, {ahead('t')} AS v, {ahead('e')} AS q FROM j),
m AS (SELECT voxel_id, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * y) AS uy, sum(v * y) AS vy, sum(q * q) AS sse FROM w GROUP BY voxel_id)
SELECT voxel_id, round((vv * uy - uv * vy) / (uu * vv - uv * uv), 6) AS b0, round((uu * vy - uv * uy) / (uu * vv - uv * uv), 8) AS b1, round(sse, 6) AS sse, 62 AS dof FROM m"""


@query("gls_order_1", _gls_1_sql())
def gls_order_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = glm.fit(series(spark, sf_dir), _line_design(), ar_order=1)
    return fits.select("voxel_id", F.round(F.col("beta")[0], 6).alias("b0"), F.round(F.col("beta")[1], 8).alias("b1"), F.round("sse", 6).alias("sse"), "dof")


@query("valid_voxels", f"WITH {SERIES_SQL} SELECT voxel_id FROM s WHERE len(list_filter(ts, lambda q: NOT q > -0.25)) = 0 AND NOT list_contains(ts, 0)")
def valid_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glm.in_every_frame(glm.in_every_frame(series(spark, sf_dir)), -0.25).select("voxel_id")


@query("motion_scrub", f"""WITH {CELLS_SQL},
o AS (SELECT voxel_id, frame, value, frame IN (0, 5, 6, 20, 63) AS out FROM c),
n AS (SELECT *, last_value(CASE WHEN NOT out THEN frame END IGNORE NULLS) OVER b AS fa, last_value(CASE WHEN NOT out THEN value END IGNORE NULLS) OVER b AS va,
  first_value(CASE WHEN NOT out THEN frame END IGNORE NULLS) OVER f AS fb, first_value(CASE WHEN NOT out THEN value END IGNORE NULLS) OVER f AS vb FROM o
  WINDOW b AS (PARTITION BY voxel_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY voxel_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT voxel_id, frame, round(CASE WHEN NOT out THEN value ELSE coalesce(va + (vb - va) * (frame - fa) / nullif(fb - fa, 0), va, vb) END, 6) AS value FROM n""")
def motion_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    outliers = spark.createDataFrame([(f,) for f in (0, 5, 6, 20, 63)], "frame int")
    return rounded(glm.interpolate_outliers(cells(spark, sf_dir).select("voxel_id", "frame", "value"), outliers), "value")


@query("relative_change", f"""WITH {SERIES_SQL} SELECT voxel_id, unnest(range(len(ts)))::INT AS frame,
  round(unnest(list_transform(ts, lambda q: CASE WHEN ts[1] <> 0 THEN (q - ts[1]) / ts[1] WHEN q = 0 THEN 'NaN'::DOUBLE WHEN q > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END)), 6) AS value FROM s""")
def relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("voxel_id", A.relative_to_first("ts").alias("ts"))
    return rounded(glm.to_cells(rows), "value")


_STATS_SQL = f"""WITH {CELLS_SQL},
st AS (SELECT sub, frame % 8 AS feature, avg(value) AS mean, stddev_pop(value) AS deviation FROM c GROUP BY ALL)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("voxel_id", "frame", "sub", (F.col("frame") % 8).alias("feature"), "value")


@query("znorm_by_subject", _STATS_SQL + """ SELECT voxel_id, frame, round((value - mean) / deviation, 6) AS value
  FROM c JOIN st ON c.sub = st.sub AND c.frame % 8 = st.feature""")
def znorm_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _features(spark, sf_dir)
    return rounded(signal.SubjectNormalizer().fit(rows).transform(rows).select("voxel_id", "frame", "value"), "value")


@query("znorm_defaults", _STATS_SQL + " SELECT round(avg(mean), 8) AS mean, round(sqrt(sum(deviation * deviation)), 6) AS deviation FROM st")
def znorm_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.defaults_of(signal.subject_statistics(_features(spark, sf_dir)))
    return rounded(rounded(found, "mean", digits=8), "deviation")


@query("trim_frames", f"""WITH {CELLS_SQL}
SELECT voxel_id AS run_id, (frame - 4)::INT AS frame, round(value, 6) AS value FROM c WHERE frame >= 4 AND frame < 60""")
def trim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = cells(spark, sf_dir).select(F.col("voxel_id").alias("run_id"), "frame", "value")
    sizes = runs.groupBy("run_id").agg((F.max("frame") + 1).alias("n_frames")).withColumn("n_labels", F.lit(7))
    return rounded(signal.Trimmer(4, 8).fit(sizes).transform(runs), "value")


@query("slice_windows", f"""WITH {SERIES_SQL}
SELECT voxel_id, i::INT AS event_idx, t::INT AS t, round(ts[1 + 2 + i * 8 + t], 6) AS value
FROM s CROSS JOIN range(6) a(i) CROSS JOIN range(18) b(t) WHERE 2 + i * 8 + t < len(ts)""")
def slice_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signal.Slicer(event_len=8, n_labels=7, delay=2, extra=2).transform(series(spark, sf_dir))
    return rounded(found.select("voxel_id", "event_idx", F.posexplode("window").alias("t", "value")), "value")


def _recursion_sql() -> str:
    (b0, b1, b2, a1, a2), *rest = signal.butterworth(2, None, 0.1, 1.0)
    assert not rest
    return f"""WITH RECURSIVE {SERIES_SQL},
y AS (SELECT voxel_id, 1 AS i, ts, {b0!r} * ts[1] AS v, {b1!r} * ts[1] - {a1!r} * {b0!r} * ts[1] AS p, {b2!r} * ts[1] - {a2!r} * {b0!r} * ts[1] AS q FROM s
  UNION ALL
  SELECT voxel_id, i + 1, ts, {b0!r} * ts[i + 1] + p, {b1!r} * ts[i + 1] - {a1!r} * ({b0!r} * ts[i + 1] + p) + q, {b2!r} * ts[i + 1] - {a2!r} * ({b0!r} * ts[i + 1] + p)
  FROM y WHERE i < len(ts))
SELECT voxel_id, (i - 1)::INT AS frame, round(v, 6) AS value FROM y"""


@query("sos_filter", _recursion_sql())
def sos_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = signal.ButterworthFilter(None, 0.1, 1.0, order=2)
    return rounded(glm.to_cells(low.transform(series(spark, sf_dir)).select("voxel_id", "ts")), "value")


def _response(sections: list[tuple[float, ...]], n: int) -> list[float]:
    """What the sections make of a single 1 in n frames."""
    a, b, c, d = signal.state_space(sections)
    out, state = [d], b
    for _ in range(n - 1):
        out.append(float(c @ state))
        state = a @ state
    return out


_HIGH, _BAND = signal.butterworth(2, 0.1, None, 1.0), signal.butterworth(2, 0.1, 0.3, 1.0)


def _response_sql(sections: list[tuple[float, ...]]) -> str:
    """The filter as a sum over what came before, for 64 frames."""
    h = ", ".join(repr(v) for v in _response(sections, 64))
    return f"""WITH {SERIES_SQL}, h AS (SELECT [{h}] AS h)
SELECT voxel_id, (t - 1)::INT AS frame, round(list_sum(list_transform(range(1, t + 1), lambda q: ts[q] * h[t - q + 1])), 6) AS value
FROM s CROSS JOIN h CROSS JOIN range(1, 65) r(t) WHERE t <= len(ts)"""


@query("high_pass", _response_sql(_HIGH))
def high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = signal.ButterworthFilter(0.1, None, 1.0, order=2).transform(series(spark, sf_dir)).select("voxel_id", "ts")
    return rounded(glm.to_cells(passed), "value")


@query("band_pass", _response_sql(_BAND))
def band_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = signal.ButterworthFilter(0.1, 0.3, 1.0, order=2).transform(series(spark, sf_dir)).select("voxel_id", "ts")
    return rounded(glm.to_cells(passed), "value")


#: After so many frames a response of the band-pass filter is below 1e-15.
_TAPS = 400


@query("filter_long_run", f"""WITH h AS (SELECT unnest([{", ".join(repr(v) for v in _response(_BAND, _TAPS))}]) AS h, unnest(range({_TAPS})) AS lag),
x AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_id) - 1 AS n, event_id, value FROM events)
SELECT a.event_id AS frame, round(sum(b.value * h.h), 6) AS value FROM x a JOIN h ON h.lag <= a.n JOIN x b ON b.n = a.n - h.lag GROUP BY a.event_id""")
def filter_long_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of all events as one run, in blocks that many tasks filter."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(0).alias("run_id"), F.col("event_id").alias("frame"), "value")
    return rounded(signal.filter_long_runs(events, _BAND, block=512).select("frame", "value"), "value")
