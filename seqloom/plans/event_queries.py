"""Queries on events: merging, letters, sampled onsets, response functions and designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import scalar
from seqloom.operators import design, events
from seqloom.plans.registry import query
from seqloom.plans.views import EVENTS_SQL, MERGED_SQL, RUN_LEN_S, event_rows, rounded, table


@query("events_merge_adjacent", f"WITH {MERGED_SQL} SELECT run_id, trial_type, event_idx, onset_s, round(duration_s, 6) AS duration_s FROM m")
def events_merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.merge_adjacent(event_rows(spark, sf_dir)), "duration_s")


@query("events_distinct_onset", f"""WITH {EVENTS_SQL},
d AS (SELECT *, lag(onset) OVER w IS DISTINCT FROM onset OR row_number() OVER w = 1 AS fresh FROM e WINDOW w AS (PARTITION BY run_id ORDER BY row_idx))
SELECT run_id, row_idx, onset, CASE letter WHEN '_' THEN ' ' ELSE letter END AS letter FROM d WHERE fresh""")
def events_distinct_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.distinct_onsets(event_rows(spark, sf_dir)).select("run_id", "row_idx", "onset", "letter")


@query("letter_pairs", f"""WITH {EVENTS_SQL},
p AS (SELECT run_id, row_idx, letter || lead(letter) OVER (PARTITION BY run_id ORDER BY row_idx) AS pair FROM e)
SELECT * FROM p WHERE pair IS NOT NULL""")
def letter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.letter_transitions(event_rows(spark, sf_dir))


_BOOK_SQL = f"""WITH {EVENTS_SQL},
h AS (SELECT letter, min({{'run_id': run_id, 'onset': onset}}) AS k FROM e GROUP BY letter),
a AS (SELECT DISTINCT e.letter, e.trial_type AS region FROM e JOIN h ON e.letter = h.letter AND e.run_id = h.k.run_id AND e.onset = h.k.onset),
bk AS (SELECT l.letter, r.region, CASE WHEN a.letter IS NULL THEN 0 ELSE 1 END AS bit
       FROM (SELECT DISTINCT letter FROM e) l CROSS JOIN (SELECT DISTINCT trial_type AS region FROM e) r
       LEFT JOIN a ON a.letter = l.letter AND a.region = r.region)"""


@query("code_book", _BOOK_SQL + " SELECT letter, region, bit FROM bk")
def code_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.code_book(event_rows(spark, sf_dir))


@query("label_events", _BOOK_SQL + """,
d AS (SELECT *, lag(onset) OVER w IS DISTINCT FROM onset OR row_number() OVER w = 1 AS fresh FROM e WINDOW w AS (PARTITION BY run_id ORDER BY row_idx))
SELECT run_id, row_idx, d.letter, region, bit FROM d JOIN bk ON d.letter = bk.letter WHERE fresh""")
def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.label_events(event_rows(spark, sf_dir)).select("run_id", "row_idx", "letter", "region", "bit")


def _sampled(stop: str, value: str, step: int = 1) -> str:
    return f"""WITH {MERGED_SQL},
o AS (SELECT *, floor(onset_s)::BIGINT AS a, floor({stop})::BIGINT AS z FROM m),
u AS (SELECT run_id, trial_type, event_idx, {value} AS value, unnest(range(a, z, {step})) AS sample FROM o WHERE z > a)
SELECT run_id, trial_type, sample, round(arg_max(value, event_idx), 6) AS value FROM u WHERE sample < {int(RUN_LEN_S)} GROUP BY ALL"""


def _onsets(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    merged = events.merge_adjacent(event_rows(spark, sf_dir))
    return rounded(events.sampled_onsets(merged, RUN_LEN_S, 1.0, method), "value")


@query("onset_variable_epoch", _sampled("onset_s + duration_s", "1::DOUBLE / (z - a)"))
def onset_variable_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _onsets(spark, sf_dir, "epoch")


@query("onset_constant_epoch", _sampled("onset_s + 2", "1::DOUBLE / (z - a)"))
def onset_constant_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _onsets(spark, sf_dir, "epoch_2s")


@query("onset_impulse", _sampled("onset_s + duration_s", "1::DOUBLE", 4))
def onset_impulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _onsets(spark, sf_dir, "impulse")


@query("onset_nonlinear", f"""WITH {MERGED_SQL},
j AS (SELECT run_id, trial_type, event_idx, floor(onset_s)::BIGINT AS t0, unnest(range(greatest(1, round(duration_s)::BIGINT))) AS second FROM m),
i AS (SELECT run_id, trial_type, t0 + second AS t, arg_max((second = 0)::INT, event_idx) AS first FROM j GROUP BY ALL),
v AS (SELECT a.run_id, a.trial_type, a.t, coalesce(sum((1 - 0.6658) * exp(-0.7 * (a.t + a.first - b.t - 1))), 0) AS past
      FROM i a LEFT JOIN i b ON a.run_id = b.run_id AND a.trial_type = b.trial_type AND b.t < a.t GROUP BY ALL)
SELECT run_id, trial_type, t AS sample, round(greatest(0, 1 - past), 6) AS value FROM v WHERE t < {int(RUN_LEN_S)}""")
def onset_nonlinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _onsets(spark, sf_dir, "nonlinear")


def _gamma_sql(t: str, shape: float, scale: float) -> str:
    return f"CASE WHEN {t} > 0 THEN exp(({shape} - 1) * ln({t}) - {t} / {scale} - lgamma({shape}) - {shape} * ln({scale})) ELSE 0 END"


def _hrf_sql(t: str, res: float, dispersion: float = 1.0) -> str:
    peak, under = _gamma_sql(t, 6 / dispersion, dispersion / res), _gamma_sql(t, 16.0, 1.0 / res)
    return f"({peak} - ({under}) / 6)"


def _basis_sql(res: float) -> str:
    n = int(32 / res)
    return f"""hb AS (SELECT i AS sample, i * {res} AS seconds, {_hrf_sql('i::DOUBLE', res)} AS hrf,
  {_hrf_sql('i::DOUBLE', res)} - {_hrf_sql(f'(i - {1 / res}::DOUBLE)', res)} AS d_hrf,
  ({_hrf_sql('i::DOUBLE', res)} - {_hrf_sql('i::DOUBLE', res, 1.01)}) / 0.01 AS dd_hrf FROM range({n}) q(i))"""


@query("hrf_basis", f"WITH {_basis_sql(0.1)} SELECT sample, round(seconds, 6) AS seconds, round(hrf, 8) AS hrf, round(d_hrf, 8) AS d_hrf, round(dd_hrf, 6) AS dd_hrf FROM hb")
def hrf_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(design.response_basis(spark, 0.1), "hrf", "d_hrf", digits=8), "seconds", "dd_hrf")


@query("dct_basis", """WITH g AS (SELECT f AS frame, k::INT AS k FROM range(360) a(f) CROSS JOIN range(11) b(k))
SELECT frame, k, round(CASE k WHEN 0 THEN 1 ELSE cos(pi() / 360 * (frame + 0.5) * k) END, 6) AS value FROM g""")
def dct_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(design.drift_basis(spark, 360, 2.0), "value")


_SCALED_SQL = _basis_sql(1.0) + """,
sb AS (SELECT sample, unnest([0, 1, 2])::INT AS basis_idx, unnest([hrf, d_hrf, dd_hrf]) / (SELECT max(hrf) FROM hb) AS weight FROM hb)"""


@query("design_convolved", _sampled("onset_s + duration_s", "1::DOUBLE / (z - a)").replace("WITH", f"WITH {_SCALED_SQL},", 1).replace(
    "SELECT run_id, trial_type, sample, round(arg_max(value, event_idx), 6) AS value FROM u",
    ", os AS (SELECT run_id, trial_type, sample, arg_max(value, event_idx) AS value FROM u", 1) + f""")
SELECT run_id, trial_type, f.frame, basis_idx, round(sum(os.value * weight), 6) AS value
FROM os JOIN (SELECT unnest(range({int(RUN_LEN_S)} // 2)) AS frame) f ON f.frame * 2 >= os.sample AND f.frame * 2 < os.sample + 32
JOIN sb ON sb.sample = f.frame * 2 - os.sample GROUP BY ALL""")
def design_convolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    basis = design.scaled_basis(design.response_basis(spark, 1.0))
    return rounded(design.convolve_epochs(events.merge_adjacent(event_rows(spark, sf_dir)), basis, 2.0, RUN_LEN_S, 1.0), "value")


@query("impulse_convolved", _sampled("onset_s + duration_s", "1::DOUBLE", 4).replace("WITH", f"WITH {_SCALED_SQL},", 1).replace(
    "SELECT run_id, trial_type, sample, round(arg_max(value, event_idx), 6) AS value FROM u",
    ", os AS (SELECT run_id, trial_type, sample, arg_max(value, event_idx) AS value FROM u", 1) + f""")
SELECT run_id, trial_type, f.frame, basis_idx, round(sum(os.value * weight), 6) AS value
FROM os JOIN (SELECT unnest(range({int(RUN_LEN_S)} // 2)) AS frame) f ON f.frame * 2 >= os.sample AND f.frame * 2 < os.sample + 32
JOIN sb ON sb.sample = f.frame * 2 - os.sample GROUP BY ALL""")
def impulse_convolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impulses every four seconds of an event, by way of their samples."""
    onsets = events.sampled_onsets(events.merge_adjacent(event_rows(spark, sf_dir)), RUN_LEN_S, 1.0, "impulse")
    basis = design.scaled_basis(design.response_basis(spark, 1.0))
    return rounded(design.convolve(onsets, basis, 2.0, RUN_LEN_S, 1.0), "value")


@query("stimulus_design", f"""WITH {EVENTS_SQL}, {_SCALED_SQL},
os AS (SELECT DISTINCT run_id, trial_type, ceil(onset)::BIGINT AS sample FROM e),
shaped AS (SELECT run_id, f.frame, trial_type || '_' || basis_idx AS regressor, sum(weight) AS value
  FROM os JOIN (SELECT unnest(range(360)) AS frame) f ON f.frame * 2 >= os.sample AND f.frame * 2 < os.sample + 32
  JOIN sb ON sb.sample = f.frame * 2 - os.sample GROUP BY ALL),
drift AS (SELECT f AS frame, k, CASE k WHEN 0 THEN 1 ELSE cos(pi() / 360 * (f + 0.5) * k) END AS value FROM range(360) a(f) CROSS JOIN range(11) b(k))
SELECT run_id, frame, regressor, round(value, 6) AS value FROM shaped
UNION ALL SELECT run_id, frame, 'drift_' || k, round(value, 6) FROM (SELECT DISTINCT run_id FROM e) CROSS JOIN drift""")
def stimulus_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    stimuli = event_rows(spark, sf_dir).withColumnRenamed("onset", "onset_s")
    return design.stimulus_design(spark, stimuli, 360, 0.5, resolution_s=1.0, digits=6)


@query("contrasts", f"""WITH {EVENTS_SQL},
t AS (SELECT trial_type, (row_number() OVER (ORDER BY trial_type) - 1)::INT AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trial_type FROM e)),
a AS (SELECT 0 AS kind, k AS i, -1 AS j, trial_type AS name, list_transform(range(3 * n), lambda q: CASE WHEN q // 3 = k THEN 1 / 3::DOUBLE ELSE 0 END) AS w FROM t
  UNION ALL
  SELECT 1, a.k, b.k, a.trial_type || ' - ' || b.trial_type,
    list_transform(range(3 * a.n), lambda q: CASE WHEN q // 3 = a.k THEN 1 / 3::DOUBLE WHEN q // 3 = b.k THEN -1 / 3::DOUBLE ELSE 0 END)
  FROM t a JOIN t b ON a.k < b.k)
SELECT row_number() OVER (ORDER BY kind, i, j) - 1 AS contrast_id, name, unnest(range(len(w))) AS regressor, round(unnest(w), 6) AS weight FROM a""")
def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = design.contrasts(event_rows(spark, sf_dir))
    long = found.select(F.col("contrast_id").cast("long").alias("contrast_id"), "name", F.posexplode("weights").alias("regressor", "weight"))
    return rounded(long.withColumn("regressor", F.col("regressor").cast("long")), "weight")


#: Lines of an order as frames of a run, under names of confounds; every eighth tax is missing.
_LINES_SQL = """ln AS (SELECT l_orderkey AS run_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1)::BIGINT AS frame,
  l_quantity AS trans_x, l_extendedprice AS csf, l_tax AS csf_derivative1, l_discount * l_quantity AS trans_x_derivative1, l_discount > 0.085 AS out FROM lineitem)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("l_quantity").alias("trans_x"),
        F.col("l_extendedprice").alias("csf"), F.col("l_tax").alias("csf_derivative1"), (F.col("l_discount") * F.col("l_quantity")).alias("trans_x_derivative1"),
        (F.col("l_discount") > 0.085).cast("int").alias("motion_outlier00"),
    )


@query("confounds_scaled", f"""WITH {_LINES_SQL},
d AS (SELECT run_id, frame, trans_x, csf / max(csf) OVER (PARTITION BY run_id) AS csf,
  CASE frame WHEN 0 THEN lead(csf_derivative1) OVER w ELSE csf_derivative1 END AS c1, CASE frame WHEN 0 THEN lead(trans_x_derivative1) OVER w ELSE trans_x_derivative1 END AS t1, out
  FROM ln WINDOW w AS (PARTITION BY run_id ORDER BY frame))
SELECT run_id, frame, trans_x, round(t1, 6) AS trans_x_derivative1, round(csf, 6) AS csf,
  round(c1 / nullif(max(c1) OVER (PARTITION BY run_id), 0), 6) AS csf_derivative1, out::INT::DOUBLE AS motion_outlier00 FROM d""")
def confounds_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    # groups of confounds that these lines lack are there as nulls in other recordings
    absent = [c for c in (*design.MOTION, *(f"{m}_derivative1" for m in design.MOTION), *design.CSF) if c not in lines.columns]
    found = design.confounds(
        lines.withColumns({c: F.lit(None).cast("double") for c in absent}), motion_squared=False, motion_derivative_squared=False
    ).drop(*absent)
    return rounded(found, "trans_x_derivative1", "csf", "csf_derivative1")


@query("outlier_frames", f"WITH {_LINES_SQL} SELECT run_id, frame FROM ln WHERE out")
def outlier_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design.outlier_frames(_lines(spark, sf_dir))


@query("smoothing_kernel", """WITH p AS (SELECT 2 * 2.5 / sqrt(8 * ln(2)) AS v, (0.75 * 2 * 2.5)::INT AS dummy),
a AS (SELECT unnest(range(-3, 4))::INT AS d), w AS (SELECT d, exp(-d * d / (2 * v)) / sqrt(2 * pi() * v) AS w FROM a, p)
SELECT x.d AS dx, y.d AS dy, z.d AS dz, round(x.w * y.w * z.w, 8) AS weight FROM w x, w y, w z""")
def smoothing_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(design.smoothing_kernel(spark, (2.0,) * 3, (2.5,) * 3), "weight", digits=8)


@query("scalar_functions", """SELECT p_partkey, round(p_size * sqrt(8 * ln(2)), 6) AS fwhm, round(p_retailprice / sqrt(8 * ln(2)), 6) AS sigma,
  round((1 - 0.6658) * exp(-0.7 * (p_size - 1)), 9) AS saturation FROM part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select(
        "p_partkey", scalar.sigma_to_fwhm("p_size").alias("fwhm"), scalar.fwhm_to_sigma("p_retailprice").alias("sigma"), scalar.saturation("p_size").alias("saturation")
    )
    return rounded(rounded(found, "fwhm", "sigma"), "saturation", digits=9)


@query("padded_stimulus", """SELECT conv_id, '  ' || rtrim(string_agg(replace(role, ' ', ' ') || '   ', '' ORDER BY turn)) || ' ' AS sequence FROM conversations GROUP BY conv_id""")
def padded_stimulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"])
    runs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("p"))
    return runs.select("conv_id", scalar.padded_stimulus("p", 2, 1, 3, 1).alias("sequence"))
