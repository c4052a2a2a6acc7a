"""Queries from events, confounds and images to designs, fits and t maps of many runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import recordings
from seqloom.plans.event_queries import _basis_sql
from seqloom.plans.registry import query
from seqloom.plans.views import MERGED_SQL, RUN_LEN_S, event_rows, rounded, series

#: 64 frames of a run of the events view; at this resolution a frame is 45 samples.
N_FRAMES, RESOLUTION_S = 64, 0.25
FRAME_S = RUN_LEN_S / N_FRAMES
_STEPS, _REACH = int(FRAME_S / RESOLUTION_S), int(32 / RESOLUTION_S)

_DESIGN_SQL = f"""WITH {_basis_sql(RESOLUTION_S)},
sb AS (SELECT sample, unnest([0, 1, 2])::INT AS basis_idx, unnest([hrf, d_hrf, dd_hrf]) / (SELECT max(hrf) FROM hb) AS weight FROM hb), {MERGED_SQL},
o AS (SELECT *, floor(onset_s / {RESOLUTION_S})::BIGINT AS a, floor((onset_s + duration_s) / {RESOLUTION_S})::BIGINT AS z FROM m),
u AS (SELECT run_id, trial_type, event_idx, 1::DOUBLE / (z - a) AS value, unnest(range(a, z)) AS sample FROM o WHERE z > a),
os AS (SELECT run_id, trial_type, sample, arg_max(value, event_idx) AS value FROM u WHERE sample < {int(RUN_LEN_S / RESOLUTION_S)} GROUP BY ALL),
ty AS (SELECT trial_type, row_number() OVER (ORDER BY trial_type) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT trial_type FROM m)),
st AS (SELECT run_id, f.frame, (3 * k + basis_idx)::INT AS reg_idx, trial_type || '_' || basis_idx AS regressor, sum(os.value * weight) AS value
  FROM os JOIN ty USING (trial_type) JOIN (SELECT unnest(range({N_FRAMES})) AS frame) f ON f.frame * {_STEPS} >= os.sample AND f.frame * {_STEPS} < os.sample + {_REACH}
  JOIN sb ON sb.sample = f.frame * {_STEPS} - os.sample GROUP BY ALL),
dr AS (SELECT f AS frame, k, CASE k WHEN 0 THEN 1 ELSE cos(pi() / {N_FRAMES} * (f + 0.5) * k) END AS value FROM range({N_FRAMES}) a(f) CROSS JOIN range(11) b(k)),
sc AS (SELECT user_id AS run_id, (event_id % {N_FRAMES})::BIGINT AS frame, avg(value) AS value FROM events GROUP BY ALL)
SELECT run_id, frame, reg_idx, regressor, round(value, 6) AS value FROM st
UNION ALL SELECT run_id, frame, (3 * (SELECT max(n) FROM ty) + k)::INT, 'drift_' || k, round(value, 6) FROM (SELECT DISTINCT run_id FROM e) CROSS JOIN dr
UNION ALL SELECT run_id, frame, (3 * (SELECT max(n) FROM ty) + 11)::INT, 'csf', round(value, 6) FROM sc"""


def _confounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up confound of each run and frame: the mean of some of the user's values."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("run_id"), (F.col("event_id") % N_FRAMES).alias("frame"), "value")
    return rows.groupBy("run_id", "frame").agg(F.avg("value").alias("csf"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series belongs to the run of the user with its label's number."""
    return series(spark, sf_dir).select(F.col("sub").cast("long").alias("run_id"), "voxel_id", "x", "y", "z", "ts")


@query("run_designs", _DESIGN_SQL)
def run_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recordings.run_designs(
        spark, event_rows(spark, sf_dir), N_FRAMES, FRAME_S, _confounds(spark, sf_dir), resolution_s=RESOLUTION_S, method="epoch", ignore=("rest",)
    )
    return rounded(found.withColumn("frame", F.col("frame").cast("long")), "value")


@query("glm_from_runs")
def glm_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From images, events and confounds to t maps of all types and pairs of types, with autoregressions
    of order 2; the same call is held against numpy in the tests."""
    whole = _images(spark, sf_dir).select("x", "y", "z").distinct()
    found = recordings.analyse(
        spark, _images(spark, sf_dir), event_rows(spark, sf_dir), N_FRAMES, FRAME_S, confound_rows=_confounds(spark, sf_dir), mask=whole, fwhm_mm=0.0,
        ar_order=2, resolution_s=RESOLUTION_S, method="epoch",
    )
    return rounded(rounded(found.t, "estimate"), "t", digits=4)
