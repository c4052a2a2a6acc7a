"""Queries on volumes: thresholds, votes, components, overlap, growth, smoothing and mean signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import design, volume
from seqloom.plans.registry import query
from seqloom.plans.views import CELLS_SQL, REGIONS_SQL, cells, region_t, rounded, series
from seqloom.sources.storage import cut_lineage

_XYZ = ("x", "y", "z")

#: h: cells of each subject and region above the 80 % quantile of what is positive.
_ROI_SQL = f"""{REGIONS_SQL},
lim AS (SELECT sub, region_idx, quantile_cont(t, 0.8) AS lim FROM r WHERE t > 0 GROUP BY ALL),
h AS (SELECT r.* FROM r JOIN lim USING (sub, region_idx) WHERE t > lim)"""


def _roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.above_quantile(region_t(spark, sf_dir), ["sub", "region_idx"], q=0.8)


@query("roi_threshold", f"WITH {_ROI_SQL} SELECT sub, region_idx, x, y, z, t FROM h")
def roi_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roi(spark, sf_dir).select("sub", "region_idx", *_XYZ, "t")


#: Cells in a plane, so that several runs vote for one: u(region_idx, x, y, z, votes).
_VOTES_SQL = f"""{_ROI_SQL},
u AS (SELECT region_idx, x, y, 0 AS z, count(*) AS votes FROM h GROUP BY ALL)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.votes(_roi(spark, sf_dir).withColumn("z", F.lit(0)), ["region_idx"])


@query("roi_votes", f"""WITH {_VOTES_SQL}
SELECT u.* FROM u JOIN (SELECT region_idx, quantile_cont(votes, 0.8) AS lim FROM u GROUP BY ALL) USING (region_idx) WHERE votes >= lim""")
def roi_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.enough_votes(_votes(spark, sf_dir), ["region_idx"])


@query("roi_overlap_removed", f"""WITH {_ROI_SQL},
k AS (SELECT *, count(*) FILTER (WHERE region_idx < 6) OVER w AS n, max(CASE WHEN region_idx < 6 THEN region_idx END) OVER w AS top FROM h
  WINDOW w AS (PARTITION BY sub, x, y, z))
SELECT sub, region_idx, x, y, z FROM k WHERE region_idx >= 6 OR (n % 2 = 1 AND region_idx = top)""")
def roi_overlap_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.exclusive_regions(_roi(spark, sf_dir), by=["sub"]).select("sub", "region_idx", *_XYZ)


@query("mask_without_overlap", f"""WITH {_ROI_SQL}, m AS (SELECT DISTINCT region_idx, x, y, z FROM h),
p AS (SELECT a.region_idx AS a, b.region_idx AS b FROM (SELECT DISTINCT region_idx FROM m) a JOIN (SELECT DISTINCT region_idx FROM m) b ON a.region_idx < b.region_idx)
SELECT a, b, region_idx, x, y, z FROM p JOIN m ON m.region_idx IN (a, b)
WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.region_idx = a + b - m.region_idx AND o.x = m.x AND o.y = m.y AND o.z = m.z)""")
def mask_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of regions (a, b) without the cells that both have."""
    roi = cut_lineage(_roi(spark, sf_dir).select("region_idx", *_XYZ).distinct(), "regions")
    return volume.pairs_without_overlap(roi)


_COMPONENTS_SQL = f"""WITH RECURSIVE {_ROI_SQL},
m AS (SELECT DISTINCT region_idx, x, y, z FROM h),
e AS (SELECT a.region_idx, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz
  FROM m a JOIN m b ON a.region_idx = b.region_idx AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
reach AS (SELECT region_idx, x, y, z, (x * 1000 + y)::BIGINT * 100000 + z AS src FROM m
  UNION SELECT e.region_idx, bx, by_, bz, src FROM reach r JOIN e ON r.region_idx = e.region_idx AND r.x = ax AND r.y = ay AND r.z = az),
comp AS (SELECT region_idx, x, y, z, min(src) AS c FROM reach GROUP BY ALL),
size AS (SELECT region_idx, c, count(*) AS n FROM comp GROUP BY ALL),
big AS (SELECT *, max(n) OVER (PARTITION BY region_idx) AS top FROM size)"""


@query("roi_components", _COMPONENTS_SQL + " SELECT region_idx, x, y, z, n AS cells FROM comp JOIN size USING (region_idx, c)")
def roi_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = volume.components(_roi(spark, sf_dir).select("region_idx", *_XYZ).distinct(), ["region_idx"])
    sizes = found.groupBy("region_idx", "component").agg(F.count(F.lit(1)).alias("cells"))
    return found.join(sizes, ["region_idx", "component"]).drop("component")


@query("roi_cleaned", _COMPONENTS_SQL + " SELECT region_idx, x, y, z FROM comp JOIN big USING (region_idx, c) WHERE n > floor(top * 0.5)")
def roi_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.clean_components(_roi(spark, sf_dir).select("region_idx", *_XYZ), ["region_idx"])


#: As _COMPONENTS_SQL for each subject, then without overlap among the first six regions.
_REGIONS_OF_T_SQL = f"""WITH RECURSIVE {_ROI_SQL},
m AS (SELECT DISTINCT sub, region_idx, x, y, z FROM h),
e AS (SELECT a.sub, a.region_idx, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM m a JOIN m b
  ON a.sub = b.sub AND a.region_idx = b.region_idx AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
reach AS (SELECT sub, region_idx, x, y, z, (x * 1000 + y)::BIGINT * 100000 + z AS src FROM m
  UNION SELECT e.sub, e.region_idx, bx, by_, bz, src FROM reach r JOIN e ON r.sub = e.sub AND r.region_idx = e.region_idx AND r.x = ax AND r.y = ay AND r.z = az),
comp AS (SELECT sub, region_idx, x, y, z, min(src) AS c FROM reach GROUP BY ALL),
size AS (SELECT sub, region_idx, c, count(*) AS n FROM comp GROUP BY ALL),
big AS (SELECT *, max(n) OVER (PARTITION BY sub, region_idx) AS top FROM size),
kept AS (SELECT comp.* FROM comp JOIN big USING (sub, region_idx, c) WHERE n > floor(top * 0.5)),
k AS (SELECT *, count(*) FILTER (WHERE region_idx < 6) OVER w AS n, max(CASE WHEN region_idx < 6 THEN region_idx END) OVER w AS last FROM kept WINDOW w AS (PARTITION BY sub, x, y, z))
SELECT sub, region_idx, x, y, z FROM k WHERE region_idx >= 6 OR (n % 2 = 1 AND region_idx = last)"""


@query("regions_from_t", _REGIONS_OF_T_SQL)
def regions_from_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, large components and overlap in one."""
    return volume.regions_from_t(region_t(spark, sf_dir), ["sub"], q=0.8).select("sub", "region_idx", *_XYZ)


@query("aggregated_regions", _COMPONENTS_SQL.replace("m AS (SELECT DISTINCT region_idx, x, y, z FROM h)", """u AS (SELECT region_idx, x, y, 0 AS z, count(*) AS votes FROM h GROUP BY ALL),
m AS (SELECT u.region_idx, x, y, z FROM u JOIN (SELECT region_idx, quantile_cont(votes, 0.8) AS enough FROM u GROUP BY ALL) USING (region_idx) WHERE votes >= enough)""") + """
SELECT region_idx, x, y, z FROM comp JOIN big USING (region_idx, c) WHERE n > floor(top * 0.5)""")
def aggregated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of regions from those of all cells of a column in a plane: enough votes, large components."""
    roi = _roi(spark, sf_dir).withColumn("z", F.lit(0)).select("region_idx", *_XYZ)
    return volume.aggregate_regions(roi.withColumn("k", F.lit(1)), ["k"], first_n=None).select("region_idx", *_XYZ)


@query("filtered_image", f"""WITH {CELLS_SQL},
ok AS (SELECT x, y, z FROM c GROUP BY ALL HAVING min(value) > -0.25)
SELECT x, y, z, frame, round(value, 6) AS value FROM c JOIN ok USING (x, y, z) WHERE abs(x - y) <= 4""")
def filtered_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a mask whose every frame exceeds a threshold."""
    image = cells(spark, sf_dir).select(*_XYZ, "frame", "value")
    mask = image.where("abs(x - y) <= 4").select(*_XYZ).distinct()
    return rounded(volume.filter_image(image, mask, threshold=-0.25), "value").select(*_XYZ, "frame", "value")


@query("mask_bbox", f"WITH {_ROI_SQL} SELECT region_idx, " + ", ".join(f"{f}({c}) AS {f}_{c}" for c in _XYZ for f in ("min", "max")) + " FROM h GROUP BY region_idx")
def mask_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume.mask_range(_roi(spark, sf_dir), ["region_idx"])


@query("mask_grown", f"""WITH {_ROI_SQL}, m AS (SELECT DISTINCT region_idx, x, y, z FROM h),
top AS (SELECT max(z) AS nz FROM c),
o AS (SELECT d * i AS i, d * j AS j, d * k AS k FROM range(0, 3) q(d) CROSS JOIN range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(j) CROSS JOIN range(-1, 2) c2(k))
SELECT DISTINCT region_idx, least(greatest(x + i, 0), 7)::INT AS x, least(greatest(y + j, 0), 7)::INT AS y, least(greatest(z + k, 0), nz)::INT AS z FROM m CROSS JOIN o CROSS JOIN top""")
def mask_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region grown by two cells inside the volume."""
    deep = series(spark, sf_dir).agg(F.max("z").alias("z")).first()["z"]
    return volume.grow(_roi(spark, sf_dir).select("region_idx", *_XYZ).distinct(), 2, (8, 8, deep + 1), ["region_idx"])


@query("smooth3d", f"""WITH {CELLS_SQL},
p AS (SELECT 2 / sqrt(8 * ln(2)) AS v), a AS (SELECT unnest(range(-1, 2))::INT AS d), w AS (SELECT d, exp(-d * d / (2 * v)) / sqrt(2 * pi() * v) AS w FROM a, p),
k AS (SELECT a.d AS dx, b.d AS dy, g.d AS dz, a.w * b.w * g.w AS weight FROM w a, w b, w g)
SELECT t.x, t.y, t.z, t.frame, round(sum(c.value * weight), 6) AS value FROM c CROSS JOIN k JOIN (SELECT x, y, z, frame FROM c) t
  ON t.x = c.x + dx AND t.y = c.y + dy AND t.z = c.z + dz AND t.frame = c.frame GROUP BY ALL""")
def smooth3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = design.smoothing_kernel(spark, (2.0,) * 3, (1.0,) * 3)
    return rounded(volume.smooth(cells(spark, sf_dir).select(*_XYZ, "frame", "value"), kernel), "value").select(*_XYZ, "frame", "value")


@query("calibration_mask", f"""WITH {_ROI_SQL}, motor AS (SELECT DISTINCT x, y, z FROM s WHERE list_sum(ts) > 0)
SELECT g.sub, g.region_idx, m.x, m.y, m.z FROM (SELECT DISTINCT sub, region_idx FROM h) g CROSS JOIN motor m
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sub = g.sub AND h.x = m.x AND h.y = m.y AND h.z = m.z)""")
def calibration_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motor mask is that of the cells whose mean is positive."""
    total = F.aggregate("ts", F.lit(0.0), lambda a, b: a + b)
    return volume.calibration_cells(_roi(spark, sf_dir), series(spark, sf_dir).where(total > 0).select(*_XYZ).distinct(), ["sub"]).select("sub", "region_idx", *_XYZ)


@query("roi_mean_signal", f"""WITH {_ROI_SQL}
SELECT h.sub, h.region_idx, c.frame, round(avg(c.value), 6) AS value FROM h JOIN c ON c.sub = h.sub AND c.x = h.x AND c.y = h.y AND c.z = h.z GROUP BY ALL""")
def roi_mean_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = cells(spark, sf_dir).select("sub", *_XYZ, "frame", "value")
    return rounded(volume.mean_signal(image, _roi(spark, sf_dir), ["sub"]), "value")


@query("calibrated_signal", f"""WITH {_ROI_SQL},
a AS (SELECT h.sub, h.region_idx, c.frame, avg(c.value) AS v FROM h JOIN c ON c.sub = h.sub AND c.x = h.x AND c.y = h.y AND c.z = h.z GROUP BY ALL),
b AS (SELECT sub, 0 AS q, frame, avg(value) AS v FROM c GROUP BY ALL),
ra AS (SELECT sub, region_idx, frame, (v - first_value(v) OVER w) / first_value(v) OVER w AS v FROM a WINDOW w AS (PARTITION BY sub, region_idx ORDER BY frame)),
rb AS (SELECT sub, frame, (v - first_value(v) OVER w) / first_value(v) OVER w AS v FROM b WINDOW w AS (PARTITION BY sub ORDER BY frame))
SELECT ra.sub, region_idx, frame, round(ra.v - rb.v, 4) AS value FROM ra JOIN rb USING (sub, frame)""")
def calibrated_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = cells(spark, sf_dir).select("sub", *_XYZ, "frame", "value")
    signal = volume.mean_signal(image, _roi(spark, sf_dir), ["sub"])
    whole = image.groupBy("sub", "frame").agg(F.avg("value").alias("value"))
    base = signal.select("sub", "region_idx").distinct().join(whole, "sub")
    return rounded(volume.calibrated(signal, base, ["sub", "region_idx"]), "value", digits=4).select("sub", "region_idx", "frame", "value")
