"""Queries that write the series at hand as images and read them in parts, from headers to cells and mean signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.registry import query
from seqloom.plans.views import CELLS_SQL, cells, rounded
from seqloom.sources import images
from seqloom.sources.image_parts import read_image_parts, write_images
from seqloom.sources.storage import cut_lineage, shared_folder


def _sub() -> Column:
    return F.regexp_extract("path", r"sub-(\d+)", 1).cast("int").alias("sub")


def image_folder(spark: SparkSession, sf_dir: str, ending: str = "_task-rest_bold") -> str:
    """The folder of one image for each label, 8 x 8 x as many layers as there are, 64 frames."""
    folder = shared_folder(spark, "images")
    rows = cells(spark, sf_dir)
    layers = (rows.agg(F.max("z").alias("z")).first()["z"] or 0) + 1
    named = rows.withColumn("name", F.concat(F.lit("sub-"), F.col("sub").cast("string"), F.lit(ending)))
    cut_lineage(write_images(named, folder, (8, 8, layers), 64, (2.0, 2.5, 3.0), 1.5), "image-files")
    return folder


@query("image_round_trip", f"WITH {CELLS_SQL} SELECT sub, x, y, z, frame, round(value, 6) AS value FROM c WHERE value <> 0")
def image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells that aren't 0, from files that many tasks read."""
    found = read_image_parts(spark, image_folder(spark, sf_dir), skip_zero=True, cells_per_task=10_000)
    return rounded(found.select(_sub(), "x", "y", "z", "frame", "value"), "value")


@query("image_box", f"WITH {CELLS_SQL} SELECT sub, x, y, z, frame, round(value, 6) AS value FROM c WHERE value <> 0 AND frame >= 10 AND frame < 20 AND z < 3 AND y = 2")
def image_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some frames of a box: only these parts of the files are read."""
    found = read_image_parts(spark, image_folder(spark, sf_dir), skip_zero=True, cells_per_task=10_000, frame=(10, 20), z=(0, 3), y=(2, 3))
    return rounded(found.select(_sub(), "x", "y", "z", "frame", "value"), "value")


@query("image_headers", f"""WITH {CELLS_SQL}, n AS (SELECT max(z) + 1 AS nz FROM c)
SELECT DISTINCT sub, 8 AS nx, 8 AS ny, n.nz AS nz, 64 AS n_frames, 2.0::DOUBLE AS dx, 2.5::DOUBLE AS dy, 3.0::DOUBLE AS dz, 1.5::DOUBLE AS frame_s FROM c CROSS JOIN n""")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = images.read_headers(spark, image_folder(spark, sf_dir))
    return found.select(_sub(), "nx", "ny", "nz", "n_frames", "dx", "dy", "dz", "frame_s")
