"""Separated-value, JSON and text files as DataFrames, and names of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Schema of an event file.
EVENTS = "onset string, duration string, trial_type string, letter string"


def read_separated(spark: SparkSession, path: str, sep: str = "\t", schema: str | StructType | None = None, null_value: str = "") -> DataFrame:
    """Rows of files with a heading; all columns are text unless a schema says otherwise."""
    reader = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("nullValue", null_value)
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def rows_of_lines(lines: DataFrame, names: list[str], sep: str = "\t", column: str = "value") -> DataFrame:
    """Lines without their heading as rows of text columns."""
    schema = StructType([StructField(n, StringType()) for n in names])
    return lines.select(F.from_csv(column, schema.simpleString()[7:-1].replace(":", " "), {"sep": sep}).alias("r")).select("r.*")


def write_separated(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Without quotes, with a heading, replacing what is there."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("quote", "").csv(path)


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A file is one document (an object, or an array of rows), or with ``lines`` a document a line."""
    return spark.read.json(path, multiLine=not lines)


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """A document for each row, on a line of its own; ``pretty`` breaks it into indented lines."""
    if pretty:
        write_text(df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")), path)
    else:
        df.write.mode("overwrite").json(path)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row (path, value) for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value), numbered in each file."""
    return read_whole_text(spark, path).select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def write_text(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def recording_fields(path: Column | str) -> list[Column]:
    """sub, ses, task, run and space from the name of a recording, and the files that belong to it.

    ``ses`` comes from the whole path, the others from the file's name; what is missing is null.
    """
    p = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(p, "/"), -1)
    tag = lambda c, t: F.nullif(F.regexp_extract(c, rf"{t}-([A-Za-z0-9]+)", 1), F.lit(""))
    stem = F.regexp_replace(p, r"_space-.*$", "")
    image = F.regexp_replace(p, r"_desc-[^/]*$", "")
    return [
        *[tag(name, t).alias(t) for t in ("sub", "task", "run", "space")], tag(p, "ses").alias("ses"),
        F.concat(image, F.lit("_desc-brain_mask.nii.gz")).alias("mask_path"),
        F.concat(stem, F.lit("_desc-confounds_timeseries.tsv")).alias("confounds_path"),
        F.regexp_extract(p, r"^(.*/derivatives)/", 1).alias("derivatives_path"),
    ]


def first_existing(rows: DataFrame, candidates: list[str], listing: DataFrame, out: str = "found") -> DataFrame:
    """The first of the candidate path columns that the listing (one column path) has."""
    known = listing.select("path").distinct()
    for i, c in enumerate(candidates):
        rows = rows.join(known.select(F.col("path").alias(f"__{i}")), F.col(c) == F.col(f"__{i}"), "left")
    return rows.withColumn(out, F.coalesce(*[F.col(f"__{i}") for i in range(len(candidates))])).drop(*[f"__{i}" for i in range(len(candidates))])
