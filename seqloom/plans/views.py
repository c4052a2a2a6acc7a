"""The tables at hand as the inputs that the operators take. Each view covers its whole table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of the events view lasts 30 days; a day counts as 24 seconds, an hour as one.
RUN_LEN_S = 720.0

#: Events of a task: each gives rows for the samples or frames that it reaches, so few events are much memory.
EVENTS_PER_TASK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows of each user; an event lasts until the user's next one, the last for one second.

    Runs are dealt to as many tasks as the table's rows need. What follows by run keeps that; left to itself, Spark joins
    shuffled partitions by their bytes, which are few, and tasks grow with the table.
    """
    ticks = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(ts AS timestamp_ntz)) div 36000000")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("row_idx"), F.col("event_type").alias("trial_type"),
        F.substring("event_type", 1, 1).alias("letter"), ticks.alias("t"),
    )
    n_tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows.count() / EVENTS_PER_TASK))
    rows = rows.repartition(n_tasks, "run_id")
    ahead = F.lead("t").over(Window.partitionBy("run_id").orderBy("row_idx")) - F.col("t")
    return rows.withColumn("d", F.coalesce(ahead, F.lit(100))).select(
        "run_id", "row_idx", "trial_type", "letter", (F.col("t") / 100.0).alias("onset"), (F.col("d") / 100.0).alias("duration")
    )


EVENTS_SQL = """
ev AS (SELECT user_id AS run_id, event_id AS row_idx, event_type AS trial_type, substr(event_type, 1, 1) AS letter,
              (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 36000000 AS t FROM events),
e AS (SELECT run_id, row_idx, trial_type, letter, t / 100::DOUBLE AS onset,
             coalesce(lead(t) OVER (PARTITION BY run_id ORDER BY row_idx) - t, 100) / 100::DOUBLE AS duration FROM ev)"""

#: Rows of merged events: m(run_id, trial_type, event_idx, onset_s, duration_s).
MERGED_SQL = EVENTS_SQL + """,
f AS (SELECT *, CASE WHEN lag(onset + duration) OVER w = onset THEN 0 ELSE 1 END AS fresh FROM e
      WHERE trial_type NOT IN ('rest') WINDOW w AS (PARTITION BY run_id, trial_type ORDER BY row_idx)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id, trial_type ORDER BY row_idx) - 1 AS event_idx FROM f),
m AS (SELECT run_id, trial_type, event_idx::BIGINT AS event_idx, min(onset) AS onset_s, sum(duration) AS duration_s
      FROM g GROUP BY ALL)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each voxel: voxel_id, sub, x, y, z, ts of 64 frames."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("voxel_id"), F.col("label").alias("sub"), (v % 8).cast("int").alias("x"), F.expr("(vec_id div 8) % 8").cast("int").alias("y"),
        F.expr("vec_id div 64").cast("int").alias("z"), F.col("embedding").cast("array<double>").alias("ts"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series(spark, sf_dir).select("voxel_id", "sub", "x", "y", "z", F.posexplode("ts").alias("frame", "value"))


SERIES_SQL = """
s AS (SELECT vec_id AS voxel_id, label AS sub, (vec_id % 8)::INT AS x, ((vec_id // 8) % 8)::INT AS y, (vec_id // 64)::INT AS z,
             embedding::DOUBLE[] AS ts FROM embeddings)"""
CELLS_SQL = SERIES_SQL + """,
c AS (SELECT voxel_id, sub, x, y, z, unnest(range(len(ts)))::INT AS frame, unnest(ts) AS value FROM s)"""

#: t-like values of 8 regions: the mean of each block of 8 frames, times 10.
REGIONS_SQL = CELLS_SQL + """,
r AS (SELECT sub, (frame // 8)::INT AS region_idx, voxel_id, x, y, z, round(avg(value) * 10, 6) AS t FROM c GROUP BY ALL)"""


def region_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t-like values: sub, region_idx, voxel_id, x, y, z, t; a region is a block of 8 frames."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("ts", k * 8 + 1, 8))
    mean = F.aggregate("block", F.lit(0.0), lambda a, b: a + b) / F.size("block")
    rows = series(spark, sf_dir).select("sub", F.posexplode(blocks).alias("region_idx", "block"), "voxel_id", "x", "y", "z")
    return rows.where("size(block) > 0").withColumn("t", F.round(mean * 10, 6)).drop("block")


def letter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each conversation: the first letter of the role at each turn."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), F.substring("role", 1, 1).alias("letter"), F.length(F.coalesce("text", F.lit(""))).alias("n")
    )


LETTERS_SQL = """
l AS (SELECT conv_id AS run_id, turn AS pos, substr(role, 1, 1) AS letter, length(coalesce(text, ''))::BIGINT AS n FROM conversations)"""

#: A small code book: which of two regions is on for each letter.
BOOK = [("s", "left", 0), ("s", "right", 0), ("u", "left", 1), ("u", "right", 0), ("a", "left", 0), ("a", "right", 1)]
BOOK_SQL = "b(letter, region, bit) AS (VALUES " + ", ".join(f"('{a}', '{r}', {v})" for a, r, v in BOOK) + ")"


def book(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOOK, "letter string, region string, bit int")


def on_probability(region: Column | str, n: Column | str) -> Column:
    """A made-up probability that a region is on, from a message's length."""
    shift = F.when(F.col(region) == "left", 7).otherwise(13)
    return ((F.col(n) * shift) % 98 + 1) / 100.0
