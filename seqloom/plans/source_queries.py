"""Queries that write the tables at hand in the formats of recordings and read them back; and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import language, signal
from seqloom.plans.registry import query
from seqloom.plans.views import LETTERS_SQL, SERIES_SQL, cells, letter_rows, rounded, series, table
from seqloom.sources import images, tables
from seqloom.sources.storage import shared_folder
from seqloom.streaming import windows


@query("separated_round_trip", "SELECT event_id, user_id, event_type, value, props FROM events")
def separated_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tab-separated files, read as text and cast."""
    path = shared_folder(spark, "separated")
    tables.write_separated(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    back = tables.read_separated(spark, path)
    return back.select(F.col("event_id").cast("long"), F.col("user_id").cast("long"), "event_type", F.col("value").cast("double"), "props")


@query("rows_of_lines", "SELECT n_nationkey::VARCHAR AS key, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def rows_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separated values that are there as lines already."""
    lines = table(spark, sf_dir, "nation").select(F.concat_ws("\t", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    return tables.rows_of_lines(lines, ["key", "name", "region"])


@query("json_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    tables.write_json(docs, path)
    return tables.read_json(spark, path, lines=True).select("doc_id", "text", "lang", "source", "n_chars")


@query("text_round_trip", "SELECT c_name AS value FROM customer")
def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "text")
    tables.write_text(table(spark, sf_dir, "customer"), path, "c_name")
    return tables.read_lines(spark, path).where("value <> ''").select("value")


@query("recording_names", """SELECT p_partkey, 's' || p_partkey AS sub, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS ses, 'spell' AS task,
  '/d/derivatives/prep/sub-s' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '/ses-' || p_size ELSE '' END || '/sub-s' || p_partkey || '_task-spell_desc-confounds_timeseries.tsv' AS confounds_path,
  '/d/derivatives' AS derivatives_path FROM part""")
def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("/sub-s"), "p_partkey")
    ses = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("/ses-"), "p_size")).otherwise(F.lit(""))
    path = F.concat(F.lit("/d/derivatives/prep"), name, ses, name, F.lit("_task-spell_space-MNI_desc-preproc_bold.nii.gz"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", *tables.recording_fields("path")).select("p_partkey", "sub", "ses", "task", "confounds_path", "derivatives_path")


@query("first_existing", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'a' || p_partkey WHEN p_partkey % 3 = 1 THEN 'b' || p_partkey END AS found FROM part")
def first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two places of a file the first that is listed."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("a"), key).alias("a"), F.concat(F.lit("b"), key).alias("b"))
    listing = rows.where("p_partkey % 3 = 0").select(F.explode(F.array("a", "b")).alias("path")).union(rows.where("p_partkey % 3 = 1").select("b"))
    return tables.first_existing(rows, ["a", "b"], listing).select("p_partkey", "found")


@query("feature_round_trip", f"WITH {SERIES_SQL} SELECT voxel_id, 80::BIGINT AS period, i::INT AS frame, j::INT AS dimension, round(ts[1 + 8 * i + j], 6) AS value FROM s CROSS JOIN range(8) a(i) CROSS JOIN range(8) b(j)")
def feature_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series as the bytes of feature files of 8 frames of 8 values, 64 ms long, and back."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("ts", k * 8 + 1, 8))
    files = images.feature_bytes(series(spark, sf_dir).select("voxel_id", frames.alias("frames")), length_ms=64)
    back = images.features_of(files, "voxel_id").select("voxel_id", "period", F.posexplode("frames").alias("frame", "f"))
    return rounded(back.select("voxel_id", "period", "frame", F.posexplode("f").alias("dimension", "value")).withColumn("value", F.col("value").cast("double")), "value")


@query("label_round_trip", f"WITH {LETTERS_SQL} SELECT run_id, letter AS token, count(*) AS n FROM l GROUP BY ALL")
def label_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with their neighbours as label files, written, read by lines and stripped of the neighbours."""
    from seqloom.operators import hmm

    named = hmm.context_tokens(letter_rows(spark, sf_dir).withColumnRenamed("letter", "token"), run="run_id").select(
        "run_id", "pos", (F.col("pos") * 4).alias("start"), (F.col("pos") * 4 + 4).alias("end"), F.col("context_token").alias("token")
    )
    text = images.label_text(named, "run_id")
    lines = text.select(F.col("run_id").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return images.read_label_tokens(lines).groupBy(F.col("path").alias("run_id"), "token").agg(F.count(F.lit(1)).alias("n"))


_UNIGRAMS_SQL = f"WITH {LETTERS_SQL} SELECT 1 AS n, '' AS history, letter AS next, round(log10(count(*) / (SELECT count(*) FROM l)), 6) AS p FROM l GROUP BY letter"


@query("arpa_round_trip", _UNIGRAMS_SQL)
def arpa_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of letters as the lines of an n-gram model file, and back."""
    counts = letter_rows(spark, sf_dir).groupBy("letter").agg(F.count(F.lit(1)).alias("c"))
    shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("c").alias("total"))))  # as many rows as letters
    body = shares.select(F.lit(3).alias("line_no"), F.concat_ws("\t", F.log10(F.col("c") / F.col("total")), "letter", F.lit("-0.3")).alias("value"))
    head = spark.createDataFrame([(0, "\\data\\"), (1, "ngram 1=3"), (2, "\\1-grams:"), (3, "-1.0\t<s>\t-0.3"), (4, "\\end\\")], "line_no int, value string")
    return rounded(language.arpa_ngrams(head.unionByName(body)), "p")


@query("grammar_words", """WITH g(a, b) AS (VALUES ('start', 'up'), ('start', 'down'), ('up', 'left'), ('down', 'left'), ('up', 'right'), ('down', 'right'),
  ('left', 'left'), ('left', 'right'), ('right', 'left'), ('right', 'right'), ('left', 'end'), ('right', 'end')) SELECT a, b FROM g""")
def grammar_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words may follow which in a grammar."""
    nodes, edges = language.grammar_lattice(spark, "$first = up | down ; $next = left | right ; ( $first < $next > )")
    last = nodes.agg(F.max("id").alias("m"))
    named = nodes.crossJoin(F.broadcast(last)).select("id", F.when(F.col("id") == F.col("m"), "start").when(F.col("id") == F.col("m") - 1, "end").otherwise(F.col("symbol")).alias("name"))
    found = language.without_nulls(nodes, edges)
    return found.join(named.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst").select("a", "b")


@query("windows_of_stream", """WITH w AS (SELECT event_type, value, ts, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS window_start FROM events),
g AS (SELECT window_start, window_start + INTERVAL 2 DAY AS window_end, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY ALL)
SELECT * FROM g WHERE window_end <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def windows_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; windows of two days are given out when the watermark has passed them."""
    path = shared_folder(spark, "events")
    # days are those of UTC, whatever the session's time zone
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    rows = table(spark, sf_dir, "events").select(F.timestamp_micros(micros).alias("ts"), "event_type", "value")
    rows.write.parquet(path)
    counts = windows.event_windows(spark.readStream.schema(rows.schema).parquet(path), "2 days", "1 day", "1 day", ["event_type"])
    found = _run(spark, counts, "windows")
    plain = {c: F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), TIMESTAMP_NTZ '1970-01-01 00:00:00')") for c in ("window_start", "window_end")}
    return rounded(found.withColumns(plain), "mean")


def _run(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """What a stream gives for the data at hand, from the folder to which it writes."""
    path = shared_folder(spark, label)
    running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", shared_folder(spark, f"{label}-state")).outputMode("append")
    running = running.trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _low_pass_sql() -> str:
    (b0, b1, b2, a1, a2), *rest = signal.butterworth(2, None, 0.1, 1.0)
    assert not rest
    return f"""WITH RECURSIVE {SERIES_SQL},
y AS (SELECT voxel_id, 1 AS i, ts, {b0!r} * ts[1] AS v, {b1!r} * ts[1] - {a1!r} * {b0!r} * ts[1] AS p, {b2!r} * ts[1] - {a2!r} * {b0!r} * ts[1] AS q FROM s
  UNION ALL
  SELECT voxel_id, i + 1, ts, {b0!r} * ts[i + 1] + p, {b1!r} * ts[i + 1] - {a1!r} * ({b0!r} * ts[i + 1] + p) + q, {b2!r} * ts[i + 1] - {a2!r} * ({b0!r} * ts[i + 1] + p)
  FROM y WHERE i < len(ts))
SELECT voxel_id AS run_id, (i - 1)::BIGINT AS frame, round(v, 6) AS value FROM y"""


@query("filter_of_stream", _low_pass_sql())
def filter_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of all series as a stream through a filter that carries its state."""
    path = shared_folder(spark, "frames")
    frames = cells(spark, sf_dir).select(F.col("voxel_id").alias("run_id"), F.col("frame").cast("long").alias("frame"), "value")
    frames.write.parquet(path)
    stream = spark.readStream.schema(frames.schema).parquet(path)
    return rounded(_run(spark, windows.filter_stream(stream, signal.butterworth(2, None, 0.1, 1.0)), "filtered"), "value")
