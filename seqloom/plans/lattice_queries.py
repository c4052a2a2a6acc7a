"""Queries of lattices and grammars made of the tables' own words, and of small helpers over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import arrays as A
from seqloom.functions import scalar
from seqloom.operators import language, recordings
from seqloom.plans.image_queries import image_folder
from seqloom.plans.registry import query
from seqloom.plans.views import CELLS_SQL, LETTERS_SQL, SERIES_SQL, letter_rows, rounded, series, table

_BRANDS_SQL = """w AS (SELECT p_brand AS word, row_number() OVER (ORDER BY p_brand) - 1 AS id, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)),
s AS (SELECT p_brand AS a, lead(p_brand) OVER (ORDER BY p_partkey) AS b FROM part),
p AS (SELECT DISTINCT x.id AS a, y.id AS b, x.n FROM s JOIN w x ON x.word = s.a JOIN w y ON y.word = s.b)"""


@query("brand_lattice", f"""WITH RECURSIVE {_BRANDS_SQL},
e AS (SELECT id AS src, n + 2 * id AS dst FROM w UNION ALL SELECT n + 2 * id, n + 2 * id + 1 FROM w UNION ALL SELECT n + 2 * a + 1, b FROM p
  UNION ALL SELECT 3 * n + 1, 0 FROM (SELECT DISTINCT n FROM w) UNION ALL SELECT n - 1, 3 * n FROM (SELECT DISTINCT n FROM w)),
r AS (SELECT src, dst FROM e WHERE src < (SELECT max(n) FROM w) OR src = (SELECT max(3 * n + 1) FROM w)
  UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst WHERE r.dst >= (SELECT max(n) FROM w) AND r.dst < (SELECT max(3 * n) FROM w))
SELECT DISTINCT src::INT AS src, dst::INT AS dst FROM r WHERE dst < (SELECT max(n) FROM w) OR dst = (SELECT max(3 * n) FROM w)""")
def brand_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which brands follow which in the parts, written as a lattice with two null nodes after each brand, read, and
    freed of these; before the first brand stands the start, after the last one the end."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    words = parts.select("p_brand").distinct()
    n = words.count()
    # as many rows as there are brands
    ids = words.withColumn("id", F.row_number().over(Window.orderBy("p_brand")) - 1)
    follows = parts.select(F.col("p_brand").alias("a"), F.lead("p_brand").over(Window.orderBy("p_partkey")).alias("b")).where("b IS NOT NULL").distinct()
    pairs = follows.join(ids.select(F.col("p_brand").alias("a"), F.col("id").alias("x")), "a").join(ids.select(F.col("p_brand").alias("b"), F.col("id").alias("y")), "b")
    node = lambda i, word: F.concat(F.lit("I="), i.cast("string"), F.lit(" W="), word).alias("value")
    edge = lambda a, b: F.concat(F.lit("J=0 S="), a.cast("string"), F.lit(" E="), b.cast("string")).alias("value")
    i = F.col("id")
    lines = ids.select(node(i, F.col("p_brand")))
    for part in (
        spark.range(n, 3 * n + 2).select(node(i, F.lit("!NULL"))), ids.select(edge(i, n + 2 * i)), ids.select(edge(n + 2 * i, n + 2 * i + 1)),
        pairs.select(edge(n + 2 * F.col("x") + 1, F.col("y"))), spark.range(1).select(edge(F.lit(3 * n + 1), F.lit(0))), spark.range(1).select(edge(F.lit(n - 1), F.lit(3 * n))),
    ):
        lines = lines.unionByName(part)
    return language.without_nulls(*language.lattice(lines))


@query("nation_grammar", """WITH n AS (SELECT replace(n_name, ' ', '_') AS w, n_regionkey % 2 AS k FROM nation),
s AS (SELECT 'start' AS a, w AS b FROM n WHERE k = 0 UNION ALL SELECT x.w, y.w FROM n x JOIN n y ON (x.k = 0 AND y.k = 1) OR (x.k = 1 AND y.k = 1) UNION ALL SELECT w, 'end' FROM n WHERE k = 1)
SELECT DISTINCT a, b FROM s""")
def nation_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nation of the even regions, then one or more of the odd ones: which may follow which."""
    name = F.replace(F.col("n_name"), F.lit(" "), F.lit("_"))
    groups = table(spark, sf_dir, "nation").groupBy((F.col("n_regionkey") % 2).alias("k")).agg(F.array_join(F.array_sort(F.collect_set(name)), " | ").alias("words"))
    of = {r["k"]: r["words"] for r in groups.collect()}  # two rows
    nodes, edges = language.grammar_lattice(spark, f"$even = {of[0]} ; $odd = {of[1]} ; ( $even < $odd > )")
    last = nodes.agg(F.max("id")).first()[0]
    named = nodes.select("id", F.when(F.col("id") == last, "start").when(F.col("id") == last - 1, "end").otherwise(F.col("symbol")).alias("name"))
    found = language.without_nulls(nodes, edges)
    a, b = named.select(F.col("id").alias("src"), F.col("name").alias("a")), named.select(F.col("id").alias("dst"), F.col("name").alias("b"))
    return found.join(a, "src").join(b, "dst").select("a", "b").distinct()


@query("space_tokens", """WITH c AS (SELECT item_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS letter FROM benchmark WHERE length(text) > 0)
SELECT item_id, pos::INT AS pos, CASE letter WHEN ' ' THEN '_space_' ELSE letter END AS token, letter AS back FROM c""")
def space_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("pos", "letter")).where("letter <> ''")
    named = chars.select("item_id", "pos", scalar.space_to_token("letter").alias("token"))
    return named.withColumn("back", scalar.token_to_space("token"))


@query("matrix_products", f"""WITH {SERIES_SQL}, m AS (SELECT voxel_id, ts[1] AS a, ts[2] AS b, ts[3] AS c, ts[4] AS d, ts[5] AS x, ts[6] AS y FROM s)
SELECT voxel_id, round(a * x + b * y, 6) AS v1, round(c * x + d * y, 6) AS v2, round(x * (a * x + b * y) + y * (c * x + d * y), 6) AS q,
  round(a * a + b * c, 6) AS p11, round(a * b + b * d, 6) AS p12, round(c * a + d * c, 6) AS p21, round(c * b + d * d, 6) AS p22,
  round(a * a + b * c, 6) AS d1, round(c * b + d * d, 6) AS d2, round(a * x, 6) AS s11, round(d * y, 6) AS s22 FROM m""")
def matrix_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of a small matrix and a vector of each series."""
    at = lambda k: F.col("ts")[k]
    rows = series(spark, sf_dir).select("voxel_id", F.array(F.array(at(0), at(1)), F.array(at(2), at(3))).alias("m"), F.array(at(4), at(5)).alias("v"))
    found = rows.select("voxel_id", A.matvec("m", "v").alias("mv"), A.quadratic("v", "m").alias("q"), A.matmul("m", "m").alias("p"), A.diagonal_of_product("m", "m").alias("d"), A.row_scale("m", "v").alias("s"))
    cells = {"v1": F.col("mv")[0], "v2": F.col("mv")[1], "q": F.col("q"), "d1": F.col("d")[0], "d2": F.col("d")[1], "s11": F.col("s")[0][0], "s22": F.col("s")[1][1]}
    cells |= {f"p{i + 1}{j + 1}": F.col("p")[i][j] for i in (0, 1) for j in (0, 1)}
    return found.select("voxel_id", *[F.round(c, 6).alias(n) for n, c in cells.items()])


@query("log_letters", f"WITH {LETTERS_SQL}, c AS (SELECT letter, count(*) AS n FROM l GROUP BY letter) SELECT letter, round(log10(n / (SELECT sum(n) FROM c)), 6) AS p FROM c")
def log_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = letter_rows(spark, sf_dir).groupBy("letter").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("letter", (F.col("n") / F.col("total")).alias("p"))  # as many rows as letters
    return rounded(language.log10_table(shares), "p")


@query("image_features", f"""WITH {CELLS_SQL},
h AS (SELECT sub, (x // 4)::INT AS region_idx, frame, avg(value) AS v FROM c GROUP BY ALL),
b AS (SELECT sub, frame, avg(value) AS v FROM c WHERE z < 2 GROUP BY ALL),
ra AS (SELECT sub, region_idx, frame, (v - first_value(v) OVER w) / first_value(v) OVER w AS v FROM h WINDOW w AS (PARTITION BY sub, region_idx ORDER BY frame)),
rb AS (SELECT sub, frame, (v - first_value(v) OVER w) / first_value(v) OVER w AS v FROM b WINDOW w AS (PARTITION BY sub ORDER BY frame))
SELECT sub::VARCHAR || '_1_spell_2' AS run_id, sub::VARCHAR AS sub, region_idx, frame, round(ra.v - rb.v, 4) AS value FROM ra JOIN rb USING (sub, frame)""")
def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From image files to calibrated mean signals: two regions of each subject, calibrated by two layers. Cells
    that the table lacks are in no region."""
    cells = recordings.image_runs(spark, image_folder(spark, sf_dir, "_ses-1_task-spell_run-2_space-MNI_desc-preproc_bold"), in_parts=True)
    rows = series(spark, sf_dir).select(F.col("sub").cast("string").alias("sub"), "x", "y", "z")
    roi = rows.withColumn("region_idx", F.expr("x div 4").cast("int"))
    rest = rows.where("z < 2").withColumn("region_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    runs = cells.select("run_id", "sub").distinct()
    ev = runs.select("run_id", F.lit(0).cast("long").alias("row_idx"), F.lit("b").alias("trial_type"), F.lit("a").alias("letter"), F.lit(0.0).alias("onset"), F.lit(1.0).alias("duration"))
    found = recordings.features_and_labels(cells, ev, roi, rest)
    return rounded(found.features, "value", digits=4).select("run_id", "sub", "region_idx", "frame", "value")
