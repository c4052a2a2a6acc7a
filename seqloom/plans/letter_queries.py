"""Queries on letters, words and language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import scalar
from seqloom.operators import decoding, language, letters
from seqloom.plans.registry import query
from seqloom.plans.views import BOOK_SQL, LETTERS_SQL, book, letter_rows, on_probability, rounded, table

_TRANSITIONS_SQL = f"""WITH {LETTERS_SQL}, {BOOK_SQL},
j AS (SELECT run_id, pos, b.region, bit, lag(bit) OVER (PARTITION BY run_id, b.region ORDER BY pos) AS prev FROM l JOIN b ON l.letter = b.letter),
tr AS (SELECT run_id, pos, region, prev * 2 + bit AS transition FROM j WHERE prev IS NOT NULL)"""


@query("transition_labels", _TRANSITIONS_SQL + " SELECT run_id, pos, region, transition FROM tr")
def transition_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters.transition_labels(letter_rows(spark, sf_dir), book(spark))


@query("transition_states", _TRANSITIONS_SQL + """,
o AS (SELECT run_id, min(pos) - 1 AS pos, region, NULL::INT AS transition FROM tr GROUP BY run_id, region UNION ALL SELECT * FROM tr),
n AS (SELECT *, lead(transition) OVER (PARTITION BY run_id, region ORDER BY pos) AS nxt FROM o)
SELECT run_id, pos, region, coalesce(nxt // 2, transition % 2) AS bit_before, coalesce(transition % 2, nxt // 2) AS bit_after FROM n""")
def transition_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters.transition_states(letters.transition_labels(letter_rows(spark, sf_dir), book(spark)))


@query("letters_from_bits", f"""WITH {LETTERS_SQL}, {BOOK_SQL},
k AS (SELECT run_id, pos, string_agg(((n + CASE region WHEN 'left' THEN 0 ELSE 1 END) % 3 // 2)::VARCHAR, '' ORDER BY region) AS bits
  FROM l CROSS JOIN (SELECT DISTINCT region FROM b) GROUP BY run_id, pos),
w AS (SELECT letter, string_agg(bit::VARCHAR, '' ORDER BY region) AS bits FROM b GROUP BY letter)
SELECT run_id, pos, coalesce(letter, '?') AS letter FROM k LEFT JOIN w USING (bits)""")
def letters_from_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    shift = F.when(F.col("region") == "left", 0).otherwise(1)
    bits = letter_rows(spark, sf_dir).crossJoin(F.broadcast(book(spark).select("region").distinct()))
    bits = bits.select("run_id", "pos", "region", F.floor((F.col("n") + shift) % 3 / 2).cast("int").alias("bit_before"))
    return letters.letters_from_bits(bits, book(spark))


_P_SQL = f"""WITH {LETTERS_SQL}, {BOOK_SQL},
on_ AS (SELECT run_id, pos, region, ((n * CASE region WHEN 'left' THEN 7 ELSE 13 END) % 98 + 1) / 100::DOUBLE AS p_on FROM l CROSS JOIN (SELECT DISTINCT region FROM b)),
p AS (SELECT run_id, pos, letter, product(CASE bit WHEN 1 THEN p_on ELSE 1 - p_on END) AS p FROM on_ JOIN b USING (region) GROUP BY ALL)"""


def _p_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = letter_rows(spark, sf_dir).crossJoin(F.broadcast(book(spark).select("region").distinct()))
    return grid.select("run_id", "pos", "region", on_probability("region", "n").alias("p_on"))


@query("letter_probabilities", _P_SQL + " SELECT run_id, pos, letter, round(p, 6) AS p FROM p")
def letter_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(letters.letter_probabilities(_p_on(spark, sf_dir), book(spark)), "p")


@query("naive_letter_argmax", _P_SQL + """,
q AS (SELECT run_id, pos, letter, round(p, 6) AS p FROM p)
SELECT run_id, pos, letter, p FROM q QUALIFY row_number() OVER (PARTITION BY run_id, pos ORDER BY p DESC, letter) = 1""")
def naive_letter_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return letters.most_probable(rounded(letters.letter_probabilities(_p_on(spark, sf_dir), book(spark)), "p"))


@query("on_probabilities", f"""WITH {LETTERS_SQL},
t AS (SELECT run_id, pos, region, (n % a) / (4 * a)::DOUBLE AS p1, (n % b) / (4 * b)::DOUBLE AS p2, (n % c) / (4 * c)::DOUBLE AS p3
  FROM l CROSS JOIN (VALUES ('left', 7, 5, 11), ('right', 5, 11, 7)) k(region, a, b, c)),
o AS (SELECT run_id, pos, region, p2 + p3 AS off, p1 + p3 AS "on" FROM t UNION ALL SELECT run_id, min(pos) - 1, region, NULL, NULL FROM t GROUP BY run_id, region),
n AS (SELECT *, lead(off) OVER (PARTITION BY run_id, region ORDER BY pos) AS nxt FROM o)
SELECT run_id, pos, region, round((coalesce(nxt, "on") + coalesce("on", nxt)) / 2, 6) AS p_on FROM n""")
def on_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rows = F.col("n"), letter_rows(spark, sf_dir)
    share = lambda m: n % m / (4.0 * m)
    sides = [
        rows.select("run_id", "pos", F.lit(region).alias("region"), *[share(m).alias(f"p{i}") for i, m in enumerate(primes, 1)])
        for region, primes in (("left", (7, 5, 11)), ("right", (5, 11, 7)))
    ]
    return rounded(letters.on_probabilities(sides[0].unionByName(sides[1])), "p_on")


_BIGRAM_SQL = _P_SQL + """,
pair AS (SELECT letter AS prev, lead(letter) OVER (PARTITION BY run_id ORDER BY pos) AS next FROM l),
bc AS (SELECT prev, next, count(*) AS n FROM pair WHERE next IS NOT NULL GROUP BY ALL),
bp AS (SELECT prev, next, n / (sum(n) OVER (PARTITION BY prev))::DOUBLE AS p FROM bc),
grid AS (SELECT x.letter AS prev, y.letter AS next, coalesce(bp.p, (SELECT min(p) FROM bp WHERE p > 0)) AS p
  FROM (SELECT DISTINCT letter FROM b) x CROSS JOIN (SELECT DISTINCT letter FROM b) y LEFT JOIN bp ON bp.prev = x.letter AND bp.next = y.letter)"""


def role_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prev, next, p) of the letters of conversations."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda s: s["letter"])
    runs = letter_rows(spark, sf_dir).groupBy("run_id").agg(in_order.alias("tokens"))
    found = language.ngram_probabilities(language.ngram_counts(runs, 2))
    return found.select(F.col("history").alias("prev"), "next", "p")


@query("bigram_grid", _BIGRAM_SQL + " SELECT prev, next, round(p, 6) AS p FROM grid")
def bigram_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(letters.bigram_grid(book(spark), role_bigrams(spark, sf_dir)), "p")


@query("bigram_weighted", _BIGRAM_SQL + """,
led AS (SELECT p.run_id, p.pos + 1 AS pos, grid.next AS letter, sum(p.p * grid.p) AS led FROM p JOIN grid ON grid.prev = p.letter GROUP BY ALL)
SELECT run_id, pos, letter, round(p.p * coalesce(led, 1), 6) AS p FROM p LEFT JOIN led USING (run_id, pos, letter)""")
def bigram_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = letters.bigram_grid(book(spark), role_bigrams(spark, sf_dir))
    p = letters.letter_probabilities(_p_on(spark, sf_dir), book(spark))
    return rounded(letters.weight_by_bigrams(p, grid), "p")


#: The best path to each letter of each place, by place; of equal steps the one from the first letter.
_VITERBI_SQL = _BIGRAM_SQL.replace("WITH", "WITH RECURSIVE", 1) + """,
k AS (SELECT letter, row_number() OVER (ORDER BY letter) AS k FROM (SELECT DISTINCT letter FROM b)),
moves AS (SELECT x.k AS a, y.k AS b, log10(grid.p) AS w FROM grid JOIN k x ON x.letter = grid.prev JOIN k y ON y.letter = grid.next),
s AS (SELECT run_id, pos, dense_rank() OVER (PARTITION BY run_id ORDER BY pos) AS i, k, letter, log10(p) AS s FROM p JOIN k USING (letter)),
v AS (SELECT run_id, i, k, s, [{'pos': pos, 'letter': letter}] AS path FROM s WHERE i = 1
  UNION ALL
  SELECT s.run_id, s.i, s.k, o.best.s + s.s, list_append(o.best.path, {'pos': s.pos, 'letter': s.letter})
  FROM (SELECT v.run_id, v.i + 1 AS i, m.b AS k, max({'s': v.s + m.w, 'k': -v.k, 'path': v.path}) AS best FROM v JOIN moves m ON m.a = v.k GROUP BY ALL) o
  JOIN s ON s.run_id = o.run_id AND s.i = o.i AND s.k = o.k),
best AS (SELECT run_id, i, max({'s': s, 'k': -k, 'path': path}) AS f FROM v GROUP BY run_id, i QUALIFY i = max(i) OVER (PARTITION BY run_id)),
u AS (SELECT run_id, unnest(f.path) AS c FROM best)
SELECT run_id, c.pos AS pos, c.letter AS letter FROM u"""


@query("viterbi_bigram", _VITERBI_SQL)
def viterbi_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.decode_letters(letters.letter_probabilities(_p_on(spark, sf_dir), book(spark)), role_bigrams(spark, sf_dir))


@query("viterbi_grammar")
def viterbi_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as words 'su', 'ua' and 'a' in any order; held against all paths in the tests."""
    nodes, edges = language.word_loop(spark, ["su", "ua", "a", "u"])
    lattice = decoding.Lattice.of(nodes, language.without_nulls(nodes, edges), {w: list(w) for w in ("su", "ua", "a", "u")})
    p = letters.letter_probabilities(_p_on(spark, sf_dir), book(spark))
    return decoding.decode_with_lattice(p, role_bigrams(spark, sf_dir), lattice, -0.5)


@query("grammar_long_run")
def grammar_long_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations one after another as one run, decoded along the same lattice in blocks of 64 places."""
    nodes, edges = language.word_loop(spark, ["su", "ua", "a", "u"])
    lattice = decoding.Lattice.of(nodes, language.without_nulls(nodes, edges), {w: list(w) for w in ("su", "ua", "a", "u")})
    p = letters.letter_probabilities(_p_on(spark, sf_dir), book(spark))
    one = p.select(F.lit(0).alias("run_id"), (F.col("run_id") * 100_000 + F.col("pos")).alias("pos"), "letter", "p")
    return decoding.decode_with_lattice(one, role_bigrams(spark, sf_dir), lattice, -0.5, block=64)


@query("lattice_closure", """WITH RECURSIVE e(src, dst) AS (VALUES (4, 0), (0, 1), (0, 2), (1, 0), (2, 0), (0, 3)), null_(id) AS (VALUES (0)),
p AS (SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM null_)
  UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src WHERE p.dst IN (SELECT id FROM null_))
SELECT DISTINCT src, dst FROM p WHERE dst NOT IN (SELECT id FROM null_)""")
def lattice_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = ["VERSION=1.0", "N=5 L=6", "I=0 W=!NULL", "I=1 W=yes", "I=2 W=no", "I=3 W=!NULL", "I=4 W=!NULL",
            *(f"J={k} S={s} E={d}" for k, (s, d) in enumerate([(4, 0), (0, 1), (0, 2), (1, 0), (2, 0), (0, 3)]))]
    nodes, edges = language.lattice(spark.createDataFrame([(t,) for t in text], "value string"))
    return language.without_nulls(nodes, edges)


@query("word_segments", """WITH c AS (SELECT item_id AS run_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS letter FROM benchmark WHERE length(text) > 0),
d AS (SELECT *, CASE WHEN lag(letter = ' ') OVER w IS NOT DISTINCT FROM (letter = ' ') THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY pos) - 1 AS word_idx FROM d)
SELECT run_id, word_idx::BIGINT AS word_idx, min(pos) AS start, string_agg(letter, '' ORDER BY pos) AS word FROM i GROUP BY ALL""")
def word_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("run_id"), F.posexplode(F.split("text", "")).alias("pos", "letter"))
    return letters.word_segments(chars.where("letter <> ''")).withColumn("start", F.col("start").cast("long"))


@query("text_segments", """SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), ' +|[^ ]+')) AS segments, md5(array_to_string(regexp_extract_all(coalesce(text, ''), ' +|[^ ]+'), '|')) AS digest FROM documents""")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = letters.words_of_text(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("segments"), F.md5(F.array_join(parts, "|").cast("binary")).alias("digest"))


_NGRAM_SQL = r"""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\x0c\r]+'), lambda q: q <> '') AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT unnest(t[:-2]) AS history, unnest(t[2:]) AS next FROM w WHERE len(t) >= 2),
n AS MATERIALIZED (SELECT history, next, count(*) AS count FROM g GROUP BY ALL)"""


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(language.tokens(F.col("text")).alias("tokens"))
    return language.ngram_counts(docs, 2)


@query("ngram_counts", _NGRAM_SQL + " SELECT * FROM n")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bigrams(spark, sf_dir)


@query("bigram_probs", _NGRAM_SQL + " SELECT history, next, round(log10(count / sum(count) OVER (PARTITION BY history)), 6) AS p FROM n")
def bigram_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(language.ngram_probabilities(_bigrams(spark, sf_dir), use_log=True), "p")


@query("bigram_discounted", _NGRAM_SQL + """,
cc AS (SELECT count AS r, count(*)::DOUBLE AS n FROM n WHERE count <= 8 GROUP BY count),
c AS (SELECT coalesce(8 * (SELECT n FROM cc WHERE r = 8), 0) / (SELECT n FROM cc WHERE r = 1) AS common),
d AS (SELECT a.r, ((a.r + 1) * b.n / a.n / a.r - common) / (1 - common) AS d FROM cc a JOIN cc b ON b.r = a.r + 1, c WHERE a.r <= 7 AND common <> 1),
w AS (SELECT history, next, count, count * CASE WHEN d.d > 0 AND d.d < 1 THEN d.d ELSE 1 END AS kept FROM n LEFT JOIN d ON d.r = n.count)
SELECT history, next, round(kept / sum(count) OVER (PARTITION BY history), 6) AS p,
  round(1 - sum(kept) OVER (PARTITION BY history) / sum(count) OVER (PARTITION BY history), 6) AS backoff FROM w""".replace("w AS (SELECT history", "kept AS (SELECT history").replace("FROM w", "FROM kept"))
def bigram_discounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities with the Good-Turing discount."""
    return rounded(language.discounted_probabilities(_bigrams(spark, sf_dir)), "p", "backoff")


@query("backoff_bigrams", _NGRAM_SQL + """,
cc AS (SELECT count AS r, count(*)::DOUBLE AS n FROM n WHERE count <= 8 GROUP BY count),
c AS (SELECT coalesce(8 * (SELECT n FROM cc WHERE r = 8), 0) / (SELECT n FROM cc WHERE r = 1) AS common),
d AS (SELECT a.r, ((a.r + 1) * b.n / a.n / a.r - common) / (1 - common) AS d FROM cc a JOIN cc b ON b.r = a.r + 1, c WHERE a.r <= 7 AND common <> 1),
kept AS (SELECT history, next, count, count * CASE WHEN d.d > 0 AND d.d < 1 THEN d.d ELSE 1 END AS kept FROM n LEFT JOIN d ON d.r = n.count),
two AS (SELECT history, next, kept / sum(count) OVER (PARTITION BY history) AS p, 1 - sum(kept) OVER (PARTITION BY history) / sum(count) OVER (PARTITION BY history) AS rest FROM kept),
uc AS (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM w) GROUP BY token),
one AS (SELECT token, n / (sum(n) OVER ())::DOUBLE AS p FROM uc),
bw AS (SELECT history, CASE WHEN 1 - sum(one.p) > 1e-12 THEN greatest(max(rest), 0) / (1 - sum(one.p)) ELSE 0 END AS weight FROM two JOIN one ON one.token = two.next GROUP BY history)
SELECT 1 AS "order", '' AS history, token AS next, round(p, 8) AS p, round(coalesce(weight, 1), 5) AS weight FROM one LEFT JOIN bw ON bw.history = token
UNION ALL SELECT 2, history, next, round(p, 8), NULL FROM two""")
def backoff_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(language.tokens(F.col("text")).alias("tokens"))
    return rounded(rounded(language.backoff_model(docs, 2), "p", digits=8), "weight", digits=5)


def _discount_sql(counts: str) -> str:
    """d1, d2, d3 of ``language.modified_discounts`` from a table with a column count."""
    of = lambda k: f"(SELECT count(*)::DOUBLE FROM {counts} WHERE count = {k})"
    return f"""SELECT CASE WHEN n1 > 0 AND n2 > 0 AND 1 - 2 * y * n2 / n1 > 0 AND 1 - 2 * y * n2 / n1 < 1 THEN 1 - 2 * y * n2 / n1 ELSE y END AS d1,
  CASE WHEN n2 > 0 AND n3 > 0 AND 2 - 3 * y * n3 / n2 > 0 AND 2 - 3 * y * n3 / n2 < 2 THEN 2 - 3 * y * n3 / n2 ELSE y END AS d2,
  CASE WHEN n3 > 0 AND n4 > 0 AND 3 - 4 * y * n4 / n3 > 0 AND 3 - 4 * y * n4 / n3 < 3 THEN 3 - 4 * y * n4 / n3 ELSE y END AS d3
  FROM (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END AS y FROM (SELECT {of(1)} AS n1, {of(2)} AS n2, {of(3)} AS n3, {of(4)} AS n4))"""


@query("interpolated_bigrams", _NGRAM_SQL + f""",
v AS (SELECT DISTINCT unnest(t) AS token FROM w),
k AS MATERIALIZED (SELECT next AS token, count(*) AS count FROM n GROUP BY next),
e1 AS ({_discount_sql("k")}), e2 AS ({_discount_sql("n")}),
t1 AS (SELECT token, count, CASE count WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d FROM k, e1),
g1 AS (SELECT sum(count) AS total, sum(d) / sum(count) AS gamma FROM t1),
one AS (SELECT v.token, coalesce((count - d) / total, 0) + gamma / (SELECT count(*) FROM v) AS p FROM v CROSS JOIN g1 LEFT JOIN t1 USING (token)),
t2 AS (SELECT history, next, count, CASE count WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d FROM n, e2),
g2 AS (SELECT history, sum(count) AS total, sum(d) / sum(count) AS gamma FROM t2 GROUP BY history)
SELECT 1 AS "order", '' AS history, token AS next, round(p, 8) AS p, round(coalesce(gamma, 1), 6) AS weight FROM one LEFT JOIN g2 ON g2.history = token
UNION ALL SELECT 2, t2.history, t2.next, round((count - d) / total + gamma * one.p, 8), NULL FROM t2 JOIN g2 USING (history) JOIN one ON one.token = t2.next""")
def interpolated_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interpolated model of order 2 with modified discounts; order 3 is held against sums in the tests."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(language.tokens(F.col("text")).alias("tokens"))
    return rounded(rounded(language.interpolated_model(docs, 2), "p", digits=8), "weight")


@query("softmax_letters", f"""WITH {LETTERS_SQL}, m AS (SELECT *, exp(ln(10) * (n / 1000::DOUBLE - max(n / 1000::DOUBLE) OVER (PARTITION BY run_id))) AS e FROM l)
SELECT run_id, pos, round(e / sum(e) OVER (PARTITION BY run_id), 6) AS p FROM m""")
def softmax_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = letter_rows(spark, sf_dir).withColumn("v", F.col("n") / 1000.0)
    return rounded(scalar.softmax(rows, "v", ["run_id"]).select("run_id", "pos", "p"), "p")


@query("context_letters", f"""WITH {LETTERS_SQL}
SELECT run_id, pos, coalesce(lag(letter) OVER w || '-', '') || letter || coalesce('+' || lead(letter) OVER w, '') AS context_token,
  letter AS centre FROM l WINDOW w AS (PARTITION BY run_id ORDER BY pos)""")
def context_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqloom.operators import hmm

    named = hmm.context_tokens(letter_rows(spark, sf_dir).withColumnRenamed("letter", "token"), run="run_id")
    return named.select("run_id", "pos", "context_token", scalar.centre_unit("context_token").alias("centre"))
