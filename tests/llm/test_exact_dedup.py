import hashlib
import re

from pyspark.sql import functions as F

from seqloom.llm.exact_dedup import exact_duplicates

ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, " a b"), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r"), (8, "a\xa0b"), (9, "\x1cab"),
    (-5, "a  b"), (None, "zz"), (None, "z  z"), (10, "zz"), (11, "x" * 100_000), (12, "x" * 99_999 + " x"), (13, "A b"),
    (20, "same"), (20, "same"), (21, "same"), (2**40, "zz"),
] + [(100 + i, "hot text") for i in range(500)]


def brute(rows):
    groups = {}
    for d, t in rows:
        t = t or ""
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t), []).append((-len(t), d is None, d or 0, d))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        sha, used = hashlib.sha256(norm.encode()).hexdigest(), False
        for m in members:
            kept = m == best and not used
            used |= kept
            out.append((m[3], best[3], len(members), kept, sha))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 3) for r in ROWS], "doc_id long, text string, digest string, salt int").repartition(7)
    assert sorted(map(tuple, exact_duplicates(df).collect()), key=str) == brute(ROWS)


def test_a_weak_digest_gives_the_same(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    found = exact_duplicates(df, digest=lambda c: F.length(c) % 2)
    assert sorted(map(tuple, found.collect()), key=str) == brute(ROWS)


def test_texts_of_one_digest_stay_apart(spark):
    """With a digest that says nothing every row goes back by its text; so it does for part of them."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(7)
    for digest in (lambda c: F.lit(1), lambda c: F.when(F.length(c) < 3, F.lit("short")).otherwise(F.sha2(c, 256))):
        assert sorted(map(tuple, exact_duplicates(df, digest=digest).collect()), key=str) == brute(ROWS)


def test_empty_table_and_plan(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert exact_duplicates(df.where("false")).collect() == []
    plan = exact_duplicates(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
