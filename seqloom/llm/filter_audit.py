"""Operator 11: how five filters interact, in every order of them, from a histogram of failure masks.

Each document gets a mask of five bits, one for each filter that it fails, by built-in expressions:

    A  fewer than 100 words              C  over 10 % of the code points are A-Z
    B  under 80 % of the words distinct  D  a character of #$%&*|
    E  the text of a smaller doc_id, anywhere in the table

Documents of a part (a language) with one mask go the same way in every order, so all that an order does
to a part is told by 32 cells: how many documents have each mask, and how many of those are good or
toxic. The orders are enumerated from the cells; no document is read again for them.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import materialise

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
DUPLICATE = 1 << FILTERS.index("E")


def _bits(*failed: Column) -> Column:
    """A number whose bit k tells whether ``failed[k]`` holds."""
    found = F.lit(0)
    for k, f in enumerate(failed):
        found = found + F.when(f, 1 << k).otherwise(0)
    return found


def text_masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest of the text, and the bits of A to D: a row for each row of ``df``; a null text is empty."""
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # without white space at its ends, so that only an empty text leaves an empty word
    inner = F.btrim("text", F.lit(" \t\n\v\f\r"))
    words = docs.withColumn("words", F.split(inner, r"[\x20\x09-\x0D]+"))
    n_words = F.when(F.get("words", F.lit(0)) == "", 0).otherwise(F.size("words")).cast("long")
    counted = words.select(
        "doc_id", "part", "text", n_words.alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.char_length("text").cast("long").alias("n_chars"), F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_upper"),
    )
    mask = _bits(
        F.col("n_words") < 100,
        (F.col("n_words") > 0) & (100 * F.col("n_distinct") < 80 * F.col("n_words")),
        100 * F.col("n_upper") > 10 * F.col("n_chars"),
        F.col("text").rlike(r"[#$%&*|]"),
    )
    return counted.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def cells(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
    good_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """part, mask, n, good, toxic: the histogram, at most 32 rows for each part.

    Texts are told apart by their SHA-256. Copies are combined in each task before they are shuffled, and
    whether a row is the first of its text is found by its own id, not by the text: a third of all
    rows may have one text. A null id is smaller or greater than none, so such a row never fails E;
    nor do rows that repeat the smallest id. Of several labels of one id the largest counts.
    """
    masks = materialise(text_masks(df, id_col, text_col, part_col), "filter-masks")
    known = masks.where("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(good_col) == 1).alias("good"), (F.col(toxic_col) == 1).alias("toxic"))
    marks = marks.where("doc_id IS NOT NULL AND (good OR toxic)").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    told = known.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    mask = F.col("mask") + F.when(F.col("first"), 0).otherwise(DUPLICATE)
    one = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    without_id = masks.where("doc_id IS NULL").select("part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    rows = told.select("part", mask.alias("mask"), one("good"), one("toxic")).unionByName(without_id)
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(df: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    Counts are of documents of the part. kept: after this step; removed: by this step; redundant: failing
    this step's filter but gone before; unique_fails: failing no other filter; good_lost, toxic_lost: good
    or toxic ones removed here; shapley: what the step's filter removes, summed over all orders. A null
    part is the part ''. An empty table has no rows; documents without labels are neither good nor toxic.
    """
    found = cells(df, labels, **columns).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    steps = found.withColumn("filter_order", F.explode(F.lit(ORDERS)))
    steps = steps.select("*", F.posexplode(F.split("filter_order", "")).alias("gone", "letter"))
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("gone")), F.lit(0), lambda a, x: a + bit(x))
    steps = steps.withColumn("before", before).withColumn("bit", bit(F.col("letter")))

    def total(value: str, which) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda a, c: a + c[value])

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    counted = steps.select(
        "part", "filter_order", (F.col("gone") + 1).cast("int").alias("step"), "letter",
        total("n", lambda c: ~gone(c) & ~fails(c)).alias("kept"),
        total("n", lambda c: ~gone(c) & fails(c)).alias("removed"),
        total("n", lambda c: gone(c) & fails(c)).alias("redundant"),
        total("n", lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total("good", lambda c: ~gone(c) & fails(c)).alias("good_lost"),
        total("toxic", lambda c: ~gone(c) & fails(c)).alias("toxic_lost"),
    )
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")
