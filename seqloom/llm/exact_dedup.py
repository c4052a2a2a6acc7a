"""Operator 7: exact deduplication in skew-safe stages, with built-in functions only.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]. Of
equal texts the row with the most code points, then the smallest id, stays.

Stages: each task combines its own rows (Spark's partial aggregation); groups are split over salts
and combined; the winners of the salts are combined globally. In every stage the key holds the whole
normalised text beside its digest, so texts are compared as they are. The way back to the rows goes
by digest and salt, so that no task gets all rows of a large group; it is by the text as well for
digests that the last stage finds with several texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import if_small, materialise, texts

#: Shares into which each group is split by a hash of the row's id: one bit of a long for each.
SALTS = 64
#: More than the range of a long, so that (code points, id) order as one decimal.
_SPAN, _HALF = "18446744073709551616BD", "9223372036854775808BD"


def normalised(text: Column | str) -> Column:
    return F.translate(text, " \t\n\x0b\x0c\r", "")


def exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row for each row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; all empty texts are one group. Of rows with one id and equal texts
    of one length, exactly one is kept. A row with a null id comes after rows with ids of the same
    length; if it stays, keep_id is null. Other columns are ignored. ``digest`` makes the key that
    stands before the text, SHA-256 if None; a weak one changes the work, not the result.
    """
    docs = texts(df, id_col, text_col).withColumn("norm", normalised("text"))
    n_chars = F.char_length("text")
    no_id = F.lit(2**63 - 1)
    rank = n_chars.cast("decimal(38,0)") * F.expr(_SPAN) - F.coalesce(F.col("doc_id"), no_id).cast("decimal(38,0)")
    sha = F.unhex(F.sha2("norm", 256))
    rows = docs.select(
        "doc_id",
        sha.alias("sha"),
        (digest(F.col("norm")) if digest else sha).alias("digest"),
        rank.alias("rank"),
        F.pmod(F.xxhash64("doc_id", n_chars), F.lit(SALTS)).cast("int").alias("salt"),
        "norm",
    )
    # rows of one digest and text, combined in each task and then by salt
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    # the winners of the salts, combined globally; the salts that occur are bits of one long
    final = salted.groupBy("digest", "norm").agg(
        F.max("rank").alias("best"), F.sum("n").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    )
    winners = materialise(final.drop("norm"), "winners")
    thin = rows.drop("norm")
    # digests of several texts, if there are any: their rows go back by the text itself
    several = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("digest")
    if several.isEmpty():
        back = thin.join(_by_salt(winners), ["digest", "salt"])
    else:
        of_text = rows.join(several, "digest", "left_semi").join(final.join(several, "digest", "left_semi").drop("salts"), ["digest", "norm"]).drop("norm")
        single = thin.join(_by_salt(winners.join(several, "digest", "left_anti")), ["digest", "salt"])
        back = single.unionByName(of_text)
    code_points = F.expr(f"(best + {_HALF}) div {_SPAN}")
    keep = (code_points.cast("decimal(38,0)") * F.expr(_SPAN) - F.col("best")).cast("long")
    same = Window.partitionBy("doc_id", "sha", "rank").orderBy(F.lit(1))
    return back.withColumn("copy", F.row_number().over(same)).select(
        "doc_id",
        F.when(keep != no_id, keep).alias("keep_id"),
        "group_size",
        ((F.col("rank") == F.col("best")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _by_salt(winners: DataFrame) -> DataFrame:
    """A row for each salt that a group has."""
    salts = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(salts, s) = 1)")
    return winners.select("digest", "best", "group_size", F.explode(salts).alias("salt"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that ``exact_duplicates`` keeps, with all their columns.

    Rows with a null id can't be told apart by it and stay. Of several rows with one id those stay
    whose texts do, one row for each text. A null text is an empty one, and one of these stays.
    """
    found = materialise(exact_duplicates(df, id_col, text_col).select("doc_id", "kept", "text_sha256"), "copies")
    by_id = found.groupBy("doc_id").agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("n")).where("NOT any_kept OR n > 1")
    special = materialise(by_id.select(F.col("doc_id").alias("__id"), "any_kept"), "copies")
    of_id = F.col(id_col).cast("long") == F.col("__id")
    plain = df.join(if_small(special.drop("any_kept")), of_id, "left_anti")
    # ids of several rows: of each kept text the longest row stays
    repeated = special.where("any_kept").drop("any_kept")
    if repeated.isEmpty():
        return plain
    repeated = df.join(if_small(repeated), of_id)
    repeated = repeated.withColumn("__sha", F.sha2(normalised(F.coalesce(F.col(text_col), F.lit(""))), 256))
    order = Window.partitionBy("__id", "__sha").orderBy(F.char_length(F.coalesce(F.col(text_col), F.lit(""))).desc())
    repeated = repeated.withColumn("__place", F.row_number().over(order)).where("__place = 1")
    kept = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    return plain.unionByName(repeated.join(kept, ["__id", "__sha"], "left_semi").select(*df.columns))
