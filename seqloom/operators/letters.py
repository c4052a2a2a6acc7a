"""Letters, words, code books and the probabilities of letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = "run_id"


def _order(*keys: str) -> Window:
    return Window.partitionBy(RUN, *keys).orderBy("pos")


def transition_labels(letters: DataFrame, book: DataFrame) -> DataFrame:
    """run_id, pos, region, transition: 2 * bit of the letter before + bit of the letter, for each region.

    The first letter of a run has no row. ``book`` (letter, region, bit) is as small as its alphabet.
    """
    bits = letters.join(book, "letter")
    before = F.lag("bit").over(_order("region"))
    return bits.withColumn("transition", before * 2 + F.col("bit")).where("transition IS NOT NULL").select(RUN, "pos", "region", "transition")


def transition_states(transitions: DataFrame) -> DataFrame:
    """Bits of every letter as the transitions show them: ``bit_before`` from the transition that leaves
    the letter, ``bit_after`` from the one that enters it; at the ends of a run the other one's."""
    first = F.min("pos").over(Window.partitionBy(RUN, "region"))
    opening = transitions.withColumn("__first", first).where("pos = __first").select(
        RUN, (F.col("pos") - 1).alias("pos"), "region", F.lit(None).cast("int").alias("transition")
    )
    rows = transitions.select(RUN, "pos", "region", F.col("transition").cast("int").alias("transition")).unionByName(
        opening.select(RUN, "pos", "region", "transition")
    )
    leaving = F.lead("transition").over(_order("region"))
    out = rows.withColumn("__next", leaving)
    before, after = F.expr("__next div 2"), F.expr("transition % 2")
    return out.select(
        RUN, "pos", "region", F.coalesce(before, after).cast("int").alias("bit_before"), F.coalesce(after, before).cast("int").alias("bit_after")
    )


def letters_from_bits(bits: DataFrame, book: DataFrame, bit: str = "bit_before", unknown: str = "?") -> DataFrame:
    """run_id, pos, letter: the letter whose bits, in the order of regions, are these; else ``unknown``."""
    key = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", F.col(bit).alias("b")))), lambda s: s["b"].cast("string")), "")
    seen = bits.groupBy(RUN, "pos").agg(key.alias("bits"))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "bit"))), lambda s: s["bit"].cast("string")), "")
    inverse = book.groupBy("letter").agg(words.alias("bits")).groupBy("bits").agg(F.max("letter").alias("letter"))
    return seen.join(inverse, "bits", "left").select(RUN, "pos", F.coalesce("letter", F.lit(unknown)).alias("letter"))


def on_probabilities(transitions: DataFrame, last_in_first: bool = False) -> DataFrame:
    """run_id, pos, region, p_on from the four class probabilities p0..p3 of each transition.

    A letter is on with p2 + p3 of the transition that leaves it and p1 + p3 of the one that enters
    it; the mean counts, at the ends of a run the one there is. ``last_in_first`` gives the run's last
    transition in place of the missing one at its beginning.
    """
    w, whole = _order("region"), Window.partitionBy(RUN, "region")
    rows = transitions.select(RUN, "pos", "region", (F.col("p2") + F.col("p3")).alias("off"), (F.col("p1") + F.col("p3")).alias("on"))
    marked = rows.withColumn("__first", F.min("pos").over(whole)).withColumn("__last_off", F.last("off").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    opening = marked.where("pos = __first").select(
        RUN, (F.col("pos") - 1).alias("pos"), "region", F.lit(None).cast("double").alias("off"), F.lit(None).cast("double").alias("on"), "__last_off"
    )
    every = marked.drop("__first").unionByName(opening)
    leaving = F.lead("off").over(w)
    entering = F.coalesce(F.col("on"), F.col("__last_off") if last_in_first else leaving)
    return every.select(RUN, "pos", "region", ((F.coalesce(leaving, F.col("on")) + entering) / 2).alias("p_on"))


def letter_probabilities(p_on: DataFrame, book: DataFrame) -> DataFrame:
    """run_id, pos, letter, p: the product over regions of p_on where the letter has the bit, else 1 - p_on."""
    factor = F.when(F.col("bit") == 1, F.col("p_on")).otherwise(1 - F.col("p_on"))
    joined = p_on.join(book, "region")
    return joined.groupBy(RUN, "pos", "letter").agg(F.product(factor).alias("p"))


def most_probable(probabilities: DataFrame) -> DataFrame:
    """The letter of the highest probability at each place; of equals the first in order."""
    best = F.max(F.struct("p", F.struct((-F.ascii("letter")).alias("o"), "letter").alias("l")))
    return probabilities.groupBy(RUN, "pos").agg(best.alias("b")).select(RUN, "pos", F.col("b.l.letter").alias("letter"), F.col("b.p").alias("p"))


def bigram_grid(letters: DataFrame, bigrams: DataFrame, default: Column | None = None) -> DataFrame:
    """(prev, next, p) for all pairs of letters; pairs that ``bigrams`` lacks get the smallest positive p.

    Both are as small as an alphabet allows.
    """
    least = bigrams.where("p > 0").agg(F.min("p").alias("__least"))
    prev, nxt = letters.select(F.col("letter").alias("prev")).distinct(), letters.select(F.col("letter").alias("next")).distinct()
    grid = prev.crossJoin(F.broadcast(nxt)).crossJoin(F.broadcast(least))
    return grid.join(bigrams, ["prev", "next"], "left").select("prev", "next", F.coalesce("p", default if default is not None else F.col("__least")).alias("p"))


def weight_by_bigrams(probabilities: DataFrame, grid: DataFrame) -> DataFrame:
    """p of each letter times what the unweighted probabilities one place before lead to; the first
    place stays. Not normalised."""
    moved = probabilities.select(RUN, (F.col("pos") + 1).alias("pos"), F.col("letter").alias("prev"), F.col("p").alias("__p"))
    led = moved.join(grid.withColumnRenamed("p", "__b"), "prev").groupBy(RUN, "pos", F.col("next").alias("letter")).agg(
        F.sum(F.col("__p") * F.col("__b")).alias("__led")
    )
    joined = probabilities.join(led, [RUN, "pos", "letter"], "left")
    return joined.select(RUN, "pos", "letter", (F.col("p") * F.coalesce("__led", F.lit(1.0))).alias("p"))


def word_segments(letters: DataFrame) -> DataFrame:
    """Runs of letters between spaces as words: run_id, word_idx, start, word; spaces are words of spaces."""
    w = _order()
    is_space = F.col("letter") == " "
    change = F.when(F.lag(is_space).over(w).eqNullSafe(is_space), 0).otherwise(1)
    islands = letters.withColumn("__c", change).withColumn("word_idx", F.sum("__c").over(w) - 1)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda s: s["letter"])
    return islands.groupBy(RUN, "word_idx").agg(F.min("pos").alias("start"), F.array_join(in_order, "").alias("word"))


def words_of_text(text: Column) -> Column:
    """A text's segments, words and spaces in turn, as one array, without a shuffle."""
    return F.regexp_extract_all(text, F.lit(" +|[^ ]+"), F.lit(0))
