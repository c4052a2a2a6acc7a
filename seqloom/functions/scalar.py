"""Scalar column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.arrays import ColumnOrName, col

_FWHM = math.sqrt(8 * math.log(2))
#: Fixed values of the saturation curve: its share of the response left after one second, and its decay.
SATURATION_LEFT, SATURATION_DECAY = 0.6658, 0.7


def sigma_to_fwhm(sigma: ColumnOrName) -> Column:
    return col(sigma) * F.lit(_FWHM)


def fwhm_to_sigma(fwhm: ColumnOrName) -> Column:
    return col(fwhm) / F.lit(_FWHM)


def saturation(lag_s: ColumnOrName, decay: float = SATURATION_DECAY) -> Column:
    """Weight by which a stimulus ``lag_s`` seconds ago lowers the response to one now."""
    return F.lit(1 - SATURATION_LEFT) * F.exp(-F.lit(decay) * (col(lag_s) - 1))


def log10_or_minus_infinity(p: ColumnOrName) -> Column:
    """log10 with log10(0) = -inf, where Spark's own gives null; null stays null, below 0 is NaN."""
    return (
        F.when(col(p) == 0, F.lit(float("-inf"))).when(col(p) < 0, F.lit(float("nan"))).otherwise(F.log10(col(p)))
    )


def softmax(df: DataFrame, value: str, by: list[str], base: float = 10.0, out: str = "p") -> DataFrame:
    """base**x normalised over the rows of each key; the largest value is taken off first."""
    w = Window.partitionBy(*by)
    power = F.exp(F.lit(math.log(base)) * (F.col(value) - F.max(value).over(w)))
    return df.withColumn(out, power).withColumn(out, F.col(out) / F.sum(out).over(w))


def bits_per_selection(n_choices: ColumnOrName, accuracy: ColumnOrName) -> Column:
    """Information of one selection among N with accuracy P; terms 0 log 0 count as 0."""
    n, p = col(n_choices), col(accuracy)
    plogp = lambda x, y: F.when(x > 0, x * F.log2(y)).otherwise(F.lit(0.0))
    return F.log2(n) + plogp(p, p) + plogp(1 - p, (1 - p) / F.nullif(n - 1, F.lit(0)))


def centre_unit(name: ColumnOrName) -> Column:
    """The centre of a context name: l-c+r, l-c, c+r or c gives c."""
    return F.regexp_replace(F.regexp_replace(col(name), r"^[^-]*-", ""), r"\+.*$", "")


def letter_from_mark(letter: ColumnOrName, mark: str = "_") -> Column:
    """The mark that stands for a space in files becomes a space."""
    return F.when(col(letter) == mark, F.lit(" ")).otherwise(col(letter))


def space_to_token(letter: ColumnOrName, token: str = "_space_") -> Column:
    return F.when(col(letter) == " ", F.lit(token)).otherwise(col(letter))


def token_to_space(letter: ColumnOrName, token: str = "_space_") -> Column:
    return F.when(col(letter) == token, F.lit(" ")).otherwise(col(letter))


def padded_stimulus(phrases: ColumnOrName, before: int, word: int, phrase: int, after: int) -> Column:
    """Phrases as one letter sequence with pauses as spaces.

    ``before`` spaces, the phrases with ``word`` spaces between words and ``phrase`` after each
    phrase; the end then holds exactly ``after`` spaces.
    """
    spaced = F.transform(
        col(phrases), lambda p: F.concat(F.array_join(F.split(p, " "), " " * word), F.lit(" " * phrase))
    )
    return F.concat(F.lit(" " * before), F.rtrim(F.array_join(spaced, "")), F.lit(" " * after))
