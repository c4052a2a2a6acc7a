"""Operator 10: toxicity by a factorisation machine over hashed terms.

The factors let a pair of terms (an insult and the mention of a group) weigh more than its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqloom.llm import factorization

MODULUS, REMAINDER, THRESHOLD = 3, 1, 0.7


def score_toxicity(df: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``df``. Of its columns only doc_id and
    text are read; of ``labels`` doc_id and toxic.

    A null text is scored as an empty one. A null id stays null; repeated rows and ids are scored
    each by its own text. ``max_rows`` bounds the sample that is learned from, nothing else."""
    return factorization.classify(df, _model(df, labels, max_rows), MODULUS, REMAINDER, THRESHOLD, n_chars_col=None)


def reject_toxic(df: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """The rows of ``df`` that ``score_toxicity`` predicts 0 for, with all their columns.

    Each row goes by its own text, whatever its id; a null or empty text is scored like any other."""
    return factorization.below(df, _model(df, labels, max_rows), THRESHOLD)


def _model(df: DataFrame, labels: DataFrame, max_rows: int) -> factorization.Model:
    return factorization.fit_on_labels(df, labels, "toxic", MODULUS, REMAINDER, max_rows, with_stats=False, n_chars_col=None)
