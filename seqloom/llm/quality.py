"""Operator 4: quality by a factorisation machine over terms, structure statistics and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqloom.llm import factorization

MODULUS, REMAINDER, THRESHOLD = 4, 2, 0.7


def score_quality(df: DataFrame, labels: DataFrame, max_rows: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``df``. Of its columns only doc_id, text
    and, if there, n_chars are read; of ``labels`` doc_id and quality.

    A null text is scored as an empty one, a null n_chars is the length of the text. A null id stays
    null; repeated rows and ids are scored each by its own text. ``max_rows`` bounds the sample that
    is learned from, nothing else."""
    model = factorization.fit_on_labels(df, labels, "quality", MODULUS, REMAINDER, max_rows)
    return factorization.classify(df, model, MODULUS, REMAINDER, THRESHOLD)
