"""A pipeline from raw documents to token ids: each stage is one operator of ``seqloom.llm``.

A stage decides by a row's own text. Null and empty texts, null ids, repeated rows and ids, further
columns and empty tables go through every stage; what each stage does with them its function says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, decontamination, exact_dedup, ngram_join, toxicity
from seqloom.llm.common import materialise, table
from seqloom.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the factorisation machine (10) finds toxic; a null text is scored as empty."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (7). All null and empty texts are one group; rows with a null id stay."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (9). Empty texts, rows with a null id
    and rows that repeat the one that stays, stay."""
    return ngram_join.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold most of a benchmark item (2). Null and empty texts stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and the digests of ids and of the text decoded from them (5): a row for each row."""
    return bpe.digests(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe encoding", encode),
]

#: The first stage is a trained model, so no SQL gives the rows of ``run``; tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of ``documents``. Between stages they are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
