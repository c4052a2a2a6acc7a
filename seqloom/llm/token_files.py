"""Operator 1: token-id files in Simple-8b, in ascending order of documents.

A file is a folder of Parquet parts; each row is one block of whole documents: its part, its place
in the part, the ids of its documents, their lengths, the packed words and the marks of the spans.
Rows with equal or null ids are kept (nulls first), in the order of a hash of their texts; a null or
empty text has only the end id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm import simple8b
from seqloom.llm.common import texts
from seqloom.llm.vocabulary import library_cache

BLOCK = (
    "part int, block long, before long, doc_ids array<long>, lengths array<long>, n_ids long, "
    "words binary, marks binary"
)
#: A block is closed once it has so many ids; documents are never split.
BLOCK_IDS = 1 << 17


def write_token_files(
    df: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text, append ``end_id``, and write the blocks to ``path``.

    The texts are dealt out by ranges of the id and of a hash of the text, so parts follow each other in
    order, and rows without an id or with one id go to many parts unless their texts are equal too. Parts
    are written by Spark's committer: a lost executor's part is written again.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = library_cache(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        block, before, ids, lengths, held, part = 0, 0, [], [], [], 0

        def close():
            nonlocal block, before
            values = np.frombuffer(b"".join(held), dtype="<u4")
            words, marks = simple8b.encode(values)
            row = {
                "part": [part], "block": [block], "before": [before], "doc_ids": [list(ids)], "lengths": [list(lengths)],
                "n_ids": [len(values)], "words": [words.tobytes()], "marks": [marks.tobytes()],
            }
            block, before = block + 1, before + len(values)
            for x in (ids, lengths, held):
                x.clear()
            return pa.RecordBatch.from_pydict(row, schema=ARROW_BLOCK)

        n = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                for doc, data in zip(some.column(0).to_pylist(), cache.encode(some.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    lengths.append(len(data) // 4 + 1)
                    held += (data, end)
                    n += lengths[-1]
                    if n >= BLOCK_IDS:
                        yield close()
                        n = 0
        if ids:
            yield close()

    (
        texts(df, id_col, text_col)
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
        .mapInArrow(pack, BLOCK)
        .write.option("compression", "none")
        .parquet(path)
    )


ARROW_BLOCK = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("words", pa.binary()), ("marks", pa.binary()),
    ]
)
TOKENS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base``, the number of ids before each. There is one total for each part."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    # one small row for each part file: bounded by the number of files
    return blocks.join(F.broadcast(starts), "part").withColumn("base", F.col("part_start") + F.col("before"))


def _documents(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    words = np.frombuffer(row["words"], dtype="<u8")
    marks = np.frombuffer(row["marks"], dtype="<i8").reshape(-1, 2)
    ids = simple8b.decode(words, marks, row["n_ids"])
    at = 0
    for doc, length in zip(row["doc_ids"], row["lengths"], strict=True):
        yield doc, row["base"] + at, ids[at : at + length]
        at += length


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): ids as little-endian uint32; start is the number of ids before."""

    def unpack(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = [(d, s, i.astype("<u4").tobytes()) for d, s, i in _documents(batch.slice(k, 1).to_pylist()[0])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), TOKENS, strict=True)], schema=TOKENS)

    return _blocks(spark, path).mapInArrow(unpack, "doc_id long, start long, ids binary")


def summarise_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: start, n_tokens and the crc32 of the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def summarise(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                found = [
                    (d, s, len(i), zlib.crc32(i.astype("<u4").tobytes())) for d, s, i in _documents(batch.slice(k, 1).to_pylist()[0])
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema, strict=True)], schema=schema)

    return _blocks(spark, path).mapInArrow(summarise, "doc_id long, start long, n_tokens long, ids_crc32 long")
