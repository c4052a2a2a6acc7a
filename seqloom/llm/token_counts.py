"""Operator 3: lengths of documents in flat, unindexed token files.

A file is a run of ids (little-endian uint32) with an end id after each document, cut into blocks
of a fixed size wherever that falls. Each block is searched on its own; a prefix scan over the
blocks of a file (in two levels, so that a file of very many blocks is not one task's) tells where
a document began that an earlier block opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import materialise, texts
from seqloom.llm.vocabulary import library_cache

FLAT = "kind string, file int, block long, payload binary, doc_no long, doc_id long"
_FLAT = pa.schema(
    [("kind", pa.string()), ("file", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("doc_no", pa.int64()), ("doc_id", pa.int64())]
)
#: Blocks of a file that one row of the upper level of the scan stands for.
FAN = 512


def write_flat_tokens(
    df: DataFrame, path: str, tokenizer_path: str, end_id: int, block_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write each partition's texts as one flat file in rows of kind tokens, and in rows of kind names
    the id of each document by its place in the file (no offsets or lengths).

    Markers of the tokenizer that stand in a text are encoded as ordinary text, so that only the
    ends of documents have ``end_id``. A null or empty text is a document without ids. Repeated rows
    and ids are documents of their own, a null id stays null; an empty table gives no rows. Other
    columns are ignored.
    """

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # fewer pieces than elsewhere: blocks, texts and pieces are in memory together
        cache = library_cache(tokenizer_path, specials_as_text=True, limit=200_000)
        end = np.array([end_id], dtype="<u4").tobytes()
        rest, block, doc_no, file = b"", 0, 0, 0

        def tokens(payload):
            nonlocal block
            block += 1
            return pa.RecordBatch.from_pydict(
                {"kind": ["tokens"], "file": [file], "block": [block - 1], "payload": [payload], "doc_no": [None], "doc_id": [None]}, schema=_FLAT
            )

        for batch in batches:
            if batch.num_rows:
                file = batch.column(2)[0].as_py()
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                docs = some.column(0).to_pylist()
                rest += b"".join(x for data in cache.encode(some.column(1).to_pylist()) for x in (data, end))
                n = len(docs)
                yield pa.RecordBatch.from_pydict(
                    {"kind": ["names"] * n, "file": [file] * n, "block": [None] * n, "payload": [None] * n, "doc_no": list(range(doc_no, doc_no + n)), "doc_id": docs},
                    schema=_FLAT,
                )
                doc_no += n
                whole = len(rest) - len(rest) % block_bytes
                for at in range(0, whole, block_bytes):
                    yield tokens(rest[at : at + block_bytes])
                rest = rest[whole:]
        if rest:
            yield tokens(rest)

    out = texts(df, id_col, text_col).withColumn("file", F.spark_partition_id()).mapInArrow(flatten, FLAT)
    # not partitioned by kind: that would sort the blocks; who reads one kind skips the other's columns
    out.write.option("compression", "zstd").parquet(path)


#: Where documents end in a block, and where they begin (-1: before the block).
_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_SCAN = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("n_ends", pa.int64()), ("last_end", pa.int64()), ("spans", _SPANS)])


def count_tokens(blocks: DataFrame, end_id: int) -> DataFrame:
    """``blocks`` (file int, block long, payload binary) to (file, doc_no, start, n_tokens, closed).

    n_tokens leaves out the end id. Ids after the last end id of a file are one more document with
    closed = false. A null or empty payload is a block without ids; a file without ids gives no row.
    """

    def scan(batches):
        for batch in batches:
            counts, ends = [], []
            for payload in batch.column(2):
                # a view of the batch, not a copy
                ids = np.frombuffer(payload.as_buffer(), dtype="<u4") if payload.is_valid else np.zeros(0, "<u4")
                counts.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            n_ends = np.array([len(e) for e in ends], dtype=np.int64)
            begins = [np.concatenate([[-1], e[:-1] + 1]) if len(e) else e for e in ends]
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (begins, ends)], fields=list(_SPANS.value_type))
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ends)]).astype(np.int32)), flat)
            last = pa.array([int(e[-1]) if len(e) else None for e in ends], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(n_ends), last, spans], schema=_SCAN)

    scanned = blocks.select(F.col("file").cast("int"), F.col("block").cast("long"), "payload").mapInArrow(
        scan, "file int, block long, n_ids long, n_ends long, last_end long, spans array<struct<begin: long, end: long>>"
    )
    # the blocks are searched once; what follows reads the ends alone
    scanned = materialise(scanned, "document-ends").withColumn("upper", F.floor(F.col("block") / FAN))
    # ids and ends so far, and the last end, before each block: first within its group of blocks
    inner = Window.partitionBy("file", "upper").orderBy("block")
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    local = scanned.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    local = local.withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    local = local.withColumn("last", F.col("ids_before") + F.col("last_end"))
    local = local.withColumn("open", F.last("last", ignorenulls=True).over(before))
    # then of the groups, one row each
    groups = local.groupBy("file", "upper").agg(F.sum("n_ids").alias("g_ids"), F.sum("n_ends").alias("g_ends"), F.max("last").alias("g_last"))
    outer = Window.partitionBy("file").orderBy("upper")
    earlier = outer.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("ids0", F.coalesce(F.sum("g_ids").over(earlier), F.lit(0)))
    groups = groups.withColumn("ends0", F.coalesce(F.sum("g_ends").over(earlier), F.lit(0)))
    groups = groups.withColumn("open0", F.last(F.col("ids0") + F.col("g_last"), ignorenulls=True).over(earlier))
    groups = groups.withColumn("final", F.lead("upper").over(outer).isNull())
    both = local.join(groups.select("file", "upper", "ids0", "ends0", "open0", "final"), ["file", "upper"])
    both = both.withColumn("base", F.col("ids0") + F.col("ids_before"))
    opened = F.coalesce(F.col("ids0") + F.col("open"), F.col("open0"), F.lit(-1)) + 1
    both = both.withColumn("opened", opened).withColumn("doc0", F.col("ends0") + F.col("ends_before"))
    closed = both.select("file", "doc0", "base", "opened", F.posexplode("spans").alias("k", "span")).select(
        "file",
        (F.col("doc0") + F.col("k")).alias("doc_no"),
        F.when(F.col("k") == 0, F.col("opened")).otherwise(F.col("base") + F.col("span.begin")).alias("start"),
        (F.col("base") + F.col("span.end")).alias("stop"),
        F.lit(True).alias("closed"),
    )
    # what is left after the last end of a file
    tail = groups.where("final").select(
        "file",
        (F.col("ends0") + F.col("g_ends")).alias("doc_no"),
        (F.coalesce(F.col("ids0") + F.col("g_last"), F.col("open0"), F.lit(-1)) + 1).alias("start"),
        (F.col("ids0") + F.col("g_ids")).alias("stop"),
        F.lit(False).alias("closed"),
    )
    found = closed.unionByName(tail.where("stop > start"))
    return found.select("file", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")
