"""Operator 12: vectors as codes of four bytes, by codebooks of integers for each part of a vector.

Components become integers, so that distances, sums and ties are the same wherever a row is computed.
Codebooks (parts x entries x components) are broadcast; each task computes the distances of its Arrow
batches to all entries as |a|^2 - 2 a.b + |b|^2 with exact products, takes the first least one, and sends
a count and sums of each entry. These are merged by one grouped shuffle a round, and only the merged
sums, as large as the codebooks, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import if_small, materialise

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Greatest component: with it distances stay below 2^63 in parts of up to 32 components, and below 2^53 mostly.
LARGEST = 1 << 28
#: Rows whose distances to all entries are held at once.
ROWS = 4096


def _integers(scale: int):
    """(id, label, vector) to (id, label, size, cells): rows with a null or non-finite component go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(batch.column(2).is_valid())
            vectors = some.column(2)
            size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are nan
            row = np.repeat(np.arange(len(size)), size)
            keep = np.bincount(row, ~np.isfinite(flat), len(size)) == 0
            flat, size, some = flat[keep[row]], size[keep], some.filter(pa.array(keep))
            with np.errstate(over="ignore"):
                whole = np.floor(scale * flat)
            row, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
            fits = np.bincount(row, np.abs(whole) > LARGEST, len(size)) == 0
            small = np.clip(whole, -LARGEST, LARGEST).astype("<i4")
            cells = [small[e - n : e].tobytes() if f else None for e, n, f in zip(ends.tolist(), size.tolist(), fits.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(size.astype(np.int32)), pa.array(cells, pa.binary())], names=["vec_id", "label", "size", "cells"])

    return run


def _cut(cells: list[bytes], size: int, parts: int) -> np.ndarray:
    """rows x parts x components; a size that isn't a multiple of the parts is filled up with zeros."""
    width = -(-size // parts)
    flat = np.frombuffer(b"".join(cells), "<i4").reshape(len(cells), size).astype(np.int64)
    return np.pad(flat, ((0, 0), (0, width * parts - size))).reshape(len(cells), parts, width)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer matrices; in doubles where no sum of them can pass 2^53, which is much faster."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row of ``part``, and its squared distance."""
    far = (part * part).sum(axis=1)[:, None] - 2 * _products(part, book.T) + (book * book).sum(axis=1)[None, :]
    entry = far.argmin(axis=1)
    return entry, far[np.arange(len(part)), entry]


def _summed(books, size: int):
    """Count and sums of the rows of each entry: one row for each entry of a part that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_books = books.value
        counts, sums = np.zeros(all_books.shape[:2], np.int64), np.zeros(all_books.shape, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                cut = _cut(batch.column(0).slice(lo, ROWS).to_pylist(), size, len(all_books))
                for p, book in enumerate(all_books):
                    entry, _ = nearest(cut[:, p], book)
                    order = np.argsort(entry, kind="stable")
                    met, first = np.unique(entry[order], return_index=True)
                    counts[p, met] += np.diff(np.append(first, len(entry)))
                    sums[p, met] += np.add.reduceat(cut[order, p], first, axis=0)
        part, entry = np.nonzero(counts)
        columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "count", "sums"])

    return run


def _moved(usable: DataFrame, books: np.ndarray, size: int) -> np.ndarray:
    """The codebooks after one round: each entry is the floor of the mean of the parts assigned to it."""
    shared = usable.sparkSession.sparkContext.broadcast(books)
    rows = usable.select("cells").mapInArrow(_summed(shared, size), "part int, entry int, count long, sums array<long>")
    merged = rows.select("part", "entry", "count", F.posexplode("sums").alias("place", "value"))
    merged = merged.groupBy("part", "entry", "place").agg(F.sum("count").alias("count"), F.sum("value").alias("value")).toArrow()
    part, entry, place, count, value = (merged.column(c).to_numpy() for c in ("part", "entry", "place", "count", "value"))
    found = books.copy()
    found[part, entry, place] = value // count
    shared.unpersist()
    return found


def fit_codebooks(cells: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Codebooks (parts x entries x components) and the size of the vectors that they are for: that of the
    vector with the smallest id. With fewer vectors than ``entries`` there are as many entries as vectors."""
    order = [F.asc_nulls_last("vec_id"), F.asc("size"), F.asc("cells")]
    usable = cells.where("cells IS NOT NULL")
    first = usable.orderBy(*order).select("size").first()
    size = first[0] if first else 0
    usable = usable.where(F.col("size") == size)
    start = [bytes(r[0]) for r in usable.orderBy(*order).limit(entries).select("cells").collect()]
    books = np.ascontiguousarray(_cut(start, size, parts).transpose(1, 0, 2))
    for _ in range(rounds if start else 0):
        books = _moved(usable, books, size)
    return books, size


def _coded(books, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_books = books.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                codes, errors = [None] * some.num_rows, [None] * some.num_rows
                cells = some.column(3).to_pylist()
                at = [k for k, (c, n) in enumerate(zip(cells, some.column(2).to_pylist(), strict=True)) if c is not None and n == size]
                if at:
                    cut = _cut([cells[k] for k in at], size, len(all_books))
                    entry, far = (np.stack(x, axis=1) for x in zip(*(nearest(cut[:, p], book) for p, book in enumerate(all_books)), strict=True))
                    for k, e, d in zip(at, entry.astype(np.int64).tolist(), far.sum(axis=1).tolist(), strict=True):
                        codes[k], errors[k] = "".join(f"{x:02x}" for x in e), d
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place, as decimal numbers with commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def integer_cells(df: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, size, cells (floor(scale * x) as 32-bit numbers) of the vectors that stay; cells are
    null where a component passes LARGEST."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    schema = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("size", T.IntegerType()), T.StructField("cells", T.BinaryType())])
    return rows.mapInArrow(_integers(scale), schema)


def compress(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: a row for each vector that stays.

    Vectors that are null or hold null or non-finite components go. The codebooks start as the parts of
    the vectors with the smallest ids (rows that repeat an id count each, in order of their components;
    null ids come last) and move ``rounds`` times. Code and error are null for vectors of another
    size than that with the smallest id, and for those with a component beyond LARGEST / scale: neither
    takes part in the codebooks. A size that is no multiple of ``parts`` is filled up with zeros. Null labels
    are one label. An empty table has no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number is one byte: entries must be 1 to 256")
    cells = materialise(integer_cells(df, scale, id_col, vector_col, label_col), "vector-cells")
    books, size = fit_codebooks(cells, parts, entries, rounds)
    shared = df.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([cells.schema["vec_id"], cells.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = materialise(cells.mapInArrow(_coded(shared, size), schema), "vector-codes")
    totals = materialise(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    found = coded.join(if_small(totals), F.col("label").eqNullSafe(F.col("of_label")))
    return found.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
