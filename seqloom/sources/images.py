"""Volumes in NIfTI-1 files, feature files and label files, read from bytes in tasks.

Files are read by Spark's ``binaryFile``, so they may lie in any store that Spark reads.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed codes of number formats in a header.
_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER = "path string, nx int, ny int, nz int, n_frames int, dx double, dy double, dz double, frame_s double"


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def header_of(raw: bytes) -> tuple[str, tuple, tuple, str, int, float, float]:
    """Byte order, sizes, spacings, number format, offset, slope, intercept."""
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", raw[40:56])
    pixdim = struct.unpack(order + "8f", raw[76:108])
    kind = _TYPES[struct.unpack(order + "h", raw[70:72])[0]]
    offset, slope, intercept = struct.unpack(order + "3f", raw[108:120])
    return order, dim, pixdim, kind, int(offset), slope, intercept


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image: its sizes, the spacing in mm and the time of a frame in s."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                _, dim, pixdim, *_ = header_of(_plain(bytes(content))[:352])
                rows.append((p, *(int(d) for d in dim[1:4]), int(dim[4]) if dim[0] > 3 else 1, *(float(x) for x in pixdim[1:5])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, HEADER)


def read_images(spark: SparkSession, path: str, skip_zero: bool = False) -> DataFrame:
    """Cells path, x, y, z, frame, value of all images; one frame is decoded at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                raw = _plain(bytes(content))
                order, dim, _, kind, offset, slope, intercept = header_of(raw)
                nx, ny, nz = dim[1:4]
                kind = np.dtype(order + kind)
                x, y, z = (a.ravel(order="F") for a in np.indices((nx, ny, nz)))
                for t in range(dim[4] if dim[0] > 3 else 1):
                    v = np.frombuffer(raw, kind, nx * ny * nz, offset + t * nx * ny * nz * kind.itemsize).astype(float)
                    v = v * slope + intercept if slope else v
                    keep = v != 0 if skip_zero else np.ones(len(v), dtype=bool)
                    yield pd.DataFrame({"path": p, "x": x[keep], "y": y[keep], "z": z[keep], "frame": t, "value": v[keep]})

    schema = "path string, x int, y int, z int, frame int, value double"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature files: path, period, frames array<array<float>>."""
    return features_of(spark.read.format("binaryFile").load(path).select("path", "content"), "path")


def features_of(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, period, frames of the bytes of feature files. A header of >IIHH is followed by floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, raw in zip(batch[key], batch[content], strict=True):
                n, period, size, _ = struct.unpack(">IIHH", bytes(raw)[:12])
                rows.append((p, period, [list(r) for r in np.frombuffer(raw, ">f4", n * size // 4, 12).reshape(n, -1).astype("f4")]))
            yield pd.DataFrame(rows, columns=[key, "period", "frames"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, content).mapInPandas(run, f"{key} {kind}, period long, frames array<array<float>>")


def feature_bytes(df: DataFrame, frames: str = "frames", length_ms: float | None = None, out: str = "content") -> DataFrame:
    """A column with the bytes of a feature file of each row's frames, kind 9; the period is in units
    that make it int(length_ms / frames * 10)."""

    @F.pandas_udf("binary")
    def encode(rows: pd.Series) -> pd.Series:
        def one(r) -> bytes:
            x = np.stack([np.asarray(v, dtype=">f4") for v in r]) if r is not None and len(r) else np.zeros((0, 0), ">f4")
            period = int((length_ms if length_ms is not None else len(x)) / max(1, len(x)) * 10)
            return struct.pack(">IIHH", len(x), period, 4 * x.shape[1], 9) + x.astype(">f4").tobytes()

        return rows.map(one)

    return df.withColumn(out, encode(frames))


def label_text(labels: DataFrame, run: str = "utterance_id") -> DataFrame:
    """One text for each utterance of (run, pos, start, end, token): its name, a line for each label, a dot."""
    line = F.concat_ws(" ", (F.col("start") * 10).cast("long"), (F.col("end") * 10).cast("long"), "token")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda s: s["line"])
    name = F.concat(F.lit('"'), F.col(run).cast("string"), F.lit('.lab"'))
    return labels.groupBy(run).agg(lines.alias("__l")).select(run, F.concat_ws("\n", name, F.array_join("__l", "\n"), F.lit(".")).alias("value"))


def read_label_tokens(lines: DataFrame) -> DataFrame:
    """(path, pos, token) of label files read by lines: the third field of each label, without contexts."""
    from seqloom.functions.scalar import centre_unit

    rows = lines.where(F.col("value").rlike(r"^\d+ \d+ \S+"))
    return rows.select("path", F.col("line_no").alias("pos"), centre_unit(F.split("value", " ")[2]).alias("token"))
