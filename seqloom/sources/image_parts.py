"""Volumes read in parts: a data source whose tasks read frames, or slabs of a frame, of a file by themselves.

``images.read_images`` takes a file as one cell, which Spark bounds at 2 GB, in one task. Here the driver
reads headers alone; a plain file is cut into parts of about ``cellsPerTask`` cells, and a task seeks to its
part and holds one frame or slab of it. Frames and a box may be asked for; parts outside them are not read. A
compressed file can't be entered in the middle, so it is one part, which is streamed frame by frame up to
the last one asked for.

What to read is told by options, not pushed down from filters: Spark 4.1 keeps the parts of the first scan of
a Python source, so a DataFrame that stands twice in a plan with different filters would give wrong rows.

Files are opened by ``pyarrow.fs`` (local or mounted folders, hdfs, s3, gs); for a store that Spark alone
can reach there is ``images.read_images``.
"""

from __future__ import annotations

import fnmatch
import gzip
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.sources.images import header_of

CELLS = "path string, x int, y int, z int, frame int, value double"
CELLS_PER_TASK = 4_000_000
#: Cells of one batch.
BATCH = 1 << 18
_HEAD = 352


def filesystem(path: str):
    """The file system of a path or URI, the path in it, and what is put before its paths as Spark names them."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file:"
    if "://" not in path:
        return fs.LocalFileSystem(), path, "file:"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def list_images(path: str) -> tuple[object, list[str], str]:
    """Files under a folder (any depth), of a pattern with *, or the one file."""
    from pyarrow import fs

    system, inner, prefix = filesystem(path)
    inner = inner.rstrip("/")
    if "*" in inner:
        top = inner[: inner.index("*")].rsplit("/", 1)[0] or "/"
        found = [f.path for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.path, inner)]
    elif (info := system.get_file_info(inner)).type == fs.FileType.Directory:
        found = [f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and f.path.endswith((".nii", ".nii.gz"))]
    elif info.type == fs.FileType.File:
        found = [inner]
    else:
        raise FileNotFoundError(path)
    return system, sorted(found), prefix


@dataclass
class Part(InputPartition):
    """Frames and slab (z from ``low`` up to ``high``) of a file."""

    file: str
    name: str
    compressed: bool
    header: tuple
    frames: tuple[int, int]
    slab: tuple[int, int]

    def __init__(self, *values):
        super().__init__(None)
        self.file, self.name, self.compressed, self.header, self.frames, self.slab = values


class ImagePartsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_task = max(1, int(options.get("cellspertask", CELLS_PER_TASK)))
        self.skip_zero = str(options.get("skipzero", "false")).lower() == "true"
        self.bounds = {c: tuple(map(int, options.get(f"{c}range", f"0:{1 << 31}").split(":"))) for c in ("x", "y", "z", "frame")}  # from, up to

    def partitions(self) -> list[Part]:
        system, files, prefix = list_images(self.path)

        def head(file: str) -> tuple[bytes, bool]:
            with system.open_input_stream(file, compression=None) as stream:
                raw = stream.read(2)
            compressed = raw == b"\x1f\x8b"
            with system.open_input_stream(file, compression=None) as stream:
                return (gzip.GzipFile(fileobj=stream) if compressed else stream).read(_HEAD), compressed

        parts = []
        with ThreadPoolExecutor(32) as pool:
            heads = list(pool.map(head, files))
        for file, (raw, compressed) in zip(files, heads, strict=True):
            header = header_of(raw)
            nx, ny, nz = header[1][1:4]
            n_frames = header[1][4] if header[1][0] > 3 else 1
            (f0, f1), (z0, z1) = self.bounds["frame"], self.bounds["z"]
            f1, z1 = min(f1, n_frames), min(z1, nz)
            if f0 >= f1 or z0 >= z1:
                continue
            of = lambda frames, slab: Part(file, prefix + file, compressed, header, frames, slab)  # noqa: B023, E731
            if compressed:
                parts.append(of((f0, f1), (z0, z1)))
            elif nx * ny * (z1 - z0) > self.per_task:  # parts of one frame
                step = max(1, self.per_task // (nx * ny))
                parts += [of((t, t + 1), (z, min(z + step, z1))) for t in range(f0, f1) for z in range(z0, z1, step)]
            else:
                step = max(1, self.per_task // (nx * ny * (z1 - z0)))
                parts += [of((t, min(t + step, f1)), (z0, z1)) for t in range(f0, f1, step)]
        return parts

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's stand-in where there are no parts
            return
        system, _, _ = filesystem(self.path)
        order, dim, _, kind, offset, slope, intercept = part.header
        kind = np.dtype(order + kind)
        nx, ny, nz = dim[1:4]
        z0, z1 = part.slab
        (x0, x1), (y0, y1) = ((low, min(high, n)) for (low, high), n in ((self.bounds["x"], nx), (self.bounds["y"], ny)))
        if x0 >= x1 or y0 >= y1:
            return
        layer = nx * ny * kind.itemsize
        if part.compressed:
            stream = gzip.GzipFile(fileobj=system.open_input_stream(part.file, compression=None))
        else:
            stream = system.open_input_file(part.file)
        width, height = x1 - x0, y1 - y0
        with stream:
            for t in range(*part.frames):
                stream.seek(offset + (t * nz + z0) * layer)
                raw = stream.read((z1 - z0) * layer)
                v = np.frombuffer(raw, kind).reshape(z1 - z0, ny, nx)[:, y0:y1, x0:x1].astype(float).ravel()
                v = v * slope + intercept if slope else v
                # places are made for a batch at a time, as those of a slab take several times its values
                for lo in range(0, len(v), BATCH):
                    some = v[lo : lo + BATCH]
                    at = lo + (np.flatnonzero(some) if self.skip_zero else np.arange(len(some)))
                    if not len(at):
                        continue
                    columns = [pa.array(a.astype(np.int32)) for a in (at % width + x0, at // width % height + y0, at // (width * height) + z0)]
                    columns += [pa.array(np.full(len(at), t, np.int32)), pa.array(v[at])]
                    yield pa.RecordBatch.from_arrays([pa.array([part.name] * len(at)), *columns], names=["path", "x", "y", "z", "frame", "value"])


class ImageParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_parts"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> ImagePartsReader:
        return ImagePartsReader(dict(self.options))


def read_image_parts(
    spark: SparkSession, path: str, skip_zero: bool = False, cells_per_task: int = CELLS_PER_TASK, **ranges: tuple[int, int],
) -> DataFrame:
    """Cells path, x, y, z, frame, value of all images under ``path``, as ``images.read_images`` gives them.

    ``ranges`` are (from, up to) of frame, x, y or z: ``read_image_parts(spark, path, frame=(0, 10))``.
    """
    spark.dataSource.register(ImageParts)
    reader = spark.read.format("image_parts").option("cellsPerTask", cells_per_task).option("skipZero", str(skip_zero).lower())
    for column, (low, high) in ranges.items():
        if column not in ("frame", "x", "y", "z"):
            raise ValueError(f"{column} is no axis of an image")
        reader = reader.option(f"{column}Range", f"{max(0, low)}:{max(0, high)}")
    return reader.load(path)


def header_bytes(shape: tuple[int, int, int], n_frames: int, voxel_mm: tuple[float, float, float], frame_s: float) -> bytes:
    """The header of a little-endian file of 32-bit floats."""
    raw = bytearray(_HEAD)
    struct.pack_into("<i", raw, 0, 348)
    struct.pack_into("<8h", raw, 40, 4, *shape, n_frames, 1, 1, 1)
    struct.pack_into("<2h", raw, 70, 16, 32)
    struct.pack_into("<8f", raw, 76, 1.0, *voxel_mm, frame_s, 0, 0, 0)
    struct.pack_into("<3f", raw, 108, float(_HEAD), 1.0, 0.0)
    raw[344:348] = b"n+1\0"
    return bytes(raw)


def write_images(
    cells: DataFrame, folder: str, shape: tuple[int, int, int], n_frames: int, voxel_mm: tuple[float, float, float] = (2.0, 2.0, 2.0),
    frame_s: float = 2.0, name: str = "name", compressed: bool = False,
) -> DataFrame:
    """Write cells (name, x, y, z, frame, value) as one file for each name in ``folder``: (name, path, cells).

    A cell without a row is 0; of rows for one cell the greatest value counts. An image is written frame by frame
    from sorted rows, under another name until it is whole, so a task may be repeated. ``folder`` must be one
    that all executors share. Nothing is written before the result is read.
    """
    nx, ny, nz = shape
    head = header_bytes(shape, n_frames, voxel_mm, frame_s)
    place = ((F.col("z") * ny + F.col("y")) * nx + F.col("x")).cast("long")
    rows = cells.select(F.col(name).cast("string").alias("name"), F.col("frame").cast("int").alias("frame"), place.alias("at"), F.col("value").cast("float").alias("value"))
    rows = rows.where(F.col("name").isNotNull() & (F.col("frame") >= 0) & (F.col("frame") < n_frames))
    dealt = rows.repartition("name").sortWithinPartitions("name", "frame", "at", "value")
    ending = ".nii.gz" if compressed else ".nii"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner, prefix = filesystem(folder)
        system.create_dir(inner, recursive=True)
        open_name, out, half_name, frame, at_frame, n = None, None, "", np.zeros(nx * ny * nz, "<f4"), 0, 0

        def close():
            nonlocal at_frame
            while at_frame < n_frames:
                out.write(frame.tobytes())
                frame[:] = 0
                at_frame += 1
            out.close()
            path = f"{inner}/{open_name}{ending}"
            system.move(half_name, path)
            return pa.RecordBatch.from_pydict({"name": [open_name], "path": [prefix + path], "cells": [n]})

        for batch in batches:
            names, frames = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            at, values = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            change = np.flatnonzero((names[1:] != names[:-1]) | (frames[1:] != frames[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(names)], strict=True):
                if lo == hi:
                    continue
                if names[lo] != open_name:
                    if out is not None:
                        yield close()
                    open_name, at_frame, n = names[lo], 0, 0
                    half_name = f"{inner}/.{uuid.uuid4().hex}"
                    plain = system.open_output_stream(half_name, compression=None)
                    out = pa.CompressedOutputStream(plain, "gzip") if compressed else plain
                    out.write(head)
                    frame[:] = 0
                while at_frame < frames[lo]:
                    out.write(frame.tobytes())
                    frame[:] = 0
                    at_frame += 1
                frame[at[lo:hi]] = values[lo:hi]
                n += hi - lo
        if out is not None:
            yield close()

    return dealt.mapInArrow(run, "name string, path string, cells long")
