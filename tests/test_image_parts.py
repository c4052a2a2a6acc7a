"""Images read in parts against whole ones."""

import gzip

import numpy as np
import pytest

from seqloom.sources import image_parts, images
from test_sources import _image


def rows(df):
    return sorted((r.path, r.frame, r.z, r.y, r.x, r.value) for r in df.collect())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("images")
    r = np.random.default_rng(0)
    (top / "deep").mkdir()
    values = [np.where(r.random((5, 4, 6, 7)) < 0.3, -0.5, r.normal(size=(5, 4, 6, 7))).astype("f4") for _ in range(3)]
    (top / "a.nii").write_bytes(_image(values[0]))
    (top / "b.nii.gz").write_bytes(gzip.compress(_image(values[1], ">")))
    (top / "deep" / "c.nii").write_bytes(_image(values[2]))
    (top / "notes.txt").write_text("no image")
    return top


@pytest.mark.parametrize("cells_per_task", [7, 50, 500, 10**6])
@pytest.mark.parametrize("skip_zero", [False, True])
def test_same_cells_as_whole_files(spark, folder, cells_per_task, skip_zero):
    whole = images.read_images(spark, str(folder / "*.nii*"), skip_zero).unionByName(images.read_images(spark, str(folder / "deep"), skip_zero))
    parts = image_parts.read_image_parts(spark, str(folder), skip_zero, cells_per_task)
    assert rows(parts) == rows(whole)
    assert rows(image_parts.read_image_parts(spark, str(folder / "a*"), skip_zero)) == [r for r in rows(whole) if r[0].endswith("a.nii")]


@pytest.mark.parametrize(
    "condition", ["frame < 2", "frame = 3 AND z >= 2 AND z <= 4", "x > 1 AND y < 3 AND value > 0", "frame IN (1, 5)", "frame > 20", "z = 1 AND x IN (0, 9)", "frame <> 2 OR x = 1", "x < 0"]
)
def test_conditions(spark, folder, condition):
    parts = image_parts.read_image_parts(spark, str(folder), cells_per_task=40)
    whole = images.read_images(spark, str(folder / "*.nii*")).unionByName(images.read_images(spark, str(folder / "deep")))
    assert rows(parts.where(condition)) == rows(whole.where(condition))


@pytest.mark.parametrize("ranges", [{"frame": (0, 2)}, {"frame": (3, 4), "z": (2, 5)}, {"x": (2, 9), "y": (0, 3)}, {"frame": (20, 30)}, {"z": (1, 2), "x": (-3, 1)}, {"y": (9, 12)}])
def test_ranges(spark, folder, ranges):
    whole = images.read_images(spark, str(folder / "*.nii*")).unionByName(images.read_images(spark, str(folder / "deep")))
    condition = " AND ".join(f"{c} >= {a} AND {c} < {b}" for c, (a, b) in ranges.items())
    assert rows(image_parts.read_image_parts(spark, str(folder), cells_per_task=40, **ranges)) == rows(whole.where(condition))


def test_ranges_leave_parts_unread(spark, folder):
    parts = lambda **ranges: image_parts.read_image_parts(spark, str(folder / "a.nii"), cells_per_task=20, **ranges).rdd.getNumPartitions()
    assert parts() == 7 * 6 and parts(frame=(0, 2), z=(3, 4)) == 2
    with pytest.raises(ValueError):
        parts(t=(0, 1))


def test_reads_with_other_conditions_stay_apart(spark, folder):
    """A condition that one side of a plan gets by a join doesn't change the other side."""
    cells = image_parts.read_image_parts(spark, str(folder / "a.nii")).select("x", "y", "z", "frame", "value")
    places = cells.where("frame = 0").select("x", "y", "z")
    low = places.where("z < 2")
    both = cells.join(places, ["x", "y", "z"]).groupBy("frame").count().join(cells.join(low, ["x", "y", "z"]).groupBy("frame").count().withColumnRenamed("count", "low"), "frame")
    assert {(r["count"], r.low) for r in both.collect()} == {(5 * 4 * 6, 5 * 4 * 2)}


def test_a_large_file_is_read_where_it_is_asked_for(spark, tmp_path):
    """3 GB that the file system holds as a hole; of 64 tasks those that are asked read."""
    shape, n = (128, 128, 64), 768
    with open(tmp_path / "large.nii", "wb") as f:
        f.write(image_parts.header_bytes(shape, n, (2.0,) * 3, 1.0))
        f.seek(352 + 4 * (int(np.prod(shape)) * 700 + 5))
        f.write(np.float32(2.5).tobytes())
        f.truncate(352 + 4 * int(np.prod(shape)) * n)
    cells = lambda **ranges: image_parts.read_image_parts(spark, str(tmp_path / "large.nii"), True, 12 * int(np.prod(shape)), **ranges)
    assert cells().rdd.getNumPartitions() == 64
    assert [(r.x, r.y, r.z, r.frame, r.value) for r in cells(frame=(690, 710)).collect()] == [(5, 0, 0, 700, 2.5)]
    assert cells(frame=(0, 10)).count() == 0 and cells(frame=(0, 10)).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("compressed", [False, True])
def test_written_images_come_back(spark, tmp_path, compressed):
    r = np.random.default_rng(3)
    cells = [(f"i{k}", x, y, z, t, float(np.float32(r.normal()))) for k in range(3) for x, y, z, t in {tuple(r.integers(0, (4, 3, 2, 6)).tolist()) for _ in range(60)}]
    df = spark.createDataFrame([*cells, (None, 0, 0, 0, 0, 1.0), ("i0", 0, 0, 0, 99, 1.0)], "name string, x int, y int, z int, frame int, value double").repartition(5)
    out = {w.name: w for w in image_parts.write_images(df, f"file://{tmp_path}", (4, 3, 2), 6, compressed=compressed).collect()}
    assert {k: w.cells for k, w in out.items()} == {f"i{k}": sum(c[0] == f"i{k}" for c in cells) for k in range(3)}
    back = image_parts.read_image_parts(spark, str(tmp_path), skip_zero=True).collect()
    assert sorted((b.path.rsplit("/", 1)[1].split(".")[0], b.x, b.y, b.z, b.frame, b.value) for b in back) == sorted(cells)
    (head, *_) = images.read_headers(spark, out["i0"].path).collect()
    assert (head.nx, head.ny, head.nz, head.n_frames) == (4, 3, 2, 6)


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        image_parts.read_image_parts(spark, str(tmp_path / "nowhere")).count()
    assert image_parts.read_image_parts(spark, str(tmp_path)).count() == 0


def test_a_part_holds_no_places_of_its_whole_slab(tmp_path):
    import tracemalloc

    from seqloom.sources import image_parts

    path, (nx, ny, nz) = tmp_path / "a.nii", (100, 100, 200)
    path.write_bytes(image_parts.header_bytes((nx, ny, nz), 1, (1.0, 1.0, 1.0), 1.0) + np.arange(nx * ny * nz, dtype="<f4").tobytes())
    reader = image_parts.ImagePartsReader({"path": str(path), "skipzero": "true"})
    (part,) = reader.partitions()
    tracemalloc.start()
    n = 0
    for b in reader.read(part):
        x, y, z, v = (b.column(c).to_numpy() for c in ("x", "y", "z", "value"))
        assert ((z.astype(int) * ny + y) * nx + x == v).all()
        n += len(v)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == nx * ny * nz - 1 and peak < 40 * nx * ny * nz, peak
