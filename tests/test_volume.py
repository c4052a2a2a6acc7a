from itertools import combinations, product

import numpy as np
import pytest

from seqloom.operators import design, volume

XYZ = "x int, y int, z int"


def _cells(spark, rows, extra=""):
    return spark.createDataFrame([tuple(int(v) for v in r) for r in rows], extra + XYZ)


def test_growth_is_a_star(spark):
    one = _cells(spark, [(5, 5, 5)])
    assert volume.grow(one, 2, (11, 11, 11)).count() == 53
    assert volume.grow(one, 0, (11, 11, 11)).count() == 1
    assert volume.grow(_cells(spark, [(0, 0, 0)]), 1, (2, 2, 2)).count() == 8


def test_overlap_removal_equals_pair_after_pair(spark):
    r = np.random.default_rng(4)
    masks = [{tuple(c) for c in r.integers(0, 3, (14, 3))} for _ in range(7)]
    stack = _cells(spark, [(i, *c) for i, m in enumerate(masks) for c in m], "region_idx int, ")
    want = [set(m) for m in masks]
    for i, j in combinations(range(6), 2):
        both = want[i] & want[j]
        want[i], want[j] = want[i] - both, want[j] - both
    found = [set() for _ in masks]
    for row in volume.exclusive_regions(stack).collect():
        found[row.region_idx].add((row.x, row.y, row.z))
    assert found == want


def _brute_components(cells):
    left, out = set(cells), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            c = todo.pop()
            seen.add(c)
            for d in product((-1, 0, 1), repeat=3):
                n = tuple(a + b for a, b in zip(c, d, strict=True))
                if n in left:
                    left.discard(n)
                    todo.append(n)
        out.append(frozenset(seen))
    return set(out)


@pytest.mark.parametrize("kind", ["random", "line", "none"])
def test_components_over_tiles(spark, kind):
    r = np.random.default_rng(6)
    if kind == "random":
        cells = {tuple(c) for c in r.integers(-10, 40, (2500, 3)).tolist()}
    elif kind == "line":
        cells = {(i, i % 2, 0) for i in range(150)} | {(i, 40, 3) for i in range(5)}
    else:
        cells = set()
    found = {}
    for row in volume.components(_cells(spark, cells)).collect():
        found.setdefault(row.component, set()).add((row.x, row.y, row.z))
    assert {frozenset(v) for v in found.values()} == _brute_components(cells)


def test_small_components_go_by_key(spark):
    rows = [(0, i, 0, 0) for i in range(6)] + [(0, 20, 20, i) for i in range(3)] + [(0, 40, 40, i) for i in range(4)] + [(1, 9, 9, 9)]
    found = volume.clean_components(_cells(spark, rows, "k int, "), ["k"])
    assert sorted((r.k, r.x) for r in found.collect()) == [(0, i) for i in range(6)] + [(0, 40)] * 4 + [(1, 9)]
    assert volume.clean_components(_cells(spark, [(1, 1, 1), (1, 1, 2), (5, 5, 5)])).count() == 2


def test_smoothing_against_numpy(spark):
    r = np.random.default_rng(8)
    image = r.normal(size=(4, 5, 3))
    cells = spark.createDataFrame([(x, y, z, 0, float(image[x, y, z])) for x, y, z in np.ndindex(image.shape)], XYZ + ", frame int, value double")
    kernel = design.smoothing_kernel(spark, (2.0,) * 3, (1.0,) * 3)
    k = {(w.dx, w.dy, w.dz): w.weight for w in kernel.collect()}
    assert len(k) == 27
    for row in volume.smooth(cells, kernel).collect():
        want = sum(
            w * image[row.x - dx, row.y - dy, row.z - dz] for (dx, dy, dz), w in k.items()
            if 0 <= row.x - dx < 4 and 0 <= row.y - dy < 5 and 0 <= row.z - dz < 3
        )
        assert np.isclose(row.value, want)


def test_set_operations_and_range(spark):
    a, b = _cells(spark, [(0, 0, 0), (1, 2, 3)]), _cells(spark, [(1, 2, 3), (4, 4, 4)])
    assert volume.mask_and(a, b).collect() == [(1, 2, 3)] and volume.mask_minus(a, b).collect() == [(0, 0, 0)]
    assert volume.mask_or(a, b).count() == 3
    assert tuple(volume.mask_range(a).first()) == (0, 1, 0, 2, 0, 3)
    assert volume.mask_range(a.limit(0)).count() == 0


def test_regions_to_features(spark):
    t = spark.createDataFrame([(1, 0, x, 0, 0, float(x)) for x in range(1, 9)] + [(1, 1, x, 5, 0, float(9 - x)) for x in range(1, 9)], "run_id int, region_idx int, " + XYZ + ", t double")
    roi = volume.regions_from_t(t, ["run_id"], q=0.5)
    assert sorted((r.region_idx, r.x) for r in roi.collect()) == [(0, x) for x in (5, 6, 7, 8)] + [(1, x) for x in (1, 2, 3, 4)]
    motor = _cells(spark, [(x, y, 0) for x in range(1, 9) for y in (0, 5)])
    calibration = volume.calibration_cells(roi, motor, ["run_id"])
    assert calibration.count() == 16
    image = spark.createDataFrame([(1, x, y, 0, f, 1.0 + f * (y == 0)) for x in range(1, 9) for y in (0, 5) for f in range(3)], "run_id int, " + XYZ + ", frame int, value double")
    signal = volume.calibrated(volume.mean_signal(image, roi, ["run_id"]), volume.mean_signal(image, calibration, ["run_id"]), ["run_id", "region_idx"])
    found = {(r.region_idx, r.frame): r.value for r in signal.collect()}
    assert found == pytest.approx({(0, f): f / 2 for f in range(3)} | {(1, f): -f / 2 for f in range(3)})
    assert volume.aggregate_regions(roi.withColumnRenamed("run_id", "sub"), ["sub"], q=0.5).count() == 8
    with pytest.raises(KeyError):
        volume.assert_known_subjects(spark.createDataFrame([(3,)], "sub int"), roi.withColumnRenamed("run_id", "sub"))


def test_regions_without_cells_are_nan(spark):
    image = spark.createDataFrame([(0, 0, 0, 0, 2.0)], XYZ + ", frame int, value double")
    regions = spark.createDataFrame([(0, 0), (1, 0)], "region_idx int, frame int")
    found = {r.region_idx: r.value for r in volume.mean_signal(image, _cells(spark, [(0, 0, 0, 0)], "region_idx int, "), regions=regions).collect()}
    assert found[0] == 2.0 and np.isnan(found[1])


def test_image_filter(spark):
    image = spark.createDataFrame([(x, 0, 0, f, float(x + f)) for x in range(3) for f in range(2)], XYZ + ", frame int, value double")
    assert sorted({r.x for r in volume.filter_image(image, threshold=0.5).collect()}) == [1, 2]
    assert volume.filter_image(image, _cells(spark, [(2, 0, 0)])).count() == 2
    kernel = design.smoothing_kernel(spark, (2.0,) * 3, (1.0,) * 3)
    assert volume.filter_image(image, _cells(spark, [(2, 0, 0)]), kernel=kernel, threshold=0.5).count() == 2
    atlas = spark.createDataFrame([(0, 0, 0, 13), (1, 0, 0, 14), (2, 0, 0, 1)], XYZ + ", label int")
    assert volume.labelled_mask(atlas, [13, 14]).count() == 2


def test_smoothing_within_gives_zero_where_nothing_reaches(spark):
    image = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 0, 0, 1, 2.0)], "x int, y int, z int, frame int, value double")
    kernel = spark.createDataFrame([(0, 0, 0, 0.5), (1, 0, 0, 0.25)], "dx int, dy int, dz int, weight double")
    within = spark.createDataFrame([(1, 0, 0), (100, 0, 0), (0, 0, 0)], "x int, y int, z int")
    got = {(r.x, r.frame): r.value for r in volume.smooth(image, kernel, within=within).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 1.0, (1, 0): 0.25, (1, 1): 0.5, (100, 0): 0.0, (100, 1): 0.0}


def test_kernels_by_axis(spark, monkeypatch):
    """A product of weights by axis is found, and gives what all of its cells give; another kernel isn't one."""
    r = np.random.default_rng(6)
    axes = [r.normal(size=3), r.normal(size=5), r.normal(size=1)]
    cells = [(i - 1, j - 2, 0, float(a * b * axes[2][0])) for i, a in enumerate(axes[0]) for j, b in enumerate(axes[1])]
    found = volume.rank_one(np.array([c[:3] for c in cells]), [c[3] for c in cells], 2)
    assert all(found[0][i + 2] * found[1][j + 2] * found[2][2] == pytest.approx(w) for i, j, _, w in cells)
    assert volume.rank_one(np.array([c[:3] for c in cells]), [c[3] + (k == 4) for k, c in enumerate(cells)], 2) is None
    assert volume.rank_one(np.zeros((1, 3), int), [0.0], 0) is None
    image = [(int(x), int(y), int(z), int(t), float(r.normal())) for x, y, z, t in {tuple(r.integers(0, (20, 18, 3, 2))) for _ in range(300)}]
    image = spark.createDataFrame(image, "x int, y int, z int, frame int, value double")
    kernel = spark.createDataFrame(cells, "dx int, dy int, dz int, weight double")
    rows = lambda: {tuple(x)[:4]: x.value for x in volume.smooth(image, kernel).select("frame", "x", "y", "z", "value").collect()}
    by_axis = rows()
    monkeypatch.setattr(volume, "rank_one", lambda *a: None)
    assert by_axis == pytest.approx(rows()) and len(by_axis) == image.count()


def test_pairs_of_regions_lose_what_both_have(spark):
    """In one grouping, whatever the number of regions; a cell that lacks a coordinate equals no other."""
    r = np.random.default_rng(5)
    rows = sorted({(int(k), int(x), int(y), 0) for k, x, y in r.integers(0, 4, (40, 3))}) + [(0, None, 1, 0), (1, None, 1, 0)]
    stack = spark.createDataFrame(rows, "region_idx int, x int, y int, z int")
    found = volume.pairs_without_overlap(stack)
    want = [
        (a, b, *row) for a in range(4) for b in range(a + 1, 4) for row in rows
        if row[0] in (a, b) and (None in row or (a + b - row[0], *row[1:]) not in rows)
    ]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
