"""Volumes as sparse relations: masks, regions of interest, smoothing and mean signals.

A mask is the relation of its true cells ``x, y, z`` (with ``region`` for a stack and key columns for
several volumes), an image the relation ``x, y, z, frame, value``. Intersection is a semi-join,
difference an anti-join.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.quantiles import exact_quantiles
from seqloom.sources.storage import cut_lineage

XYZ = ["x", "y", "z"]
#: Edge of the tiles that one task works on at a time: 4096 cells at most.
TILE = 16


def mask_and(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    return a.join(b.select(*(on or XYZ)).distinct(), on or XYZ, "left_semi")


def mask_or(*masks: DataFrame) -> DataFrame:
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.distinct()


def mask_minus(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    return a.join(b.select(*(on or XYZ)), on or XYZ, "left_anti")


def without_overlap(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both masks without what they share."""
    return mask_minus(a, b), mask_minus(b, a)


def pairs_without_overlap(stack: DataFrame, region: str = "region_idx") -> DataFrame:
    """Each pair of regions a < b of a stack without the cells that both have: a, b, region, x, y, z.

    A cell's regions stand in one row, so all pairs take one grouping. A cell that lacks a coordinate is no
    other's equal and stays.
    """
    lacking = F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()
    cells = stack.groupBy(*XYZ, F.when(lacking, F.col(region)).alias("__own")).agg(F.collect_set(region).alias("__here"))
    regions = stack.agg(F.collect_set(region).alias("__all"))
    each = cells.crossJoin(F.broadcast(regions)).select(*XYZ, F.explode("__here").alias(region), F.array_except("__all", "__here").alias("__others"))
    each = each.withColumn("__other", F.explode("__others"))
    return each.select(F.least(region, "__other").alias("a"), F.greatest(region, "__other").alias("b"), region, *XYZ)


def mask_range(mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bounding box of each key's cells; keys without cells have no row."""
    ends = [f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))]
    return mask.groupBy(*(by or [])).agg(*ends).where("min_x IS NOT NULL")


def above_quantile(values: DataFrame, by: list[str], value: str = "t", q: float = 0.98) -> DataFrame:
    """Cells above the q-quantile (linear between ranks) of their key's positive values; NaN isn't positive."""
    positive = (F.col(value) > 0) & ~F.isnan(value)
    limits = exact_quantiles(values.where(positive), by, value, q, out="__limit")
    return values.where(positive).join(limits, by).where(F.col(value) > F.col("__limit")).drop("__limit")


def votes(masks: DataFrame, by: list[str]) -> DataFrame:
    """In how many runs each cell is in the mask; ``masks`` has a row for each run."""
    return masks.groupBy(*by, *XYZ).agg(F.count(F.lit(1)).alias("votes"))


def enough_votes(counts: DataFrame, by: list[str], q: float = 0.8) -> DataFrame:
    """Cells with at least the q-quantile of their key's votes."""
    limits = exact_quantiles(counts, by, "votes", q, out="__limit")
    return counts.join(limits, by).where(F.col("votes") >= F.col("__limit")).drop("__limit")


def exclusive_regions(stack: DataFrame, first_n: int = 6, region: str = "region_idx", by: list[str] | None = None) -> DataFrame:
    """Overlaps among the first ``first_n`` regions removed, as if pair after pair lost what it shares.

    In that order a cell that k of these regions claim stays only if k is odd, and then in the last of
    them; one window shows it. Other regions are left alone.
    """
    among = F.col(region) < first_n
    cell = Window.partitionBy(*(by or []), *XYZ)
    n, last = F.sum(among.cast("int")).over(cell), F.max(F.when(among, F.col(region))).over(cell)
    keep = ~among | ((n % 2 == 1) & (F.col(region) == last))
    return stack.withColumn("__keep", keep).where("__keep").drop("__keep")


def grow(mask: DataFrame, distance: int, shape: tuple[int, int, int], by: list[str] | None = None) -> DataFrame:
    """Dilation along the 26 directions up to ``distance`` (a star, not a cube), held inside the volume."""
    if distance <= 0:
        return mask.select(*(by or []), *XYZ)
    steps = [(d * i, d * j, d * k) for d in range(1, distance + 1) for i, j, k in product((-1, 0, 1), repeat=3) if (i, j, k) != (0, 0, 0)]
    offsets = F.explode(F.expr("array(" + ",".join(f"struct({i} AS i, {j} AS j, {k} AS k)" for i, j, k in [(0, 0, 0), *steps]) + ")"))
    moved = mask.select(*(by or []), *XYZ, offsets.alias("o"))
    held = [F.least(F.greatest(F.col(c) + F.col("o")[o], F.lit(0)), F.lit(n - 1)).alias(c) for c, o, n in zip(XYZ, "ijk", shape, strict=True)]
    return moved.select(*(by or []), *held).distinct()


#: Frames of a tile that are convolved together.
FRAMES = 32
#: Cells of a kernel that may be sent to the tasks.
KERNEL_LIMIT = 100_000


def rank_one(offsets: np.ndarray, weights: list[float], half: int) -> list[np.ndarray] | None:
    """Three weights by axis whose product is the kernel, each over -half .. half; None if it is no such product."""
    whole = np.zeros((2 * half + 1,) * 3)
    for at, w in zip(offsets + half, weights, strict=True):
        whole[tuple(at)] += w
    i, j, k = np.unravel_index(np.abs(whole).argmax(), whole.shape)
    top = whole[i, j, k]
    if top == 0:
        return None
    found = [whole[:, j, k], whole[i, :, k] / top, whole[i, j, :] / top]
    product_ = found[0][:, None, None] * found[1][None, :, None] * found[2][None, None, :]
    return found if np.abs(product_ - whole).max() <= 1e-12 * abs(top) else None


def smooth(image: DataFrame, kernel: DataFrame, keep: list[str] | None = None, within: DataFrame | None = None) -> DataFrame:
    """Convolution with a kernel (dx, dy, dz, weight), 0 outside the volume, at the cells of the image.

    Cells go to their tile of 16 x 16 x 16 and to the tiles beside it that the kernel reaches, not once
    for each cell of the kernel; a task convolves a tile of 32 frames at a time. A kernel that is a product of
    one weight for each axis (as Gaussian ones are) takes three passes along the axes, 3 n products a cell in
    place of n^3. Only cells that the image has
    (or ``within``, in every frame of every run) are returned; ``keep`` names columns of these cells to
    return too. A cell stands in the image once.
    """
    keys = [c for c in ("run_id",) if c in image.columns]
    rows = kernel.select("dx", "dy", "dz", "weight").limit(KERNEL_LIMIT + 1).collect()
    if len(rows) > KERNEL_LIMIT:
        raise ValueError(f"the kernel has more than {KERNEL_LIMIT} cells")
    offsets, weights = np.array([r[:3] for r in rows], dtype=int).reshape(-1, 3), [float(r[3]) for r in rows]
    half = int(np.abs(offsets).max(initial=0))
    factors = rank_one(offsets, weights, half)
    reach = [F.explode(F.sequence(F.floor((F.col(c) - half) / TILE), F.floor((F.col(c) + half) / TILE))).alias(f"__t{c}") for c in XYZ]
    tiled = image.select(*keys, "frame", *[F.col(c).cast("long").alias(c) for c in XYZ], F.col("value").cast("double").alias("value"))
    for r in reach:
        tiled = tiled.select("*", r)
    everywhere = within is not None

    def convolve(group: pd.DataFrame) -> pd.DataFrame:
        corner = np.array([group[f"__t{c}"].iloc[0] * TILE - half for c in XYZ])
        at = group[XYZ].to_numpy() - corner
        frames, frame = np.unique(group["frame"].to_numpy(), return_inverse=True)
        field = np.zeros((len(frames), *(TILE + 2 * half,) * 3))
        field[(frame, *at.T)] = group["value"].to_numpy()
        if factors is not None:
            out = field
            for axis, along in enumerate(factors, 1):
                lead = (slice(None),) * axis
                out = sum(w * out[(*lead, slice(2 * half - d, 2 * half - d + TILE))] for d, w in enumerate(along) if w)
        else:
            out = np.zeros((len(frames), *(TILE,) * 3))
            for (dx, dy, dz), w in zip(half - offsets, weights, strict=True):
                out += w * field[:, dx : dx + TILE, dy : dy + TILE, dz : dz + TILE]
        if everywhere:
            own = np.argwhere(np.ones(out.shape, dtype=bool))
        else:
            inside = ((at >= half) & (at < half + TILE)).all(axis=1)
            own = np.concatenate([frame[inside][:, None], at[inside] - half], axis=1)
        found = {c: group[c].iloc[0] for c in keys} | {"frame": frames[own[:, 0]]} | {c: own[:, k + 1] + corner[k] + half for k, c in enumerate(XYZ)}
        return pd.DataFrame({**found, "value": out[tuple(own.T)]}, index=range(len(own)))

    kinds = {c: image.schema[c].dataType.simpleString() for c in [*keys, "frame"]}
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "x long, y long, z long, value double"])
    some = F.floor(F.col("frame") / FRAMES).alias("__frames")
    summed = tiled.groupBy(*keys, some, "__tx", "__ty", "__tz").applyInPandas(convolve, schema)
    summed = summed.select(*keys, "frame", *[F.col(c).cast(image.schema[c].dataType).alias(c) for c in XYZ], "value")
    if within is None and not keep:
        return summed
    if within is None:
        return summed.join(image.select(*keys, *XYZ, *(keep or [])).distinct(), [*keys, *XYZ])
    # cells that nothing reaches are 0
    grid = within.select(*XYZ, *(keep or [])).distinct().crossJoin(image.select(*keys, "frame").distinct())
    return grid.join(summed, [*keys, "frame", *XYZ], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


#: Half of the 26 neighbours of a cell: the others are their mirror images.
_FORWARD = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def components(mask: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The 26-connected component of every cell: by, x, y, z, component.

    Inside tiles of 16 x 16 x 16 cells components are found at once; the cells that touch across tiles
    link the tiles' components, and links are contracted (each component takes the smallest name among
    its neighbours, and names are followed to their own names) until nothing changes. No task ever
    holds more than a tile, and the links are only of those at tile faces.
    """
    by = by or []
    keys = F.to_json(F.struct(*by)) if by else F.lit("")
    cells = mask.select(*by, *XYZ).distinct().withColumn("__key", keys)
    tile = [F.floor(F.col(c) / TILE).cast("long").alias(f"__t{c}") for c in XYZ]
    plain = cells.select("__key", *[F.col(c).cast("long").alias(c) for c in XYZ]).select("*", *tile)

    def label(group: pd.DataFrame) -> pd.DataFrame:
        at = {p: i for i, p in enumerate(zip(group["x"], group["y"], group["z"], strict=True))}
        parent = list(range(len(at)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for (x, y, z), i in at.items():
            for dx, dy, dz in _FORWARD:
                j = at.get((x + dx, y + dy, z + dz))
                if j is not None:
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        names = group["x"].astype(str) + "," + group["y"].astype(str) + "," + group["z"].astype(str)
        group["local"] = names.to_numpy()[[root(i) for i in range(len(at))]]
        return group[["__key", *XYZ, "local"]]

    local = plain.groupBy("__key", "__tx", "__ty", "__tz").applyInPandas(label, "__key string, x long, y long, z long, local string")
    local = cut_lineage(local.withColumn("local", F.concat_ws("|", "__key", "local")))
    border = F.expr(" OR ".join(f"pmod({c}, {TILE}) IN (0, {TILE - 1})" for c in XYZ))
    face = local.where(border)
    offsets = F.explode(F.expr("array(" + ",".join(f"struct({i}L AS i, {j}L AS j, {k}L AS k)" for i, j, k in _FORWARD) + ")"))
    reach = face.select("__key", *XYZ, F.col("local").alias("u"), offsets.alias("o")).select(
        "__key", "u", *[(F.col(c) + F.col("o")[o]).alias(c) for c, o in zip(XYZ, "ijk", strict=True)]
    )
    links = reach.join(face.withColumnRenamed("local", "v"), ["__key", *XYZ]).where("u <> v").select("u", "v").distinct()
    names = contract(links)
    named = local.join(names.withColumnRenamed("node", "local"), "local", "left")
    named = named.select("__key", *XYZ, F.coalesce("component", "local").alias("component"))
    return cells.join(named, ["__key", *XYZ]).drop("__key")


def contract(links: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of the nodes that have links (u, v): the smallest name that each one reaches.

    Each round a node hooks on to the smallest name among its neighbours' and follows that name's own
    name, so the number of rounds grows with the logarithm of the longest path.
    """
    both = cut_lineage(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    names = cut_lineage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("name")).withColumnRenamed("u", "node"))
    for _ in range(limit):
        near = both.join(names.withColumnRenamed("node", "v"), "v").select("u", "name")
        # what a node offers to itself and to the node that its name stands for
        offers = near.unionByName(names.select(F.col("node").alias("u"), "name"))
        hooked = offers.groupBy("u").agg(F.min("name").alias("name"))
        owner = names.withColumnRenamed("node", "u").withColumnRenamed("name", "old").join(hooked, "u")
        up = owner.select(F.col("old").alias("u"), "name").unionByName(hooked).groupBy("u").agg(F.min("name").alias("name"))
        jump = up.join(up.select(F.col("u").alias("name"), F.col("name").alias("next")), "name", "left")
        new = cut_lineage(jump.select(F.col("u").alias("node"), F.coalesce("next", "name").alias("name")))
        changed = new.join(names.withColumnRenamed("name", "old"), "node").where("name <> old").limit(1).count()
        names = new
        if not changed:
            return names.withColumnRenamed("name", "component")
    raise RuntimeError(f"no fixed point after {limit} rounds")


def clean_components(mask: DataFrame, by: list[str] | None = None, ratio: float = 0.5) -> DataFrame:
    """Cells of components with more than int(ratio * cells of the largest one of the key) cells.

    A key without cells gives none.
    """
    by = by or []
    found = components(mask, by)
    sizes = found.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("__n"))
    largest = F.max("__n").over(Window.partitionBy(*by)) if by else F.lit(None)
    if not by:
        sizes = sizes.crossJoin(F.broadcast(sizes.agg(F.max("__n").alias("__top"))))
        largest = F.col("__top")
    kept = sizes.withColumn("__max", largest).where(F.col("__n") > F.floor(F.col("__max") * ratio)).select(*by, "component")
    return found.join(kept, [*by, "component"], "left_semi").drop("component")


def regions_from_t(
    t: DataFrame, by: list[str], region_masks: DataFrame | None = None, q: float = 0.98, ratio: float = 0.5, first_n: int | None = 6,
) -> DataFrame:
    """Regions of interest of each run: threshold, large components, only inside the region's mask if
    given (region_idx, x, y, z), no overlap among the first regions. ``by`` holds the run's keys;
    ``t`` has these, region_idx, x, y, z and t."""
    keys = [*by, "region_idx"]
    found = clean_components(above_quantile(t, keys, q=q).select(*keys, *XYZ), keys, ratio)
    if region_masks is not None:
        found = mask_and(found, region_masks, ["region_idx", *XYZ])
    return exclusive_regions(found, first_n, by=by) if first_n else found


def calibration_cells(roi: DataFrame, motor: DataFrame, by: list[str], region_masks: DataFrame | None = None) -> DataFrame:
    """Motor cells in no region of the run, for each of its regions, inside the region's mask if given."""
    runs = roi.select(*by).distinct()
    free = mask_minus(runs.crossJoin(motor.select(*XYZ)), roi.select(*by, *XYZ).distinct(), [*by, *XYZ])
    regions = roi.select(*by, "region_idx").distinct()
    out = regions.join(free, by)
    return mask_and(out, region_masks, ["region_idx", *XYZ]) if region_masks is not None else out


def aggregate_regions(roi: DataFrame, by: list[str], q: float = 0.8, ratio: float = 0.5, first_n: int | None = 6) -> DataFrame:
    """One set of regions from those of several runs: cells with enough votes, large components, no overlap."""
    keys = [*by, "region_idx"]
    chosen = enough_votes(votes(roi, keys), keys, q).select(*keys, *XYZ)
    cleaned = clean_components(chosen, keys, ratio)
    return exclusive_regions(cleaned, first_n, by=by) if first_n else cleaned


def mean_signal(image: DataFrame, stack: DataFrame, by: list[str] | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Mean over each region's cells in each frame: by, region_idx, frame, value.

    With ``regions`` (by, region_idx, frame) the regions without cells are there too, as NaN.
    """
    by = by or []
    means = image.join(stack.select(*by, "region_idx", *XYZ).distinct(), [*by, *XYZ]).groupBy(*by, "region_idx", "frame").agg(F.avg("value").alias("value"))
    if regions is None:
        return means
    return regions.join(means, [*by, "region_idx", "frame"], "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def change_from_first(signal: DataFrame, by: list[str]) -> DataFrame:
    """(x - x[0]) / x[0] of each key's frames; by IEEE division where x[0] is 0."""
    first = F.first("value").over(Window.partitionBy(*by).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    d = F.col("value") - F.col("__first")
    odd = F.when(d == 0, F.lit(float("nan"))).when(d > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    change = F.when(F.col("__first") == 0, odd).otherwise(d / F.nullif(F.col("__first"), F.lit(0.0)))
    return signal.withColumn("__first", first).withColumn("value", change).drop("__first")


def calibrated(signal: DataFrame, calibration: DataFrame, by: list[str]) -> DataFrame:
    """Change of the regions less the change of their calibration cells."""
    base = change_from_first(calibration, by).select(*by, "frame", F.col("value").alias("__base"))
    return change_from_first(signal, by).join(base, [*by, "frame"]).withColumn("value", F.col("value") - F.col("__base")).drop("__base")


def region_features(image: DataFrame, roi: DataFrame, calibration: DataFrame, by: list[str]) -> DataFrame:
    """Calibrated mean signals of the runs in ``image`` under regions of their subjects (all by ``by``, with run_id)."""
    keys = ["run_id", *by, "region_idx"]
    image_keys = image.select("run_id", *by, *XYZ, "frame", "value")

    def means(cells: DataFrame) -> DataFrame:
        joined = image_keys.join(cells.select(*by, "region_idx", *XYZ), [*by, *XYZ])
        return joined.groupBy(*keys, "frame").agg(F.avg("value").alias("value"))

    return calibrated(means(roi), means(calibration), keys)


def assert_known_subjects(runs: DataFrame, roi: DataFrame, key: str = "sub") -> DataFrame:
    """The runs; fails if one's subject has no regions."""
    unknown = runs.select(key).distinct().join(roi.select(key).distinct(), key, "left_anti").limit(5).collect()
    if unknown:
        raise KeyError(f"no regions for {[r[0] for r in unknown]}")
    return runs


def labelled_mask(atlas: DataFrame, labels: list[int]) -> DataFrame:
    """The cells of an atlas (x, y, z, label) with one of the labels."""
    return atlas.where(F.col("label").isin(*labels)).select(*XYZ).distinct()


def filter_image(
    image: DataFrame, mask: DataFrame | None = None, expanded: DataFrame | None = None, threshold: float | None = None, kernel: DataFrame | None = None,
) -> DataFrame:
    """Masking and smoothing without a model: cells of the mask whose every frame exceeds the threshold,
    smoothed with what the expanded mask (else the mask) holds."""
    source = expanded if expanded is not None else mask
    wide = image if source is None else mask_and(image, source)
    if threshold is not None:
        ok = image.groupBy(*XYZ).agg(F.bool_and(F.col("value") > threshold).alias("__ok")).where("__ok")
        mask = ok.select(*XYZ) if mask is None else mask_and(mask, ok)
    if kernel is not None:
        return smooth(wide, kernel, within=mask)
    return wide if mask is None else mask_and(wide, mask)

