"""Exact quantiles of groups of any size in bounded memory.

Spark's own exact percentile holds a group's distinct values in one buffer. Here the two ranks beside the
quantile are selected: a sketch of each group (of bounded size, combined by Spark) gives two values that
bracket a rank closely, values below, at and between them are counted exactly, and what lies between goes on
if the rank does, until it is few enough to be sorted. Each pass leaves a small share, however the values are spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.storage import cut_lineage

#: Values of a group that one task sorts; the reciprocal of the sketch's error in ranks.
SORTED, ACCURACY = 100_000, 2000


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & a[c].eqNullSafe(b[c])
    return on


def _between(a: str, b: str, share: Column) -> Column:
    return F.when(F.col(a) == F.col(b), F.col(a)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * share)


def select_ranks(values: DataFrame, ranks: DataFrame, by: list[str], small: int = SORTED) -> DataFrame:
    """by, rank, v: the value of each rank (from 0) of ``ranks`` (by, rank) among its group's ``values`` (by, v)."""
    found = None
    # k: the rank among the values that are left
    asked = cut_lineage(ranks.select(*by, "rank", F.col("rank").alias("k")), "quantile-ranks")
    left = values
    keys = [*by, "rank"]
    while True:
        many = left.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if found is None else left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        on = by if found is None else keys
        sized = cut_lineage(asked.join(many, _same(asked, many, on)).select(*[asked[c] for c in keys], "k", "n"), "quantile-sizes")
        # a row for each value and rank that is asked of its group
        rows = left.join(sized, _same(left, sized, on)).select(*[sized[c] for c in keys], "v", "k", "n")
        ready = rows.where(F.col("n") <= small).withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("v")) - 1)
        picked = ready.where("at = k").select(*keys, "v")
        found = picked if found is None else found.unionByName(picked)
        if sized.where(F.col("n") > small).isEmpty():
            return found
        rows = rows.where(F.col("n") > small)
        # the ends of a bracket by steps of the sketch's error; the wanted ones of them by the rank
        steps = [i / 400 for i in range(401)]
        sketch = rows.groupBy(*keys, "k", "n").agg(F.percentile_approx("v", steps, ACCURACY).alias("s"))
        place = F.floor(F.col("k") / (F.col("n") - 1) * 400).cast("int")
        ends = sketch.select(*keys, "k", F.get("s", F.greatest(place - 1, F.lit(0))).alias("low"), F.get("s", F.least(place + 2, F.lit(400))).alias("high"))
        ends = cut_lineage(ends, "quantile-ends")
        held = rows.join(ends, _same(rows, ends, keys)).select(*[ends[c] for c in keys], "v", ends["k"], "low", "high")
        part = F.when(F.col("v") < F.col("low"), 0).when(F.col("v") == F.col("low"), 1).when(F.col("v") < F.col("high"), 2).when(F.col("v") == F.col("high"), 3).otherwise(4)
        held = held.withColumn("part", part)
        counts = held.groupBy(*keys, "k", "low", "high").agg(*[F.count_if(F.col("part") == i).alias(f"c{i}") for i in range(5)])
        before, whole = F.lit(0), F.when(F.lit(False), 0)
        start = F.when(F.lit(False), F.lit(0).cast("long"))
        for i in range(5):
            here = (F.col("k") >= before) & (F.col("k") < before + F.col(f"c{i}"))
            whole, start = whole.when(here, i), start.when(here, before)
            before = before + F.col(f"c{i}")
        chosen = cut_lineage(counts.select(*keys, "low", "high", whole.alias("chosen"), (F.col("k") - start).cast("long").alias("k")), "quantile-parts")
        at_end = chosen.where("chosen IN (1, 3)").select(*keys, F.when(F.col("chosen") == 1, F.col("low")).otherwise(F.col("high")).alias("v"))
        found = found.unionByName(at_end)
        asked = chosen.where("chosen IN (0, 2, 4)").select(*keys, "k", "chosen")
        if asked.isEmpty():
            return found
        left = cut_lineage(held.join(asked, _same(held, asked, keys) & (held["part"] == asked["chosen"])).select(*[asked[c] for c in keys], "v"), "quantile-values")
        asked = asked.drop("chosen")


def exact_quantiles(values: DataFrame, by: list[str], value: str, q: float, small: int = SORTED, out: str = "limit") -> DataFrame:
    """by, ``out``: the q-quantile of each group's values, linear between ranks; nulls and NaN don't count, and a
    group without values has no row. Groups of up to ``small`` values are left to Spark's percentile."""
    if not 0 <= q <= 1:
        raise ValueError("q lies between 0 and 1")
    v, names, by = F.col(value).cast("double"), by, [f"__by{i}" for i in range(len(by))]  # no clash with columns of its own
    rows = values.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(b) for c, b in zip(names, by, strict=True)], v.alias("v"))
    return _quantiles(rows, by, q, small, out).select(*[F.col(b).alias(c) for c, b in zip(names, by, strict=True)], out)


def _quantiles(rows: DataFrame, by: list[str], q: float, small: int, out: str) -> DataFrame:
    groups = cut_lineage(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "quantile-groups")
    large, few = groups.where(F.col("n") > small), groups.where(F.col("n") <= small)
    if large.isEmpty():
        return rows.groupBy(*by).agg(F.percentile("v", F.lit(q)).alias(out))
    done = rows.join(few, _same(rows, few, by), "left_semi").groupBy(*by).agg(F.percentile("v", F.lit(q)).alias(out))
    at = F.lit(q) * (F.col("n") - 1)
    ranks = large.select(*by, F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
    kept = rows.join(large, _same(rows, large, by), "left_semi")
    two = select_ranks(kept, ranks, by, small).groupBy(*by).agg(F.min_by("v", "rank").alias("a"), F.max_by("v", "rank").alias("b"))
    named = two.join(large, _same(two, large, by)).select(*[two[c] for c in by], "a", "b", (at - F.floor(at)).alias("share"))
    return done.unionByName(named.select(*by, _between("a", "b", F.col("share")).alias(out)))
