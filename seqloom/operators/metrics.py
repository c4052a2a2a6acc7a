"""Alignment and classification metrics as DataFrames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed scoring styles: costs of deletion, substitution, insertion, and which of them (0 deletion,
#: 1 substitution or hit, 2 insertion) is taken first among equals.
STYLES = {"htk": ((7, 10, 7), (1, 0, 2)), "nist": ((3, 4, 3), (0, 1, 2))}
ALIGNMENT = (
    "struct<dist:long,hits:long,deletions:long,substitutions:long,insertions:long,pairs:array<struct<truth:string,pred:string>>>"
)


#: Cells (truth x pred) whose steps are held at once; of more, half of the rows are halved again.
STEPS = 4_000_000


def _row(t: int, p: np.ndarray, above: np.ndarray, costs: tuple[int, int, int], order: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The next row of least costs, and the step into each of its cells (the first in ``order`` of equals)."""
    m = len(p)
    gone = above + costs[0]
    met = np.empty(m + 1, dtype=np.int64)
    met[0], met[1:] = np.iinfo(np.int64).max // 2, above[:-1] + np.where(p == t, 0, costs[1])
    before = np.minimum(gone, met)
    # insertions follow each other: the least of what lies to the left, by its distance
    shift = np.arange(m + 1) * costs[2]
    row = np.minimum.accumulate(before - shift) + shift
    new = np.concatenate([[np.iinfo(np.int64).max // 2], row[:-1] + costs[2]])
    step = np.zeros(m + 1, dtype=np.uint8)
    taken = np.zeros(m + 1, dtype=bool)
    for action in order:
        here = ((gone, met, new)[action] == row) & ~taken
        step[here] = action
        taken |= here
    return row, step


def _steps(t: np.ndarray, p: np.ndarray, costs: tuple[int, int, int], order: tuple[int, int, int]) -> list[int]:
    """The steps of the alignment of least cost that, from the end, takes the first in ``order`` among equals.

    For long inputs the cell where this path enters the middle row is carried along the rows below it, and
    both sides of that cell are aligned on their own: the same path, in memory of a row.
    """
    n, m = len(t), len(p)
    if n < 2 or n * m <= STEPS:
        above, steps = np.arange(m + 1) * costs[2], []
        for x in t:
            above, step = _row(x, p, above, costs, order)
            steps.append(step)
        path, i, j = [], n, m
        while i or j:
            action = 2 if i == 0 else 0 if j == 0 else int(steps[i - 1][j])
            path.append(action)
            i, j = i - (action != 2), j - (action != 0)
        return path[::-1]
    middle = n // 2
    above, crossing = np.arange(m + 1) * costs[2], np.arange(m + 1)
    for i, x in enumerate(t):
        above, step = _row(x, p, above, costs, order)
        if i >= middle:
            step[0] = 0
            came = np.where(step == 0, crossing, np.concatenate([[0], crossing[:-1]]))
            # an insertion came from where the last other step of the row did
            source = np.maximum.accumulate(np.where(step != 2, np.arange(m + 1), 0))
            crossing = came[source]
    at = int(crossing[m])
    return _steps(t[:middle], p[:at], costs, order) + _steps(t[middle:], p[at:], costs, order)


def _align(truth: list[str], pred: list[str], costs: tuple[int, int, int], order: tuple[int, int, int]) -> dict:
    """One alignment of least cost; among equal steps the earliest in ``order``."""
    number = {x: k for k, x in enumerate(dict.fromkeys([*truth, *pred]))}
    codes = [np.array([number[x] for x in side], dtype=np.int64) for side in (truth, pred)]
    path = _steps(*codes, costs, order)
    pairs, i, j = [], 0, 0
    for action in path:
        pairs.append((truth[i] if action != 2 else None, pred[j] if action != 0 else None))
        i, j = i + (action != 2), j + (action != 0)
    hits = sum(t is not None and t == p for t, p in pairs)
    gone, new = path.count(0), path.count(2)
    other = len(pairs) - hits - gone - new
    return {"dist": gone * costs[0] + other * costs[1] + new * costs[2], "hits": hits, "deletions": gone, "substitutions": other, "insertions": new, "pairs": pairs}


def align(df: DataFrame, truth: str = "truth", pred: str = "pred", costs: tuple[int, int, int] = (7, 10, 7),
          order: tuple[int, int, int] = (1, 0, 2), style: str | None = "htk", out: str = "alignment") -> DataFrame:
    """Weighted edit distance of two token arrays, with counts and the aligned pairs.

    A pair without ``pred`` is a deletion, one without ``truth`` an insertion, those at the beginning
    too. A style overrides costs and order. Null arrays count as empty. Time goes with the product of
    the two lengths, memory with their sum.
    """
    costs, order = STYLES.get((style or "").lower(), (costs, order))

    @F.pandas_udf(ALIGNMENT)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [_align(list(x) if x is not None else [], list(y) if y is not None else [], costs, order) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame(found, columns=["dist", "hits", "deletions", "substitutions", "insertions", "pairs"])

    return df.withColumn(out, run(truth, pred))


def token_accuracy(alignment: str = "alignment", truth: str = "truth") -> Column:
    n, a = F.size(truth), F.col(alignment)
    return F.try_divide((n - a["deletions"] - a["substitutions"] - a["insertions"]).cast("double"), n)


def token_correctness(alignment: str = "alignment", truth: str = "truth") -> Column:
    n, a = F.size(truth), F.col(alignment)
    return F.try_divide((n - a["deletions"] - a["substitutions"]).cast("double"), n)


def alignment_confusion(aligned: DataFrame, alignment: str = "alignment", borders: bool = True) -> DataFrame:
    """(truth, pred, n) of all pairs. Without ``borders`` the deletions and insertions before the first
    aligned token of each row are left out."""
    pairs = F.col(f"{alignment}.pairs")
    if not borders:
        kept = F.aggregate(
            pairs, F.struct(F.lit(False).alias("on"), F.lit(0).alias("skip")),
            lambda s, p: F.struct((s["on"] | (p["truth"].isNotNull() & p["pred"].isNotNull())).alias("on"),
                                  F.when(s["on"] | (p["truth"].isNotNull() & p["pred"].isNotNull()), s["skip"]).otherwise(s["skip"] + 1).alias("skip")),
            lambda s: s["skip"],
        )
        pairs = F.slice(pairs, kept + 1, F.size(pairs))
    cells = aligned.select(F.explode(pairs).alias("p"))
    return cells.groupBy(F.col("p.truth").alias("truth"), F.col("p.pred").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred", labels: DataFrame | None = None) -> DataFrame:
    """(truth, pred, n), with zeros, over the grid of ``labels`` (one column label) or of all that occur.

    Rows whose truth or prediction isn't among the labels don't count.
    """
    seen = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        labels = seen.select(F.col("truth").alias("label")).union(seen.select("pred")).where("label IS NOT NULL").distinct()
    # as many labels as there are classes
    grid = labels.select(F.col("label").alias("truth")).crossJoin(F.broadcast(labels.select(F.col("label").alias("pred"))))
    return grid.join(seen, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def normalised_confusion(cm: DataFrame) -> DataFrame:
    """Shares of each true class; NaN for a class without rows."""
    total = F.sum("n").over(Window.partitionBy("truth"))
    return cm.select("truth", "pred", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(float("nan"))).alias("share"))


def expand_confusion(cm: DataFrame) -> DataFrame:
    """One row (truth, pred) for each count of the matrix."""
    return cm.where("n > 0").select("truth", "pred", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("truth", "pred")


def class_report(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class and of accuracy, macro and weighted averages."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    rows = cm.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    columns = cm.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    each = rows.join(columns, "label").select(
        F.col("label").cast("string").alias("label"), share(F.col("hits"), F.col("predicted")).alias("precision"),
        share(F.col("hits"), F.col("support")).alias("recall"), share(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"), "support", "hits",
    )
    total = each.agg(
        F.sum("support").alias("support"), share(F.sum("hits"), F.sum("support")).alias("acc"),
        *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[share(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")],
    )
    line = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), *[F.col(x).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f, "f1"))])
    extra = total.select("support", F.explode(F.array(
        line("accuracy", "acc", "acc", "acc"), line("macro avg", "m_precision", "m_recall", "m_f1"), line("weighted avg", "w_precision", "w_recall", "w_f1"),
    )).alias("l"))
    return each.drop("hits").unionByName(extra.select("l.label", "l.precision", "l.recall", "l.f1", "support"))


def accuracy(df: DataFrame, truth: str = "truth", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(truth).eqNullSafe(F.col(pred))).cast("double")).alias("accuracy"))


def fold_mean_accuracy(df: DataFrame, fold: str = "fold", by: list[str] | None = None) -> DataFrame:
    """The unweighted mean over folds of their accuracies."""
    return accuracy(df, by=[*(by or []), fold]).groupBy(*(by or [])).agg(F.avg("accuracy").alias("accuracy"))


def mutual_information(cm: DataFrame, prior: DataFrame) -> DataFrame:
    """Bits that the prediction tells about the truth: ``cm`` (truth, pred, n), ``prior`` (truth, p).

    Rows of the matrix are normalised; cells of 0 count nothing; a class without rows makes it NaN.
    """
    joint = normalised_confusion(cm).join(F.broadcast(prior), "truth")
    marginal = joint.groupBy("pred").agg(F.sum(F.col("p") * F.col("share")).alias("q"))
    plogq = lambda p, q: F.when(p > 0, p * F.log2(q)).otherwise(F.when(F.isnan(p), p).otherwise(0.0))
    given = joint.agg(F.sum(F.col("p") * plogq(F.col("share"), F.col("share"))).alias("given"))
    alone = marginal.agg(F.sum(plogq(F.col("q"), F.col("q"))).alias("alone"))
    return given.crossJoin(F.broadcast(alone)).select((F.col("given") - F.col("alone")).alias("bits"))


def report_lines(cm: DataFrame, summary: DataFrame, wide: int = 5) -> list[str]:
    """A text report: overall counts, then the confusion matrix with deletions and insertions.

    ``summary`` has one row: hits, deletions, substitutions, insertions, n. Both are as small as the
    alphabet; they are read on the driver.
    """
    s = summary.first()
    n = max(1, s["n"])
    corr, acc = (n - s["deletions"] - s["substitutions"]) / n, (n - s["deletions"] - s["substitutions"] - s["insertions"]) / n
    cells = {(r["truth"], r["pred"]): r["n"] for r in cm.toLocalIterator()}
    labels = sorted({x for key in cells for x in key if x is not None})
    w = max([1, *(int(math.log10(v)) + 1 for v in cells.values() if v > 0)]) + 2
    name = max([3, *(min(wide, len(x)) for x in labels)])
    out = ["Overall results", f"WORD: %Corr={100 * corr:.2f}, Acc={100 * acc:.2f} [H={s['hits']}, D={s['deletions']}, S={s['substitutions']}, I={s['insertions']}, N={s['n']}]"]
    out += ["Confusion matrix", " " * name + "".join(x[:wide].rjust(w + 1) for x in labels) + "  Del [ %c / %e ]"]
    for t in labels:
        row = [cells.get((t, p), 0) for p in labels]
        total, wrong = sum(row), sum(row) - cells.get((t, t), 0)
        tail = f" [{100 * (total - wrong) / total:.1f}/{100 * wrong / n:.1f}]" if wrong else ""
        out.append(t[:wide].rjust(name) + "".join(str(v).rjust(w + 1) for v in row) + str(cells.get((t, None), 0)).rjust(5) + tail)
    out.append("Ins".rjust(name) + "".join(str(cells.get((None, p), 0)).rjust(w + 1) for p in labels))
    return out
