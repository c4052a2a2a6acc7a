"""States of tokens with neighbours tied by trees of questions.

Models of tokens with neighbours are many and most of them rare. For each state of each centre token a tree is
grown from the statistics of that state in all contexts: the context tokens of a leaf are split by the
question about a left or right neighbour that gains most likelihood, if it gains ``min_gain`` and leaves
``min_occupancy`` frames on both sides. Leaves whose union would lose less than ``min_gain`` are merged
again. All contexts of a leaf share their state; contexts that training never saw go down the tree.

Frames are summed by Spark; a tree sees a row for each context. Trees are independent and grown in tasks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.hmm import TokenModels, context_parts, statistics_rows

#: A question: the side, and the neighbours for which the answer is yes ('' for none).
Question = tuple[str, frozenset]
NODES = "centre string, state int, node int, side string, asked array<string>, yes int, no int, cluster int, n double, gain double, mean array<double>, variance array<double>"


def context_statistics(utterances: DataFrame, model: TokenModels) -> DataFrame:
    """token, centre, before, after, state, n, s, ss: frames, sums and sums of squares of each state of each context token."""
    width = model.means.shape[3]
    at = lambda d: d * width + d if model.full else d
    total = lambda c, places: F.array(*[F.sum(F.get(c, F.lit(p))) for p in places])
    sums = statistics_rows(utterances, model).groupBy("token", "state").agg(
        F.sum("n").alias("n"), total("s", range(width)).alias("s"), total("ss", [at(d) for d in range(width)]).alias("ss")
    )
    before, rest = F.regexp_extract("token", r"^(.*)-", 1), F.regexp_replace("token", r"^.*-", "")
    sides = sums.select("token", before.alias("before"), F.split(rest, r"\\+", 2).alias("r"), "state", "n", "s", "ss")
    return sides.select("token", F.col("r")[0].alias("centre"), "before", F.coalesce(F.get("r", F.lit(1)), F.lit("")).alias("after"), "state", "n", "s", "ss")


def neighbour_questions(tokens: Iterable[str], sets: Iterable[Iterable[str]] = ()) -> list[Question]:
    """Questions about each neighbour, its absence, and each of ``sets`` of neighbours, on both sides."""
    asked = [frozenset([t]) for t in sorted({*tokens, ""})] + [frozenset(s) for s in sets]
    return [(side, q) for side in ("before", "after") for q in asked]


def likelihood(n: float, s: np.ndarray, ss: np.ndarray, floor: float = 1e-3) -> float:
    """The log likelihood of frames under their own mean and variances."""
    variance = np.maximum(ss / n - (s / n) ** 2, floor)
    return -0.5 * n * (len(s) * np.log(2 * np.pi) + np.log(variance).sum() + ((ss / n - (s / n) ** 2) / variance).sum())


def _grow(questions: list[Question], min_occupancy: float, min_gain: float, merge: bool):
    def grown(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("token")
        n, s, ss = group["n"].to_numpy(float), np.stack(group["s"]).astype(float), np.stack(group["ss"]).astype(float)
        answers = [(q, group[q[0]].isin(q[1]).to_numpy()) for q in questions]
        total = lambda rows: (n[rows].sum(), s[rows].sum(axis=0), ss[rows].sum(axis=0))
        nodes: list[dict] = []
        leaves: list[tuple[int, np.ndarray]] = []
        open_ = [(0, np.ones(len(group), dtype=bool))]
        nodes.append({})
        while open_:
            at, rows = open_.pop()
            whole = likelihood(*total(rows))
            best = None
            for (side, asked), yes in answers:
                a, b = rows & yes, rows & ~yes
                if n[a].sum() >= max(min_occupancy, 1e-9) and n[b].sum() >= max(min_occupancy, 1e-9):
                    gain = likelihood(*total(a)) + likelihood(*total(b)) - whole
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, side, sorted(asked), a, b)
            if best is None or best[0] < min_gain:
                nodes[at] = {"node": at, "side": None, "asked": None, "yes": -1, "no": -1, "gain": 0.0}
                leaves.append((at, rows))
                continue
            gain, side, asked, a, b = best
            nodes[at] = {"node": at, "side": side, "asked": asked, "yes": len(nodes), "no": len(nodes) + 1, "gain": gain}
            open_ += [(len(nodes) + 1, b), (len(nodes), a)]
            nodes += [{}, {}]
        clusters = [[leaf] for leaf in sorted(leaves, key=lambda x: x[0])]
        rows_of = lambda c: np.any([r for _, r in c], axis=0)
        while merge and len(clusters) > 1:
            loss = {}
            for i in range(len(clusters)):
                for j in range(i + 1, len(clusters)):
                    a, b = rows_of(clusters[i]), rows_of(clusters[j])
                    loss[i, j] = likelihood(*total(a)) + likelihood(*total(b)) - likelihood(*total(a | b))
            (i, j), least = min(loss.items(), key=lambda x: (x[1], x[0]))
            if least >= min_gain:
                break
            clusters[i] += clusters.pop(j)
        for k, cluster in enumerate(clusters):
            count, sums, squares = total(rows_of(cluster))
            mean = sums / count
            for at, _ in cluster:
                nodes[at] |= {"cluster": k, "n": count, "mean": mean.tolist(), "variance": np.maximum(squares / count - mean**2, 1e-3).tolist()}
        head = {"centre": group["centre"].iloc[0], "state": group["state"].iloc[0]}
        inner = {"cluster": -1, "n": 0.0, "mean": None, "variance": None}
        return pd.DataFrame([head | inner | x for x in nodes])[[c.split()[0] for c in NODES.split(", ")]]

    return grown


def grow_trees(statistics: DataFrame, questions: list[Question], min_occupancy: float = 100.0, min_gain: float = 350.0, merge: bool = True) -> DataFrame:
    """The nodes of the trees (``NODES``; node 0 is the root, side is null in leaves) from ``context_statistics``."""
    rows = statistics.where("n > 0").select("token", "centre", "before", "after", "state", "n", "s", "ss")
    return rows.groupBy("centre", "state").applyInPandas(_grow(questions, min_occupancy, min_gain, merge), NODES)


@dataclass
class StateTrees:
    """Trees in the driver: as many nodes as there are states of context tokens at most."""

    nodes: dict[tuple[str, int], dict[int, tuple]]

    @staticmethod
    def of(rows: DataFrame) -> StateTrees:
        nodes: dict[tuple[str, int], dict[int, tuple]] = {}
        for r in rows.toLocalIterator():
            nodes.setdefault((r["centre"], r["state"]), {})[r["node"]] = (r["side"], frozenset(r["asked"] or ()), r["yes"], r["no"], r["cluster"], r["n"], r["mean"], r["variance"])
        return StateTrees(nodes)

    def place(self, token: str, state: int) -> tuple[str, int, int] | None:
        """The cluster of a state of a context token, seen or not: centre, state, number; None without a tree."""
        before, centre, after = context_parts(token)
        tree = self.nodes.get((centre, state))
        if tree is None:
            return None
        at = 0
        while tree[at][0] is not None:
            side, asked, yes, no = tree[at][:4]
            at = yes if ((before if side == "before" else after) or "") in asked else no
        return centre, state, tree[at][4]

    def ties(self, model: TokenModels) -> np.ndarray:
        """A number for each [token, state], equal for states that are shared; plain tokens share with none."""
        known: dict = {}
        out = np.zeros(model.mean.shape[:2], dtype=np.int64)
        for i, t in enumerate(model.tokens):
            for j in range(out.shape[1]):
                cluster = self.place(t, j) if context_parts(t)[0] or context_parts(t)[2] else None
                out[i, j] = known.setdefault(cluster or (i, j), len(known))
        return out

    def tied(self, model: TokenModels, contexts: Iterable[str] = ()) -> TokenModels:
        """``model`` with the mean and variance of its cluster for each state of its context tokens, and with models of
        further ``contexts``, placed by the trees. Mixtures stand half a deviation around the mean."""
        from seqloom.operators.hmm import with_contexts

        out = with_contexts(model, list(contexts)).copy()
        values = {(c, s, node[4]): node for (c, s), tree in self.nodes.items() for node in tree.values() if node[0] is None}
        mixtures, width = out.means.shape[2:]
        for i, t in enumerate(out.tokens):
            if context_parts(t)[0] or context_parts(t)[2]:
                for j in range(out.mean.shape[1]):
                    cluster = self.place(t, j)
                    if cluster is not None:
                        mean, variance = (np.array(v) for v in values[cluster][6:8])
                        spread = np.linspace(-0.5, 0.5, mixtures)[:, None] if mixtures > 1 else np.zeros((1, 1))
                        out.means[i, j] = mean + spread * np.sqrt(variance)
                        out.variances[i, j] = variance * np.eye(width) if out.full else variance
        return out
