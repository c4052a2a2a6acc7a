"""Decoding with a beam, and lattices of tokens.

An utterance is a row, as in ``hmm``. The search holds hypotheses (token, frame at which it began), each
with the scores of its states; those that fall behind the best of a frame by more than the beam go. What
is left at a token's end becomes a link ``start, stop, token, score``: frames start to stop - 1 are the
token's, and the score is that of the best way through it, with the move out of it unless the utterance
ends there. A path costs the sum of its links' scores and the insertion penalty for each link but the first.

Without a beam the lattice has every token between any two frames, so frames^2 / 2 x tokens links.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.decoding import TABLE_LIMIT
from seqloom.operators.hmm import HmmModel, _moves

LINK = "struct<start:int,stop:int,token:string,score:double,through:double,posterior:double>"
_FOUND = f"struct<links:array<{LINK}>,tokens:array<string>,score:double>"


class _Links:
    """Links of one utterance as columns, with what the tokens may follow, begin and end."""

    def __init__(self, start, stop, token, score, n_frames: int, allowed: np.ndarray | None, first: np.ndarray, last: np.ndarray, penalty: float):
        self.start, self.stop, self.token, self.score = (np.asarray(x) for x in (start, stop, token, score))
        self.n_frames, self.first, self.last, self.penalty = n_frames, first, last, penalty
        self.barred = np.zeros((len(first), len(first))) if allowed is None else np.where(allowed, 0.0, -np.inf)

    def take(self, keep: np.ndarray) -> None:
        self.start, self.stop, self.token, self.score = (x[keep] for x in (self.start, self.stop, self.token, self.score))

    def _sweep(self, score: np.ndarray, add, forward: bool) -> np.ndarray:
        """For each link what comes before it (or after it), with the penalty for going from link to link;
        ``add`` is maximum or logaddexp."""
        n = len(self.first)
        here, there = (self.start, self.stop) if forward else (self.stop, self.start)
        edge, barred = (self.first, self.barred.T) if forward else (self.last, self.barred)
        begin = 0 if forward else self.n_frames
        at = np.full((self.n_frames + 1, n), -np.inf)  # sums of links that arrive at a boundary, by token
        out = np.full(len(score), -np.inf)
        order = np.argsort(here, kind="stable")
        order = order if forward else order[::-1]
        cuts = np.flatnonzero(np.diff(here[order])) + 1
        for some in np.split(order, cuts) if len(order) else []:
            boundary = here[some[0]]
            if boundary == begin:
                held = np.where(edge, 0.0, -np.inf)
            else:
                held = add.reduce(at[boundary][None, :] + barred, axis=1) + self.penalty
            out[some] = held[self.token[some]]
            add.at(at, (there[some], self.token[some]), out[some] + score[some])
        return out

    def best_through(self) -> np.ndarray:
        return self._sweep(self.score, np.maximum, True) + self.score + self._sweep(self.score, np.maximum, False)

    def posteriors(self, scale: float) -> np.ndarray:
        """Each link's share of all paths, whose scores are multiplied by ``scale``."""
        whole, self.penalty = self.penalty, self.penalty * scale
        score = self.score * scale
        through = self._sweep(score, np.logaddexp, True) + score + self._sweep(score, np.logaddexp, False)
        self.penalty = whole
        return np.exp(through - np.logaddexp.reduce(through[self.start == 0]))

    def best_path(self, through: np.ndarray) -> list[int]:
        """Tokens of the best path, from the front; of equal ones the link that ends first, then the first token."""
        tokens, at, behind = [], 0, None
        ahead = self._sweep(self.score, np.maximum, False) + self.score
        while at < self.n_frames:
            here = np.flatnonzero((self.start == at) & np.isfinite(through))
            value = ahead[here] + (np.where(self.first[self.token[here]], 0.0, -np.inf) if behind is None else self.barred[behind, self.token[here]])
            ties = here[value >= value.max() - 1e-9 * max(1.0, abs(value.max()))]
            pick = ties[np.lexsort((self.token[ties], self.stop[ties]))[0]]
            behind, at = int(self.token[pick]), int(self.stop[pick])
            tokens.append(behind)
        return tokens


def find_links(
    b: np.ndarray, stay: np.ndarray, on: np.ndarray, skip: np.ndarray, allowed: np.ndarray | None, first: np.ndarray, last: np.ndarray, penalty: float, beam: float
) -> _Links:
    """The links that a search through b[frame, token, state] with a beam leaves."""
    n, tokens, k = b.shape
    barred = None if allowed is None else np.where(allowed, 0.0, -np.inf)
    found: list[tuple[np.ndarray, ...]] = []
    token, began = np.flatnonzero(first), np.zeros(int(first.sum()), dtype=int)
    entry = np.zeros(len(token))
    total = np.full((len(token), k), -np.inf)
    total[:, 0] = b[0, token, 0]
    for i in range(1, n):
        top = total.max(initial=-np.inf)
        total[total < top - beam] = -np.inf
        alive = np.isfinite(total).any(axis=1)
        token, began, entry, total = token[alive], began[alive], entry[alive], total[alive]
        leave = total[:, -1] + on[token, -1]
        done = np.isfinite(leave)
        found.append((began[done], np.full(int(done.sum()), i), token[done], (leave - entry)[done]))
        best = np.full(tokens, -np.inf)
        np.maximum.at(best, token[done], leave[done])
        enter = (np.full(tokens, best.max(initial=-np.inf)) if barred is None else (best[:, None] + barred).max(axis=0)) + penalty
        new = total + stay[token]
        new[:, 1:] = np.maximum(new[:, 1:], total[:, :-1] + on[token, :-1])
        new[:, 2:] = np.maximum(new[:, 2:], total[:, :-2] + skip[token, :-2])
        into = np.flatnonzero(np.isfinite(enter))
        fresh = np.full((len(into), k), -np.inf)
        fresh[:, 0] = enter[into]
        token, began, entry = np.concatenate([token, into]), np.concatenate([began, np.full(len(into), i)]), np.concatenate([entry, enter[into]])
        total = np.concatenate([new, fresh]) + b[i, token]
    ends = np.isfinite(total[:, -1]) & last[token]
    found.append((began[ends], np.full(int(ends.sum()), n), token[ends], (total[:, -1] - entry)[ends]))
    return _Links(*(np.concatenate(x) for x in zip(*found, strict=True)), n, allowed, first, last, penalty)


def with_lattices(model: HmmModel, dataset: DataFrame, beam: float = np.inf, lattice_beam: float | None = None, scale: float = 1.0) -> DataFrame:
    """``dataset`` with ``lattice``: links (array of start, stop, token, score, through, posterior), and the
    ``tokens`` and ``score`` of the best path.

    ``through`` is the score of the best path that has the link; links that fall behind the best path by more than
    ``lattice_beam`` (the beam if None), and those on no whole path, go. ``posterior`` is the link's share of all
    paths that are left, with scores multiplied by ``scale``. Without frames there are no links and no
    tokens; where no path is left or a frame can't be used, tokens and score are null.
    """
    densities, (allowed, first, last), penalty = model._frames(), model._allowed(), model.insertion_penalty
    n, k = model.models.means.shape[:2]
    moves = [x.reshape(n, k) for x in _moves(model.models, np.repeat(np.arange(n), k), np.tile(np.arange(k), n))]
    behind = beam if lattice_beam is None else lattice_beam
    names = model._names()

    @F.pandas_udf(_FOUND)
    def search(rows: pd.Series) -> pd.DataFrame:
        out = []
        for frames in rows:
            if frames is None or not len(frames):
                out.append(([], [], None))
                continue
            b = densities(frames)
            if b is None:
                out.append(([], None, None))
                continue
            links = find_links(b, *moves, allowed, first, last, penalty, beam)
            through = links.best_through()
            best = through.max(initial=-np.inf)
            if not np.isfinite(best):
                out.append(([], None, None))
                continue
            keep = np.isfinite(through) & (through >= best - behind - 1e-9 * max(1.0, abs(best)))  # sums of one path differ by rounding
            links.take(keep)
            through = through[keep]
            share = links.posteriors(scale)
            path = [names[i] for i in links.best_path(through)]
            order = np.lexsort((links.token, links.stop, links.start))
            rows_of = [
                {"start": int(links.start[j]), "stop": int(links.stop[j]), "token": names[links.token[j]], "score": float(links.score[j]),
                 "through": float(through[j]), "posterior": float(share[j])} for j in order
            ]
            out.append((rows_of, path, float(best)))
        return pd.DataFrame(out, columns=["links", "tokens", "score"])

    return dataset.withColumn("lattice", search("frames"))


def link_rows(found: DataFrame, key: str = "utterance_id") -> DataFrame:
    """The links of ``with_lattices`` as a table: key, start, stop, token, score, through, posterior."""
    return found.select(key, F.inline("lattice.links"))


def rescored(found: DataFrame, pairs: DataFrame, scale: float = 1.0, penalty: float = 0.0, default: float = -np.inf, begin: str | None = None) -> DataFrame:
    """``found`` (of ``with_lattices``) with ``rescored``: tokens and score of the best path when a move from token to token
    costs ``scale`` times its logarithm in ``pairs`` (before, token, logp) and the ``penalty``.

    What may follow what is told by ``pairs`` alone here. Pairs that the table hasn't cost ``default``. With ``begin`` the first token follows that one. The table is
    collected: its rows are counted first, and more than ``decoding.TABLE_LIMIT`` are refused.
    """
    if pairs.limit(TABLE_LIMIT + 1).count() > TABLE_LIMIT:
        raise ValueError(f"more than {TABLE_LIMIT} pairs can't be sent to every task")
    table = {(r["before"], r["token"]): float(r["logp"]) for r in pairs.select("before", "token", "logp").toLocalIterator()}

    @F.pandas_udf("struct<tokens:array<string>,score:double>")
    def best(rows: pd.Series) -> pd.DataFrame:
        out = []
        for links in rows:
            if links is None or not len(links):
                out.append(([], None))
                continue
            end = max(x["stop"] for x in links)
            # by boundary and token: the best score, and the way there
            held: dict[int, dict[str, tuple[float, tuple]]] = {}
            for x in sorted(links, key=lambda x: (x["start"], x["stop"], x["token"])):
                token = x["token"]
                if x["start"] == 0:
                    ways = [(0.0 if begin is None else scale * table.get((begin, token), default), ())]
                else:
                    ways = [(s + penalty + scale * table.get((a, token), default), way) for a, (s, way) in held.get(x["start"], {}).items()]
                if ways:
                    score, way = max(ways, key=lambda w: w[0])
                    at = held.setdefault(x["stop"], {})
                    if np.isfinite(score) and (token not in at or score + x["score"] > at[token][0]):
                        at[token] = (score + x["score"], (way, token))
            if not held.get(end):
                out.append((None, None))
                continue
            score, way = max(held[end].values(), key=lambda w: w[0])
            tokens = []
            while way:
                way, token = way
                tokens.append(token)
            out.append((tokens[::-1], float(score)))
        return pd.DataFrame(out, columns=["tokens", "score"])

    return found.withColumn("rescored", best("lattice.links"))


def recall_by_beam(model: HmmModel, dataset: DataFrame, beams: Sequence[float], key: str = "utterance_id") -> DataFrame:
    """For each beam: utterances, how many get the best path of all (by its score), and the links of their lattices."""
    rows = dataset.where("size(frames) > 0").select(key, "frames")
    for i, beam in enumerate([np.inf, *beams]):
        rows = with_lattices(model, rows, beam, 0.0 if i == 0 else beam).withColumn(f"score_{i}", F.col("lattice.score"))
        rows = rows.withColumn(f"links_{i}", F.size("lattice.links")).drop("lattice")
    same = lambda i: F.coalesce(F.abs(F.col(f"score_{i}") - F.col("score_0")) <= 1e-9 * F.greatest(F.abs("score_0"), F.lit(1.0)), F.col("score_0").isNull())
    each = F.array(*[F.struct(F.lit(float(beam)).alias("beam"), same(i).cast("int").alias("same"), F.col(f"links_{i}").alias("links")) for i, beam in enumerate(beams, 1)])
    found = rows.select(F.inline(each)).groupBy("beam")
    return found.agg(F.count(F.lit(1)).alias("utterances"), F.sum("same").alias("same"), (F.sum("same") / F.count(F.lit(1))).alias("recall"), F.sum("links").alias("links"))
