"""Hidden Markov models with Gaussian states: training from labelled utterances, and decoding.

An utterance is one row ``utterance_id, frames array<array<double>>, tokens array<string>`` and, where
it is known, ``ends array<int>``: the frame at which each token ends. Utterances with a frame that is null, of another
width than most or with numbers that are null or not finite can't be trained on, nor those with a null token;
the former aren't decoded (null), the latter are. Each pass of training sends the
model (tokens x states x mixtures x width, checked) to the tasks, which give sufficient statistics for
each token, state and mixture; these are summed by Spark, and the driver gets the sums alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import search

#: Numbers in a model that may be sent to the tasks.
MODEL_LIMIT = 8_000_000
_SUMS = "token string, state int, mixture int, n double, s array<double>, ss array<double>, stay double, skip double, loglik double, utterances long"


@dataclass
class TokenModels:
    """Means, variances and transitions of every token's states, left to right.

    ``mean`` is [token, state, width], or [token, state, mixture, width] with ``weight`` [token, state,
    mixture]; ``variance`` has the same shape, or one axis more for full covariances.
    """

    tokens: list[str]
    mean: np.ndarray
    variance: np.ndarray
    stay: np.ndarray
    skip: np.ndarray
    weight: np.ndarray | None = None

    def __post_init__(self):
        if self.mean.size + self.variance.size > MODEL_LIMIT:
            raise ValueError(f"a model of {self.mean.size + self.variance.size} numbers is too large to send to every task")
        if self.weight is None:
            self.weight = np.full((*self.mean.shape[:2], self.means.shape[2]), 1 / self.means.shape[2])

    @property
    def full(self) -> bool:
        return self.variance.ndim > self.mean.ndim

    @property
    def means(self) -> np.ndarray:
        """[token, state, mixture, width], of the same memory as ``mean``."""
        return self.mean if self.mean.ndim == 4 else self.mean[:, :, None]

    @property
    def variances(self) -> np.ndarray:
        return self.variance if self.mean.ndim == 4 else self.variance[:, :, None]

    def copy(self) -> TokenModels:
        return TokenModels(list(self.tokens), *(x.copy() for x in (self.mean, self.variance, self.stay, self.skip, self.weight)))

    def chain(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Indices (token, state) of the states of a sequence of tokens."""
        at = {t: i for i, t in enumerate(self.tokens)}
        k = self.mean.shape[1]
        return np.repeat([at[t] for t in tokens], k), np.tile(np.arange(k), len(tokens))

    def component_density(self, x: np.ndarray, t: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Log of weight times density: [frame, state of the chain, mixture]."""
        m, v = self.means[t, s], self.variances[t, s]
        away = x[:, None, None, :] - m
        if self.full:
            w, q = np.linalg.eigh(v)
            away = (np.einsum("nsmd,smde->nsme", away, q) ** 2) / w
            spread = np.log(2 * np.pi * w).sum(axis=2)
        else:
            away = away**2 / v
            spread = np.log(2 * np.pi * v).sum(axis=2)
        with np.errstate(divide="ignore"):
            return np.log(self.weight[t, s]) - 0.5 * (away.sum(axis=3) + spread)

    def log_density(self, x: np.ndarray, t: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.logaddexp.reduce(self.component_density(x, t, s), axis=2)


def frame_matrix(frames, width: int) -> np.ndarray | None:
    """Frames as a matrix; None if one is null, of another width, or has a number that is null or not finite."""
    if any(f is None or len(f) != width for f in frames):
        return None
    x = np.stack([np.asarray(f, dtype=float) for f in frames])
    return x if np.isfinite(x).all() else None


def is_labelled(tokens: str = "tokens") -> Column:
    """Whether no token is null."""
    return F.coalesce(F.forall(tokens, lambda t: t.isNotNull()), F.lit(False))


def flat_start(utterances: DataFrame, n_states: int = 8, skip: int = 0, floor: float = 1e-3, n_mixtures: int = 1, full: bool = False) -> TokenModels:
    """All states with the mean and variance of all frames of utterances that can be used (the width is that of most
    of their frames); moves are equally likely, 1 / (skip + 2).

    Mixtures begin side by side, within half a deviation of the mean, with equal weights; full
    covariances begin without covariance.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    one_width = F.array_min(F.transform("frames", F.size)) == F.array_max(F.transform("frames", F.size))
    usable = F.coalesce(F.forall("frames", lambda f: F.coalesce(F.forall(f, finite), F.lit(False))) & one_width, F.lit(False))
    frames = utterances.where(usable).select(F.explode("frames").alias("f")).select(F.size("f").alias("w"), F.posexplode("f").alias("d", "v"))
    found = frames.groupBy("w", "d").agg(F.avg("v").alias("m"), F.var_pop("v").alias("v"), F.count(F.lit(1)).alias("n")).orderBy("w", "d").collect()  # one row for each dimension
    width = max(found, key=lambda r: (r["n"], r["w"]))["w"] if found else 0
    rows = [r for r in found if r["w"] == width]
    tokens = [r[0] for r in utterances.select(F.explode("tokens")).where("col IS NOT NULL").distinct().orderBy("col").toLocalIterator()]
    mean, var = np.array([r["m"] for r in rows]), np.array([max(r["v"], floor) for r in rows])
    if n_mixtures > 1:
        mean = mean + np.linspace(-0.5, 0.5, n_mixtures)[:, None] * np.sqrt(var)
        var = np.tile(var, (n_mixtures, 1))
    if full:
        var = var[..., None] * np.eye(var.shape[-1])
    shape = (len(tokens), n_states)
    p = 1 / (skip + 2)
    return TokenModels(
        tokens, np.tile(mean, (*shape, *([1] * mean.ndim))), np.tile(var, (*shape, *([1] * var.ndim))), np.full(shape, p), np.full(shape, p if skip else 0.0)
    )


def _moves(model: TokenModels, t: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of staying, of moving on and of skipping a state, for each state of a chain."""
    with np.errstate(divide="ignore"):
        stay, skip = model.stay[t, s], model.skip[t, s]
        return np.log(stay), np.log(np.maximum(1 - stay - skip, 1e-300)), np.log(skip)


def _forward_backward(b: np.ndarray, stay: np.ndarray, on: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posterior of states, expected stays and skips of each state, and the log likelihood."""
    n, k = b.shape
    gone = lambda v, d: np.concatenate([np.full(d, -np.inf), v])[:k]
    back = lambda v, d: np.concatenate([v[d:], np.full(min(d, k), -np.inf)])[:k]
    f, g = np.full((n, k), -np.inf), np.full((n, k), -np.inf)
    f[0, 0] = b[0, 0]
    for i in range(1, n):
        f[i] = b[i] + np.logaddexp(np.logaddexp(f[i - 1] + stay, gone(f[i - 1] + on, 1)), gone(f[i - 1] + skip, 2))
    g[-1, -1] = 0.0
    for i in range(n - 2, -1, -1):
        nxt = b[i + 1] + g[i + 1]
        g[i] = np.logaddexp(np.logaddexp(stay + nxt, on + back(nxt, 1)), skip + back(nxt, 2))
    total = f[-1, -1]
    if not np.isfinite(total):
        return np.zeros((n, k)), np.zeros(k), np.zeros(k), total
    moved = b[1:] + g[1:]
    stays = np.exp(f[:-1] + stay + moved - total).sum(axis=0)
    ahead = np.concatenate([moved[:, 2:], np.full((n - 1, min(2, k)), -np.inf)], axis=1)[:, :k]
    return np.exp(f + g - total), stays, np.exp(f[:-1] + skip + ahead - total).sum(axis=0), float(total)


def _spread(n_frames: int, n_states: int) -> np.ndarray:
    """The state of each frame if all states last equally long."""
    return np.minimum(np.arange(n_frames) * n_states // max(1, n_frames), n_states - 1)


def _statistics(model: TokenModels, uniform: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n_tokens, k, mixtures, width = model.means.shape
        n, s = np.zeros((n_tokens, k, mixtures)), np.zeros(model.means.shape)
        ss = np.zeros((*model.means.shape, width) if model.full else model.means.shape)
        stay, skip, loglik, count = np.zeros((n_tokens, k)), np.zeros((n_tokens, k)), 0.0, 0
        for batch in batches:
            for frames, tokens, ends in zip(batch["frames"], batch["tokens"], batch["ends"], strict=True):
                if frames is None or tokens is None or not len(frames) or not len(tokens):
                    continue
                x = frame_matrix(frames, width)
                if x is None or any(name is None for name in tokens):
                    continue
                t, st = model.chain(list(tokens))
                parts = model.component_density(x, t, st)
                whole = np.logaddexp.reduce(parts, axis=2)
                if uniform:
                    # each token's span, or else the whole, is cut evenly
                    if ends is not None and len(ends) == len(tokens):
                        stops = np.clip(np.maximum.accumulate(np.asarray(ends, dtype=int)), 0, len(x))
                        spans = np.diff(np.concatenate([[0], stops]))
                        states = np.concatenate([i * k + _spread(m, k) for i, m in enumerate(spans)])
                    else:
                        states = _spread(len(x), len(t))
                    post = np.zeros((len(x), len(t)))
                    post[np.arange(len(states)), states] = 1
                    stays, skips, ll = post.sum(axis=0) - 1, np.zeros(len(t)), 0.0
                else:
                    post, stays, skips, ll = _forward_backward(whole, *_moves(model, t, st))
                if not np.isfinite(ll):
                    continue  # fewer frames than states on the way
                share = post[:, :, None] * np.exp(parts - whole[:, :, None])
                np.add.at(n, (t, st), share.sum(axis=0))
                np.add.at(s, (t, st), np.einsum("nsm,nd->smd", share, x))
                np.add.at(ss, (t, st), np.einsum("nsm,nd,ne->smde", share, x, x, optimize=True) if model.full else np.einsum("nsm,nd->smd", share, x * x))
                np.add.at(stay, (t, st), np.maximum(stays, 0))
                np.add.at(skip, (t, st), skips)
                loglik, count = loglik + ll, count + 1
        used = np.argwhere(n > 0)
        if not len(used):
            return  # a task without rows to train on; lists of a frame without rows have no type
        lead = (used[:, 2] == n.argmax(axis=2)[tuple(used[:, :2].T)]).astype(float)  # moves are told once for each state
        yield pd.DataFrame({
            "token": [model.tokens[i] for i, *_ in used], "state": [int(j) for _, j, _ in used], "mixture": [int(m) for *_, m in used], "n": n[tuple(used.T)],
            "s": [s[tuple(u)] for u in used], "ss": [ss[tuple(u)].ravel() for u in used],
            "stay": stay[tuple(used[:, :2].T)] * lead, "skip": skip[tuple(used[:, :2].T)] * lead,
            "loglik": loglik, "utterances": count,
        })

    return run


def statistics_rows(utterances: DataFrame, model: TokenModels, uniform: bool = False) -> DataFrame:
    """Sums of each task's frames for each token, state and mixture that they reach."""
    ends = F.col("ends").cast("array<int>") if "ends" in utterances.columns else F.lit(None).cast("array<int>")
    return utterances.select("frames", "tokens", ends.alias("ends")).mapInPandas(_statistics(model, uniform), _SUMS)


def reestimate(utterances: DataFrame, model: TokenModels, uniform: bool = False, floor: float = 1e-3, ties: np.ndarray | None = None) -> TokenModels:
    """One pass over all utterances. States and mixtures that no frame reaches stay as they are. ``ties`` has a
    number for each [token, state]; states of one number are estimated from the sums of all of them."""
    rows = statistics_rows(utterances, model, uniform)
    width = model.means.shape[3]
    total = lambda c, m: F.array(*[F.sum(F.get(c, F.lit(d))) for d in range(m)]).alias(c)
    sums = rows.groupBy("token", "state", "mixture").agg(
        F.sum("n").alias("n"), total("s", width), total("ss", width**2 if model.full else width), F.sum("stay").alias("stay"), F.sum("skip").alias("skip")
    )
    out = model.copy()
    at = {t: i for i, t in enumerate(model.tokens)}
    reached, stays, skips = np.zeros_like(out.weight), np.zeros_like(out.stay), np.zeros_like(out.skip)
    _, stands_for, number = (None, None, None) if ties is None else np.unique(ties.ravel(), return_index=True, return_inverse=True)
    held: dict[tuple[int, int, int], list] = {}
    for r in sums.toLocalIterator():  # a row for each token, state and mixture
        i, j = at[r["token"]], r["state"]
        if ties is not None:
            i, j = divmod(int(stands_for[number.ravel()[i * ties.shape[1] + j]]), ties.shape[1])
        key = (i, j, r["mixture"])
        reached[key] += r["n"]
        stays[key[:2]] += r["stay"]
        skips[key[:2]] += r["skip"]
        one = held.setdefault(key, [0.0, 0.0])
        one[0] += np.array(r["s"])
        one[1] += np.array(r["ss"])
    for key, (s, ss) in held.items():
        if (n := reached[key]) > 1e-6:
            mean = s / n
            out.means[key] = mean
            if model.full:
                w, q = np.linalg.eigh(ss.reshape(width, width) / n - np.outer(mean, mean))
                out.variances[key] = (q * np.maximum(w, floor)) @ q.T
            else:
                out.variances[key] = np.maximum(ss / n - mean**2, floor)
    for key in np.argwhere(reached.sum(axis=2) > 1e-6):
        key = tuple(key)
        n = reached[key].sum()
        out.weight[key] = np.maximum(reached[key] / n, 1e-6)
        out.weight[key] /= out.weight[key].sum()
        out.stay[key] = min(max(stays[key] / n, 1e-3), 0.999)
        out.skip[key] = min(skips[key] / n, 0.999 - out.stay[key]) if model.skip[key] > 0 else 0.0
    if ties is not None:
        source = stands_for[number.ravel()]
        for x in (out.mean, out.variance, out.stay, out.skip, out.weight):
            flat = x.reshape(-1, *x.shape[2:])
            flat[:] = flat[source]
    return out


def token_spans(utterances: DataFrame) -> DataFrame:
    """Each token's frames as an utterance of its own, where ``ends`` tells them."""
    each = F.transform(
        F.sequence(F.lit(0), F.size("tokens") - 1),
        lambda i: F.struct(
            F.array(F.get("tokens", i)).alias("tokens"),
            F.coalesce(F.get("ends", i - 1), F.lit(0)).alias("start"), F.get("ends", i).alias("stop"),
        ),
    )
    known = utterances.where("size(tokens) > 0 AND size(ends) = size(tokens)").select("frames", F.explode(each).alias("e"))
    known = known.where("e.stop > e.start AND e.start >= 0 AND e.stop <= size(frames)")
    return known.select(F.slice("frames", F.col("e.start") + 1, F.col("e.stop") - F.col("e.start")).alias("frames"), F.col("e.tokens").alias("tokens"))


def contexts_of(tokens: Column | str, left: bool = True, right: bool = True) -> Column:
    """An array of tokens with their neighbours: l-c+r; without a neighbour that part is missing. A backslash stands
    before each -, + and backslash that is a token's own (``context_name``)."""
    t = F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, lambda x: F.regexp_replace(x, r"([-+\\])", r"\\$1"))
    before = lambda i: F.coalesce(F.concat(F.get(t, i - 1), F.lit("-")), F.lit("")) if left else F.lit("")
    after = lambda i: F.coalesce(F.concat(F.lit("+"), F.get(t, i + 1)), F.lit("")) if right else F.lit("")
    return F.transform(t, lambda x, i: F.concat(before(i), x, after(i)))


class HmmTrainer(Estimator):
    """Flat start, a pass over spans cut evenly, isolated passes where spans are known (column ``ends``),
    then ``n_passes`` of embedded training.

    With ``left`` or ``right`` every token gets models for its neighbours, which are trained for
    ``context_passes``; those seen fewer than ``tie_below`` times share their states then, followed by
    ``context_passes`` more. With ``tree`` (the least occupancy and the least gain of a split) states are tied
    by trees of questions instead (``state_trees``; ``questions`` are sets of neighbours to ask for besides single
    ones), ``unseen`` context tokens get models by the trees, and the model has the ``trees``.

    ``start`` has models to begin with for some tokens or all; the others begin flat.
    """

    def __init__(self, n_states: int = 8, skip: int = 0, n_passes: int = 6, insertion_penalty: float = 0.0, n_mixtures: int = 1, full_covariance: bool = False,
                 isolated_passes: int = 2, left: bool = False, right: bool = False, context_passes: int = 2, tie_below: float | None = None,
                 tree: tuple[float, float] | None = None, questions: tuple = (), unseen: tuple[str, ...] = (), start: TokenModels | None = None):
        super().__init__()
        self.n_states, self.skip, self.n_passes, self.insertion_penalty = n_states, skip, n_passes, insertion_penalty
        self.n_mixtures, self.full_covariance, self.isolated_passes = n_mixtures, full_covariance, isolated_passes
        self.left, self.right, self.context_passes, self.tie_below = left, right, context_passes, tie_below
        self.tree, self.questions, self.unseen, self.start = tree, questions, unseen, start

    def _fit(self, dataset: DataFrame) -> HmmModel:
        model = flat_start(dataset, self.n_states, self.skip, n_mixtures=self.n_mixtures, full=self.full_covariance)
        model = reestimate(dataset, model, uniform=True)
        if self.start is not None:
            model = with_start(model, self.start)
        if "ends" in dataset.columns:
            alone = token_spans(dataset)
            for _ in range(self.isolated_passes):
                model = reestimate(alone, model)
        for _ in range(self.n_passes):
            model = reestimate(dataset, model)
        if self.left or self.right:
            named = dataset.withColumn("tokens", contexts_of("tokens", self.left, self.right))
            # as many rows as tokens have neighbours
            seen = {r[0]: r[1] for r in named.where(is_labelled()).select(F.explode("tokens").alias("t")).groupBy("t").count().toLocalIterator()}
            model = with_contexts(replace(model, tokens=[context_name(t) for t in model.tokens]), sorted(seen))
            for _ in range(self.context_passes):
                model = reestimate(named, model)
            if self.tree is not None:
                from seqloom.operators import state_trees as trees

                asked = trees.neighbour_questions({p for t in seen for p in context_parts(t) if p}, self.questions)
                found = trees.StateTrees.of(trees.grow_trees(trees.context_statistics(named, model), asked, *self.tree))
                model = found.tied(model, self.unseen)
                for _ in range(self.context_passes):
                    model = reestimate(named, model, ties=found.ties(model))
                out = HmmModel(model, self.insertion_penalty, consistent=True)
                out.trees = found
                return out
            if self.tie_below is not None:
                model = tie_states(model, seen, self.tie_below)
                for _ in range(self.context_passes):
                    model = tie_states(reestimate(named, model), seen, self.tie_below)
        return HmmModel(model, self.insertion_penalty, consistent=self.left or self.right)


def with_start(model: TokenModels, start: TokenModels) -> TokenModels:
    """``model`` with what ``start`` has for its tokens; the shapes must agree."""
    if start.mean.shape[1:] != model.mean.shape[1:] or start.full != model.full:
        raise ValueError("the models to begin with have other states, mixtures, width or covariances")
    out, at = model.copy(), {t: i for i, t in enumerate(start.tokens)}
    known = [(i, at[t]) for i, t in enumerate(model.tokens) if t in at]
    for mine, theirs in ((out.mean, start.mean), (out.variance, start.variance), (out.stay, start.stay), (out.skip, start.skip), (out.weight, start.weight)):
        for i, j in known:
            mine[i] = theirs[j]
    return out


def context_name(token: str) -> str:
    """A token as it stands in names with neighbours."""
    return re.sub(r"([-+\\])", r"\\\1", token)


def context_parts(token: str) -> tuple[str | None, str, str | None]:
    """Left neighbour, token, right neighbour; None where the name has none."""
    parts = {"": ""}
    for mark, text in re.findall(r"([-+]?)((?:[^-+\\]|\\.)*)", token, re.DOTALL):
        text = re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)
        if mark == "-":  # what came before is the left neighbour
            parts["left"], parts[""] = parts[""], text
        elif mark == "+":
            parts["right"] = text
        else:
            parts[""] += text
    return parts.get("left") or None, parts[""], parts.get("right") or None


class HmmModel(Model):
    """Viterbi decoding of any sequence of tokens, each of which may be followed by those that
    ``follows`` (pairs of tokens) allows, or by all. With ``consistent`` tokens with neighbours follow
    only the neighbours that they name, and the decoded tokens are their centres."""

    def __init__(self, models: TokenModels, insertion_penalty: float = 0.0, follows: set[tuple[str, str]] | None = None, consistent: bool = False):
        super().__init__()
        self.models, self.insertion_penalty, self.follows, self.consistent = models, insertion_penalty, follows, consistent

    def _allowed(self) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """Which token may follow which (None: all), begin and end an utterance."""
        names = self.models.tokens
        any_end = np.ones(len(names), dtype=bool)
        if not self.consistent:
            if self.follows is None:
                return None, any_end, any_end
            return np.array([[(a, b) in self.follows for b in names] for a in names]), any_end, any_end
        parts = [context_parts(x) for x in names]
        has_left, has_right = any(p[0] for p in parts), any(p[2] for p in parts)
        fits = lambda a, b: (not has_right or a[2] == b[1]) and (not has_left or b[0] == a[1])
        ok = np.array([[fits(a, b) and (self.follows is None or (a[1], b[1]) in self.follows) for b in parts] for a in parts])
        return ok, np.array([not has_left or p[0] is None for p in parts]), np.array([not has_right or p[2] is None for p in parts])

    def _frames(self):
        """A function from frames to the log densities [frame, token, state]; None for frames that can't be used."""
        m = self.models
        n, k, _, width = m.means.shape
        t, s = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)

        def densities(frames) -> np.ndarray | None:
            x = frame_matrix(frames, width)
            return None if x is None else m.log_density(x, t, s).reshape(len(x), n, k)

        return densities

    def _names(self) -> list[str]:
        """What each token is called where it is decoded. Tasks get this list, not the model, which may hold DataFrames."""
        return [context_parts(x)[1] for x in self.models.tokens] if self.consistent else list(self.models.tokens)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """A column ``decoded``: [] without frames, null where no path ends at the end of a token or a frame can't be used."""
        densities, (allowed, first, last), penalty, names = self._frames(), self._allowed(), self.insertion_penalty, self._names()
        n, k = self.models.means.shape[:2]
        moves = [x.reshape(n, k) for x in _moves(self.models, np.repeat(np.arange(n), k), np.tile(np.arange(k), n))]

        @F.pandas_udf("array<string>")
        def decode(rows: pd.Series) -> pd.Series:
            out = []
            for frames in rows:
                if frames is None or not len(frames):
                    out.append([])
                    continue
                b = densities(frames)
                path = None if b is None else best_tokens(b, *moves, allowed, first, last, penalty)
                out.append(None if path is None else [names[i] for i in path])
            return pd.Series(out)

        return dataset.withColumn("decoded", decode("frames"))

    def n_best(self, dataset: DataFrame, n_best: int, per_state: int | None = None) -> DataFrame:
        """A column ``decoded``, array<struct<tokens, score>>: the ``n_best`` best different sequences, best
        first, of those that end at the end of a token. ``per_state`` sequences (n_best if None) are held
        in each state; with fewer than n_best the list is not exact."""
        densities, (allowed, first, last), penalty, names = self._frames(), self._allowed(), self.insertion_penalty, self._names()
        n, k = self.models.means.shape[:2]
        moves = [x.reshape(n, k) for x in _moves(self.models, np.repeat(np.arange(n), k), np.tile(np.arange(k), n))]

        @F.pandas_udf("array<struct<tokens:array<string>,score:double>>")
        def decode(rows: pd.Series) -> pd.Series:
            out = []
            for frames in rows:
                b = None if frames is None or not len(frames) else densities(frames)
                found = [] if b is None else best_sequences(b, *moves, allowed, first, last, penalty, n_best, per_state or n_best)
                out.append([{"tokens": [names[i] for i in x], "score": float(score)} for x, score in found])
            return pd.Series(out)

        return dataset.withColumn("decoded", decode("frames"))


def best_tokens(b: np.ndarray, stay: np.ndarray, on: np.ndarray, skip: np.ndarray, allowed: np.ndarray | None, first: np.ndarray, last: np.ndarray, penalty: float) -> list[int] | None:
    """Tokens of the best path through b[frame, token, state]. Moves stay inside a token or go from its
    last state to a first one; so a frame costs tokens x states, and tokens x tokens if not all may follow."""
    n, tokens, k = b.shape
    total = np.full((tokens, k), -np.inf)
    total[first, 0] = b[0, first, 0]
    how = np.zeros((n, tokens, k), np.int8)  # 0 stayed, 1 moved on, 2 skipped, 3 entered
    via = np.zeros((n, tokens), np.int32)
    barred = None if allowed is None else np.where(allowed, 0.0, -np.inf)
    for i in range(1, n):
        options = np.full((4, tokens, k), -np.inf)
        options[0] = total + stay
        options[1, :, 1:] = total[:, :-1] + on[:, :-1]
        options[2, :, 2:] = total[:, :-2] + skip[:, :-2]
        leave = total[:, -1] + on[:, -1] + penalty
        if barred is None:
            via[i] = int(leave.argmax())
            options[3, :, 0] = leave[via[i, 0]]
        else:
            reach = leave[:, None] + barred
            via[i] = reach.argmax(axis=0)
            options[3, :, 0] = reach.max(axis=0)
        how[i] = options.argmax(axis=0)
        total = options.max(axis=0) + b[i]
    ends = np.where(last, total[:, -1], -np.inf)
    token, state = int(ends.argmax()), k - 1
    if not np.isfinite(ends[token]):
        return None
    path = [token]
    for i in range(n - 1, 0, -1):
        step = how[i, token, state]
        if step == 3:
            token, state = int(via[i, token]), k - 1
            path.append(token)
        else:
            state -= int(step)
    return path[::-1]


def best_sequences(
    b: np.ndarray, stay: np.ndarray, on: np.ndarray, skip: np.ndarray, allowed: np.ndarray | None, first: np.ndarray, last: np.ndarray, penalty: float,
    n_best: int, per_state: int,
) -> list[tuple[list[int], float]]:
    """The best different token sequences with their scores. Each state holds the best ``per_state``
    sequences that lead to it, each with the score of its best path."""
    n, tokens, k = b.shape
    known: dict[tuple[int, int], int] = {}
    steps: list[tuple[int, int]] = []  # sequences as (the one before, token)

    def after(before: int, token: int) -> int:
        if (before, token) not in known:
            known[before, token] = len(steps)
            steps.append((before, token))
        return known[before, token]

    def merged(options: list[tuple[float, int]], extra: float) -> list[tuple[float, int]]:
        best: dict[int, float] = {}
        for score, sequence in options:
            if score > best.get(sequence, -np.inf):
                best[sequence] = score
        return [(score + extra, sequence) for sequence, score in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:per_state]]

    held = [[[] for _ in range(k)] for _ in range(tokens)]
    for t in np.flatnonzero(first).tolist():
        held[t][0] = [(float(b[0, t, 0]), after(-1, t))]
    for i in range(1, n):
        leave = [[(score + on[t, -1] + penalty, sequence) for score, sequence in held[t][-1]] for t in range(tokens)]
        new = [[[] for _ in range(k)] for _ in range(tokens)]
        for t in range(tokens):
            entering = [x for a in range(tokens) if allowed is None or allowed[a, t] for x in leave[a]]
            entering = [(score, after(sequence, t)) for score, sequence in sorted(entering, key=lambda x: -x[0])[: per_state]]
            for j in range(k):
                options = [(score + stay[t, j], x) for score, x in held[t][j]]
                if j:
                    options += [(score + on[t, j - 1], x) for score, x in held[t][j - 1]]
                else:
                    options += entering
                if j > 1:
                    options += [(score + skip[t, j - 2], x) for score, x in held[t][j - 2]]
                new[t][j] = merged(options, float(b[i, t, j]))
        held = new
    ended = sorted((x for t in np.flatnonzero(last).tolist() for x in held[t][-1] if np.isfinite(x[0])), key=lambda x: -x[0])[:n_best]
    out = []
    for score, sequence in ended:
        found = []
        while sequence >= 0:
            sequence, token = steps[sequence]
            found.append(token)
        out.append((found[::-1], score))
    return out


class PenaltyTunedHmm(Estimator):
    """The insertion penalty with the best mean accuracy over folds of utterances, and a model of all of them.

    A trainer is fitted for each fold; penalties are searched (``search``) on what was left out. A
    decoded utterance of another length than its tokens counts as wrong, one with a null token isn't counted. The model has ``confusion``:
    truth, pred, n over all folds, of utterances of the right length.
    """

    def __init__(self, trainer: HmmTrainer, n_splits: int | None = None, low: float = -20.0, high: float = 0.0, n_calls: int = 16, key: str = "utterance_id"):
        super().__init__()
        self.trainer, self.n_splits, self.range, self.key = trainer, n_splits, (low, high, n_calls), key

    def _fit(self, dataset: DataFrame) -> HmmModel:
        key = F.col(self.key)
        fold = key.cast("string") if self.n_splits is None else F.pmod(F.xxhash64(key), F.lit(self.n_splits)).cast("string")
        rows = dataset.withColumn("fold", fold)
        names = [r[0] for r in rows.select("fold").distinct().orderBy("fold").toLocalIterator()]  # one for each fold
        models = {f: self.trainer.fit(rows.where(F.col("fold") != f)) for f in names} if len(names) > 1 else {}

        def decoded(penalty: float) -> DataFrame:
            out = None
            for f, m in models.items():
                part = HmmModel(m.models, penalty, m.follows, m.consistent).transform(rows.where((F.col("fold") == f) & is_labelled()))
                out = part if out is None else out.unionByName(part)
            return out.select("fold", "tokens", "decoded")

        hits = F.when(F.size("decoded") == F.size("tokens"), F.aggregate(F.zip_with("tokens", "decoded", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b)).otherwise(0)
        best, confusion = (-1.0, self.trainer.insertion_penalty), None
        low, high, n_calls = self.range

        def score(penalty: float) -> float:
            by_fold = decoded(penalty).groupBy("fold").agg((F.sum(hits) / F.sum(F.size("tokens"))).alias("a"))
            return by_fold.agg(F.avg("a")).first()[0] or 0.0

        if models and n_calls:
            (penalty,), value, _ = search.maximise(score, [(low, high)], n_calls)
            best = (value, penalty)
        if models:
            pairs = decoded(best[1]).where(F.size("decoded") == F.size("tokens")).select(F.inline(F.arrays_zip("tokens", "decoded")).alias("truth", "pred"))
            confusion = pairs.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
        m = self.trainer.fit(dataset)
        model = HmmModel(m.models, best[1], m.follows, m.consistent)
        model.confusion, model.accuracy = confusion, best[0]
        return model


def context_tokens(tokens: DataFrame, left: bool = True, right: bool = True, run: str = "utterance_id") -> DataFrame:
    """Tokens (run, pos, token) with their neighbours: l-c+r; without a neighbour that part is missing."""
    w = Window.partitionBy(run).orderBy("pos")
    before, after = F.lag("token").over(w), F.lead("token").over(w)
    name: Column = F.col("token")
    if left:
        name = F.concat(F.coalesce(F.concat(before, F.lit("-")), F.lit("")), name)
    if right:
        name = F.concat(name, F.coalesce(F.concat(F.lit("+"), after), F.lit("")))
    return tokens.withColumn("context_token", name)


def with_contexts(model: TokenModels, contexts: list[str]) -> TokenModels:
    """The model with a copy of the centre token's parameters for each context token."""
    at = {t: i for i, t in enumerate(model.tokens)}
    new = [c for c in dict.fromkeys(contexts) if c not in at]
    picks = np.array([at[context_name(context_parts(c)[1])] for c in new], dtype=int)
    join = lambda x: np.concatenate([x, x[picks]])
    return TokenModels([*model.tokens, *new], *map(join, (model.mean, model.variance, model.stay, model.skip, model.weight)))


def tie_states(model: TokenModels, counts: dict[str, float], least: float = 10.0) -> TokenModels:
    """Context tokens seen fewer than ``least`` times share the count-weighted states of their centre."""
    out = model.copy()
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(model.tokens):
        left, centre, right = context_parts(t)
        if (left or right) and counts.get(t, 0) < least:
            groups.setdefault(centre, []).append(i)
    for rare in groups.values():
        w = np.array([max(counts.get(model.tokens[i], 0), 1e-3) for i in rare])
        for a in (out.mean, out.variance, out.stay, out.skip, out.weight):
            a[rare] = np.average(a[rare], axis=0, weights=w)
    return out


def definition_text(model: TokenModels, token: str) -> str:
    """One token's model as text: of each state its mixtures with weight, mean and variance, or the upper
    triangle of the inverse covariance."""
    i = model.tokens.index(token)
    k, mixtures, width = model.means.shape[1:]
    numbers = lambda x: " ".join(f"{v:.6e}" for v in np.ravel(x))
    lines = [f'~h "{token}"', "<BeginHMM>", f"<VecSize> {width} <USER>", f"<NumStates> {k + 2}"]
    for j in range(k):
        lines += [f"<State> {j + 2}", *([f"<NumMixes> {mixtures}"] if mixtures > 1 else [])]
        for m in range(mixtures):
            lines += [f"<Mixture> {m + 1} {model.weight[i, j, m]:.6e}"] if mixtures > 1 else []
            lines += [f"<Mean> {width}", numbers(model.means[i, j, m])]
            if model.full:
                inverse = np.linalg.inv(model.variances[i, j, m])
                lines += [f"<InvCovar> {width}", *(numbers(inverse[r, r:]) for r in range(width))]
            else:
                lines += [f"<Variance> {width}", numbers(model.variances[i, j, m])]
    table = np.zeros((k + 2, k + 2))
    table[0, 1] = 1
    for j in range(k):
        table[j + 1, j + 1] = model.stay[i, j]
        skip = model.skip[i, j] if j + 3 <= k + 1 else 0.0
        table[j + 1, j + 2] = 1 - model.stay[i, j] - skip
        if skip:
            table[j + 1, j + 3] = skip
    lines += [f"<TransP> {k + 2}", *(" ".join(f"{x:.6e}" for x in row) for row in table), "<EndHMM>"]
    return "\n".join(lines)


def models_of_text(text: str) -> TokenModels:
    """Models from definitions as ``definition_text`` writes them, of any number of tokens.

    All must have the same states, mixtures, width and kind of covariance. Moves other than staying, going on
    and skipping one state are refused.
    """
    words, at = text.split(), 0
    found: dict[str, tuple[dict, dict, dict, np.ndarray]] = {}

    def number() -> float:
        nonlocal at
        at += 1
        return float(words[at - 1])

    def numbers(n: int) -> np.ndarray:
        nonlocal at
        at += n
        if at > len(words):
            raise ValueError("a definition ends before its numbers do")
        return np.array(words[at - n : at], dtype=float)

    state, mixture, mean, spread, weight = 0, 0, {}, {}, {}
    while at < len(words):
        word = words[at]
        at += 1
        if word == "~h":
            name, at = words[at].strip('"'), at + 1
            mean, spread, weight = {}, {}, {}
        elif word == "<State>":
            state, mixture = int(number()) - 2, 0
            weight[state, 0] = 1.0
        elif word == "<Mixture>":
            mixture = int(number()) - 1
            weight[state, mixture] = number()
        elif word == "<Mean>":
            mean[state, mixture] = numbers(int(number()))
        elif word == "<Variance>":
            spread[state, mixture] = numbers(int(number()))
        elif word == "<InvCovar>":
            width = int(number())
            inverse = np.zeros((width, width))
            inverse[np.triu_indices(width)] = numbers(width * (width + 1) // 2)
            spread[state, mixture] = np.linalg.inv(inverse + np.triu(inverse, 1).T)
        elif word == "<TransP>":
            n = int(number())
            found[name] = (mean, spread, weight, numbers(n * n).reshape(n, n))
    if not found:
        raise ValueError("no definitions")
    shapes = {(t.shape[0], tuple(sorted(m)), *(x.shape for x in (*m.values(), *v.values()))) for m, v, _, t in found.values()}
    if len(shapes) > 1:
        raise ValueError("definitions of other states, mixtures, width or covariances")
    k, keys = next(iter(found.values()))[3].shape[0] - 2, sorted(next(iter(found.values()))[0])
    mixtures = max(m for _, m in keys) + 1
    if len(keys) != k * mixtures:
        raise ValueError("states have different numbers of mixtures")
    grid = lambda part: np.array([[[x[part][j, m] for m in range(mixtures)] for j in range(k)] for x in found.values()])
    table = np.array([x[3][1:-1, 1:] for x in found.values()])  # from each state, to each state and the exit
    known = np.zeros(table.shape[1:], dtype=bool)
    for step in range(3):
        known |= np.eye(*known.shape, k=step, dtype=bool)
    if (table[:, ~known] != 0).any():
        raise ValueError("moves other than staying, going on and skipping one state")
    skip = np.zeros(table.shape[:2])
    for j in range(k - 1):
        skip[:, j] = table[:, j, j + 2]
    mean, spread = grid(0), grid(1)
    if mixtures == 1:
        mean, spread = mean[:, :, 0], spread[:, :, 0]
    return TokenModels(list(found), mean, spread, np.stack([table[:, j, j] for j in range(k)], axis=1), skip, grid(2))
