"""Trees of questions against splits made from the frames themselves."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import hmm, state_trees as st


def contexts(seed=0, least=5):
    """Frames of state 0 of the centre 'b' in each context of three tokens and the borders."""
    r = np.random.default_rng(seed)
    out = {}
    for before, after in itertools.product(("", "a", "b", "c"), repeat=2):
        centre = np.array([3.0 * (before == "a") - 2.0 * (after == "c") + 0.3 * (before == "c"), 1.0 * (after == "")])
        out[before, after] = r.normal(centre, 1.0, (int(r.integers(least, 60)), 2))
    return out


def table(spark, frames, centre="b"):
    rows = [(f"{b + '-' if b else ''}{centre}{'+' + a if a else ''}", centre, b, a, 0, float(len(x)), x.sum(axis=0).tolist(), (x * x).sum(axis=0).tolist()) for (b, a), x in frames.items()]
    return spark.createDataFrame(rows, "token string, centre string, before string, after string, state int, n double, s array<double>, ss array<double>")


def loglik(x):
    v = np.maximum(x.var(axis=0), 1e-3)
    return -0.5 * (np.log(2 * np.pi * v) + (x - x.mean(axis=0)) ** 2 / v).sum()


def brute(frames, questions, occupancy, gain):
    """The leaves as sets of contexts, from all frames of each side of each question."""
    pool = lambda keys: np.concatenate([frames[k] for k in keys])
    best = None
    for side, asked in questions:
        yes = [k for k in frames if k[0 if side == "before" else 1] in asked]
        no = [k for k in frames if k not in yes]
        if yes and no and len(pool(yes)) >= occupancy and len(pool(no)) >= occupancy:
            g = loglik(pool(yes)) + loglik(pool(no)) - loglik(pool(frames))
            if best is None or g > best[0] + 1e-9:
                best = (g, yes, no)
    if best is None or best[0] < gain:
        return [frozenset(frames)]
    return [leaf for side in best[1:] for leaf in brute({k: frames[k] for k in side}, questions, occupancy, gain)]


@pytest.mark.parametrize("occupancy,gain", [(0, 5.0), (80, 5.0), (10, 60.0), (0, 1e9)])
def test_splits_against_all_questions(spark, occupancy, gain):
    frames = contexts()
    questions = st.neighbour_questions("abc", [("a", "c")])
    trees = st.StateTrees.of(st.grow_trees(table(spark, frames), questions, occupancy, gain, merge=False))
    found = {}
    for b, a in frames:
        found.setdefault(trees.place(f"{b + '-' if b else ''}b{'+' + a if a else ''}", 0), set()).add((b, a))
    assert {frozenset(v) for v in found.values()} == set(brute(frames, questions, occupancy, gain))
    assert trees.place("z-b+z", 0) is not None and trees.place("a-x", 0) is None


def test_merged_leaves_lose_less_than_the_gain(spark):
    frames = contexts(1, 30)
    questions = st.neighbour_questions("abc")
    rows = st.grow_trees(table(spark, frames), questions, 0, 12.0).collect()
    merged = {r.node: r.cluster for r in rows if r.side is None}
    plain = st.grow_trees(table(spark, frames), questions, 0, 12.0, merge=False).collect()
    assert set(merged) == {r.node for r in plain if r.side is None} and len(set(merged.values())) < len(merged)
    trees = st.StateTrees(dict(st.StateTrees.of(st.grow_trees(table(spark, frames), questions, 0, 12.0)).nodes))
    pools: dict = {}
    for (b, a), x in frames.items():
        pools.setdefault(trees.place(f"{b + '-' if b else ''}b{'+' + a if a else ''}", 0), []).append(x)
    pools = [np.concatenate(p) for p in pools.values()]
    assert all(loglik(x) + loglik(y) - loglik(np.concatenate([x, y])) >= 12.0 for x, y in itertools.combinations(pools, 2))
    for r in rows:
        if r.side is None:
            assert any(np.allclose(r.mean, p.mean(axis=0)) and np.allclose(r.variance, p.var(axis=0)) and r.n == len(p) for p in pools)


def utterances(spark, n=80):
    """'b' sounds otherwise after 'a'; some contexts never come."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(n):
        tokens = [str(t) for t in r.choice(list("abc"), 4)]
        frames, ends = [], []
        for k, t in enumerate(tokens):
            mean = {"a": -4.0, "b": 0.0, "c": 4.0}[t] + (1.5 if t == "b" and k and tokens[k - 1] == "a" else 0)
            frames += [[float(v)] for v in r.normal(mean, 0.3, int(r.integers(4, 8)))]
            ends.append(len(frames))
        rows.append((i, frames, tokens, ends))
    return spark.createDataFrame(rows, "utterance_id int, frames array<array<double>>, tokens array<string>, ends array<int>")


def test_trainer_ties_by_trees_and_places_unseen_contexts(spark):
    df = utterances(spark)
    model = hmm.HmmTrainer(n_states=1, n_passes=2, left=True, right=True, context_passes=1, tree=(10.0, 20.0), unseen=("a-b+q", "q-b+q")).fit(df)
    m = model.models
    at = m.tokens.index
    after_a = [m.mean[i, 0, 0] for i, t in enumerate(m.tokens) if t.startswith("a-b")]
    other = [m.mean[i, 0, 0] for i, t in enumerate(m.tokens) if t.startswith(("b-b", "c-b"))]
    assert len(set(after_a)) == 1 and abs(after_a[0] - 1.5) < 0.2 and all(abs(v) < 0.3 for v in other)
    assert m.mean[at("a-b+q"), 0, 0] == after_a[0] and abs(m.mean[at("q-b+q"), 0, 0]) < 0.3
    ties = model.trees.ties(m)
    assert ties[at("a-b+q"), 0] == ties[at("a-b+a"), 0] if "a-b+a" in m.tokens else True
    # one state can't tell a token from two of it
    got = [x for x in model.transform(df).collect() if all(a != b for a, b in zip(x.tokens, x.tokens[1:], strict=False))]
    assert np.mean([x.decoded == x.tokens for x in got]) > 0.8


def test_pooled_estimates(spark):
    """Tied states get the mean of all frames of their group."""
    df = utterances(spark, 20)
    plain = hmm.reestimate(df, hmm.flat_start(df, 1), uniform=True)
    one = hmm.reestimate(df, hmm.flat_start(df, 1), uniform=True, ties=np.zeros((3, 1), dtype=int))
    every = np.array([v[0] for r in df.select(F.explode("frames").alias("f")).collect() for v in [r.f]])
    assert np.allclose(one.mean, every.mean()) and np.allclose(one.variance, every.var()) and len(set(plain.mean.ravel())) == 3
    none = hmm.reestimate(df, hmm.flat_start(df, 1), uniform=True, ties=np.arange(3)[:, None])
    assert np.allclose(none.mean, plain.mean) and np.allclose(none.stay, plain.stay)


def test_models_to_begin_with(spark):
    df = utterances(spark, 20)
    start = hmm.TokenModels(["a", "z"], np.array([[[9.0]], [[1.0]]]), np.full((2, 1, 1), 2.0), np.full((2, 1), 0.7), np.zeros((2, 1)))
    first = hmm.HmmTrainer(n_states=1, n_passes=0, isolated_passes=0, start=start).fit(df).models
    assert first.mean[first.tokens.index("a"), 0, 0] == 9.0 and first.stay[first.tokens.index("a"), 0] == 0.7 and abs(first.mean[first.tokens.index("c"), 0, 0] - 4) < 0.2
    with pytest.raises(ValueError):
        hmm.HmmTrainer(n_states=2, n_passes=0, start=start).fit(df)
