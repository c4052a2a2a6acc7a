"""Lattices against all paths, recall by beam, rescoring, and models read from their definitions."""

import numpy as np
import pytest
from test_metrics_models import _brute_hmm

from seqloom.operators import hmm, hmm_lattice as hl


def _model(full=False, mixtures=1, tokens="abc", seed=5):
    r = np.random.default_rng(seed)
    n = len(tokens)
    shape = (n, 2, mixtures, 2) if mixtures > 1 else (n, 2, 2)
    var = r.uniform(0.5, 2, shape)
    if full:
        var = var[..., None] * np.eye(2) + 0.2
    weight = r.dirichlet(np.ones(mixtures), size=(n, 2))
    return hmm.TokenModels(list(tokens), r.normal(size=shape), var, np.full((n, 2), 0.5), np.full((n, 2), 0.1), weight)


def _frames(spark, rows):
    return spark.createDataFrame(rows, "utterance_id int, frames array<array<double>>")


def _sequences(links, n, penalty):
    """The best score of each token sequence along the links, by trying all."""
    best = {}

    def walk(at, score, sequence):
        if at == n:
            best[sequence] = max(best.get(sequence, -np.inf), score)
            return
        for x in links:
            if x.start == at:
                walk(x.stop, score + x.score + (penalty if at else 0.0), (*sequence, x.token))

    walk(0, 0.0, ())
    return best


def test_lattice_holds_all_paths(spark):
    m, r = _model(), np.random.default_rng(6)
    frames = r.normal(size=(6, 2)).tolist()
    df = _frames(spark, [(1, frames), (2, []), (3, frames[:1]), (4, None)])
    found = hl.with_lattices(hmm.HmmModel(m, -0.7), df)
    rows = {x.utterance_id: x.lattice for x in found.collect()}
    want = _brute_hmm(m, frames, -0.7, 6)
    got = _sequences(rows[1].links, 6, -0.7)
    assert {tuple(s) for _, s in want} == set(got) and np.allclose([got[tuple(s)] for _, s in want], [w for w, _ in want])
    assert rows[1].tokens == want[0][1] and np.isclose(rows[1].score, want[0][0])
    # through and posterior, by all paths of links
    paths = []

    def walk(at, score, used):
        if at == 6:
            paths.append((score, used))
        for i, x in enumerate(rows[1].links):
            if x.start == at:
                walk(x.stop, score + x.score + (-0.7 if at else 0.0), (*used, i))

    walk(0, 0.0, ())
    total = np.logaddexp.reduce([s for s, _ in paths])
    for i, x in enumerate(rows[1].links):
        through = [s for s, used in paths if i in used]
        assert np.isclose(x.through, max(through)) and np.isclose(x.posterior, np.exp(np.logaddexp.reduce(through) - total))
    assert (rows[2].links, rows[2].tokens, rows[2].score) == ([], [], None) and (rows[4].links, rows[4].tokens) == ([], [])
    assert (rows[3].links, rows[3].tokens, rows[3].score) == ([], None, None)
    assert hl.link_rows(found).where("utterance_id = 1").count() == len(rows[1].links)


def test_tokens_that_may_follow(spark):
    m, r = _model(), np.random.default_rng(7)
    frames = [r.normal(size=(n, 2)).tolist() for n in (5, 9, 14)]
    df = _frames(spark, list(enumerate(frames)))
    model = hmm.HmmModel(m, 0.4, follows={("a", "b"), ("b", "c"), ("c", "a")})
    plain = {x.utterance_id: x.decoded for x in model.transform(df).collect()}
    for x in hl.with_lattices(model, df).collect():
        assert x.lattice.tokens == plain[x.utterance_id]
        for a, b in zip(x.lattice.tokens, x.lattice.tokens[1:]):
            assert (a, b) in model.follows
    named = hmm.HmmModel(hmm.with_contexts(m, ["a+b", "a-b+c", "b-c"]), consistent=True)
    plain = {x.utterance_id: x.decoded for x in named.transform(df).collect()}
    assert {x.utterance_id: x.lattice.tokens for x in hl.with_lattices(named, df).collect()} == plain


def test_beams(spark):
    m, r = _model(tokens="abcde", seed=8), np.random.default_rng(9)
    df = _frames(spark, [(i, r.normal(size=(12, 2)).tolist()) for i in range(40)])
    model = hmm.HmmModel(m, -1.0)
    best = {x.utterance_id: x.lattice.score for x in hl.with_lattices(model, df).collect()}
    decoded = {x.utterance_id: x.decoded for x in model.transform(df).collect()}
    wide = {x.utterance_id: x.lattice for x in hl.with_lattices(model, df, beam=200.0).collect()}
    assert all(wide[i].tokens == decoded[i] and np.isclose(wide[i].score, best[i]) for i in best)
    rows = {x.beam: x for x in hl.recall_by_beam(model, df, [0.5, 4.0, 200.0]).collect()}
    assert rows[200.0].recall == 1.0 and rows[0.5].recall <= rows[4.0].recall <= 1.0
    assert rows[0.5].links < rows[4.0].links < rows[200.0].links and {x.utterances for x in rows.values()} == {40}
    # links behind the best by more than the lattice's beam go, whole paths stay
    for x in hl.with_lattices(model, df, lattice_beam=2.0).collect():
        assert all(k.through >= x.lattice.score - 2.0 - 1e-6 for k in x.lattice.links)
        assert x.lattice.tokens == decoded[x.utterance_id]


def test_rescoring_against_all_paths(spark):
    m, r = _model(), np.random.default_rng(10)
    n = 7
    df = _frames(spark, [(i, r.normal(size=(n, 2)).tolist()) for i in range(5)])
    found = hl.with_lattices(hmm.HmmModel(m, -0.7), df)
    known = {(a, b): float(r.normal()) for a in "<abc" for b in "abc" if (a, b) != ("b", "b")}
    pairs = spark.createDataFrame([(a, b, p) for (a, b), p in known.items()], "before string, token string, logp double")
    for x in hl.rescored(found, pairs, scale=2.0, penalty=-0.3, default=-3.0, begin="<").collect():
        scores = _sequences(x.lattice.links, n, -0.3)
        for sequence in scores:
            scores[sequence] += sum(2.0 * known.get(p, -1.5) if p in known else -3.0 for p in zip(("<", *sequence), sequence))
        want = max(scores, key=scores.get)
        assert np.isclose(x.rescored.score, scores[want]) and tuple(x.rescored.tokens) == want
    none = hl.rescored(found, pairs.where("false")).first().rescored
    assert len(none.tokens) == 1  # no pair is allowed


@pytest.mark.parametrize("full,mixtures", [(False, 1), (True, 1), (False, 3), (True, 2)])
def test_definitions_read_back(full, mixtures):
    m = _model(full, mixtures)
    back = hmm.models_of_text("\n".join(hmm.definition_text(m, t) for t in m.tokens))
    assert back.tokens == m.tokens and back.full == full and back.mean.shape == m.mean.shape
    for a, b in ((back.mean, m.mean), (back.variance, m.variance), (back.stay, m.stay), (back.weight, m.weight)):
        assert np.allclose(a, b, atol=1e-5)
    assert np.allclose(back.skip[:, 0], 0.1) and np.allclose(back.skip[:, 1], 0.0)
    with pytest.raises(ValueError, match="other states"):
        hmm.models_of_text(hmm.definition_text(m, "a") + "\n" + hmm.definition_text(_model(full, mixtures + 1), "b"))
    with pytest.raises(ValueError, match="no definitions"):
        hmm.models_of_text("")
