import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import classifier, decoding, hmm, language, metrics


def _align(spark, a, b, **options):
    row = metrics.align(spark.createDataFrame([(list(a), list(b))], "truth array<string>, pred array<string>"), **options).first().alignment
    return [row.dist, row.hits, row.deletions, row.substitutions, row.insertions]


@pytest.mark.parametrize("a, b, htk, nist, unit", [
    ("kitten", "sitting", [27, 4, 0, 2, 1], [11, 4, 0, 2, 1], [3, 4, 0, 2, 1]),
    ("abc", "xabc", [7, 3, 0, 0, 1], [3, 3, 0, 0, 1], [1, 3, 0, 0, 1]),
    ("the cat", "thecats", [14, 6, 1, 0, 1], [6, 6, 1, 0, 1], [2, 6, 1, 0, 1]),
    ("aab", "baa", [14, 2, 1, 0, 1], [6, 2, 1, 0, 1], [2, 1, 0, 2, 0]),
])
def test_edit_distances(spark, a, b, htk, nist, unit):
    assert _align(spark, a, b) == htk
    assert _align(spark, a, b, style="nist") == nist
    assert _align(spark, a, b, style=None, costs=(1, 1, 1)) == unit


def test_alignment_of_empty_and_null(spark):
    df = spark.createDataFrame([([], ["a"]), (["a"], None), ([], [])], "truth array<string>, pred array<string>")
    found = [(r.alignment.deletions, r.alignment.insertions) for r in metrics.align(df).collect()]
    assert found == [(0, 1), (1, 0), (0, 0)]
    assert metrics.align(df).select(metrics.token_accuracy().alias("a")).collect()[2].a is None


def test_alignment_confusion_borders(spark):
    aligned = metrics.align(spark.createDataFrame([(list("abc"), list("xabc"))], "truth array<string>, pred array<string>"))
    cells = {(r.truth, r.pred): r.n for r in metrics.alignment_confusion(aligned).collect()}
    assert cells == {(None, "x"): 1, ("a", "a"): 1, ("b", "b"): 1, ("c", "c"): 1}
    assert (None, "x") not in {(r.truth, r.pred) for r in metrics.alignment_confusion(aligned, borders=False).collect()}
    row = aligned.select(metrics.token_accuracy().alias("acc"), metrics.token_correctness().alias("corr")).first()
    assert (row.acc, row["corr"]) == (pytest.approx(2 / 3), 1.0)
    summary = aligned.select("alignment.hits", "alignment.deletions", "alignment.substitutions", "alignment.insertions", F.size("truth").alias("n"))
    lines = metrics.report_lines(metrics.alignment_confusion(aligned), summary)
    assert "%Corr=100.00, Acc=66.67 [H=3, D=0, S=0, I=1, N=3]" in lines[1] and lines[-1].split() == ["Ins", "0", "0", "0", "1"]


def test_information(spark):
    cm = spark.createDataFrame([("a", "a", 8), ("a", "b", 2), ("b", "a", 1), ("b", "b", 9)], "truth string, pred string, n long")
    prior = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "truth string, p double")
    assert metrics.mutual_information(cm, prior).first().bits == pytest.approx(0.397313, abs=1e-6)
    assert metrics.expand_confusion(cm).count() == 20
    empty = spark.createDataFrame([("a", "a", 8), ("a", "b", 2), ("b", "a", 0), ("b", "b", 0)], "truth string, pred string, n long")
    assert np.isnan(metrics.mutual_information(empty, prior).first().bits)
    assert np.isnan(metrics.normalised_confusion(empty).where("truth = 'b'").first().share)


def test_confusion_over_given_labels(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("z", "a"), ("a", None)], "truth string, pred string")
    labels = spark.createDataFrame([("a",), ("b",), ("c",)], "label string")
    found = {(r.truth, r.pred): r.n for r in metrics.confusion(df, labels=labels).collect()}
    assert len(found) == 9 and sum(found.values()) == 2
    assert metrics.accuracy(df).first().accuracy == 0.25


def _made_transitions(spark, n=240, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = int(r.integers(0, 4))
        radius = 0.5 if t < 2 else 2.0  # rings: not linear
        angle = r.uniform(0, np.pi) + (np.pi if t % 2 else 0)
        rows.append((i % 6, i, "l", [float(radius * np.cos(angle)), float(radius * np.sin(angle))], t, "s"))
    return spark.createDataFrame(rows, "run_id int, pos int, region string, x array<double>, transition int, sub string")


def test_region_classifier_learns_rings(spark):
    df = _made_transitions(spark)
    model = classifier.RegionClassifier(C=100.0, gamma=1.0, n_features=100).fit(df)
    found = model.transform(_made_transitions(spark, 120, 1)).withColumn("hat", classifier.predicted_transition())
    assert found.select(F.avg((F.col("hat") == F.col("transition")).cast("double"))).first()[0] > 0.85
    p = found.first()
    assert p.p0 + p.p1 + p.p2 + p.p3 == pytest.approx(1)


def test_tuning_and_folds(spark):
    df = classifier.folds(_made_transitions(spark, 120), 2)
    assert df.select("fold").distinct().count() == 2
    search = classifier.Search(n_calls=4)
    best = classifier.tune_region(df, search, n_features=30)
    assert len(search.tried) == 4 and best == max(search.tried, key=lambda t: t[1])[0]
    truth = spark.createDataFrame([(1, 0, "a", "f")], "run_id int, pos int, letter string, fold string")
    decode = lambda penalty: spark.createDataFrame([(1, 0, "a" if penalty > -5 else "b")], "run_id int, pos int, letter string")
    assert classifier.tune_penalty(decode, truth, n_calls=3) == 0.0
    assert classifier.fold_confusion(decode(0.0), truth).collect() == [("a", "a", 1)]


def test_decoder_from_features_to_letters(spark):
    r = np.random.default_rng(3)
    book = spark.createDataFrame([("a", "l", 1), ("a", "r", 0), ("b", "l", 0), ("b", "r", 1), (" ", "l", 0), (" ", "r", 0)], "letter string, region string, bit int")
    bits = {"a": (1, 0), "b": (0, 1), " ": (0, 0)}
    rows, text = [], {}
    for run in range(8):
        text[run] = "".join(r.choice(list("ab "), 12))
        for pos in range(1, 12):
            for k, region in enumerate("lr"):
                t = 2 * bits[text[run][pos - 1]][k] + bits[text[run][pos]][k]
                x = r.normal(0, 0.15, 2) + np.array([t // 2, t % 2])
                rows.append((run, pos, region, x.tolist(), t))
    df = spark.createDataFrame(rows, "run_id int, pos int, region string, x array<double>, transition int")
    bigrams = spark.createDataFrame([(x, y, 1 / 3) for x in "ab " for y in "ab "], "prev string, next string, p double")
    params = {k: {"C": 100.0, "gamma": 1.0, "n_features": 60} for k in "lr"}
    model = classifier.TransitionDecoder(book, ["l", "r"], params).fit(df.where("run_id < 6"))
    found = model.decode(df.where("run_id >= 6"), bigrams)
    for stage in (found.letters, found.naive, found.viterbi):
        said = {}
        for row in stage.orderBy("run_id", "pos").collect():
            said[row.run_id] = said.get(row.run_id, "") + row.letter
        assert sum(x == y for k in (6, 7) for x, y in zip(said[k], text[k], strict=True)) >= 22
    assert found.latest() is found.viterbi and found.grammar is None


def test_hmm_recovers_tokens(spark):
    r = np.random.default_rng(0)
    means = {"a": [0.0, 2.0], "b": [5.0, 7.0], "c": [-5.0, -3.0]}

    def made(n):
        rows = []
        for i in range(n):
            tokens = r.choice(list("abc"), int(r.integers(2, 5))).tolist()
            frames = [[float(r.normal(m, 0.3)), float(r.normal(-m, 0.3))] for t in tokens for m in means[t] for _ in range(int(r.integers(2, 5)))]
            rows.append((i, frames, tokens))
        return spark.createDataFrame(rows, "utterance_id int, frames array<array<double>>, tokens array<string>")

    model = hmm.HmmTrainer(n_states=2, n_passes=5).fit(made(60))
    at = model.models.tokens.index("b")
    assert np.allclose(model.models.mean[at, :, 0], [5, 7], atol=0.3)
    test = model.transform(made(30)).collect()
    assert sum(row.decoded == row.tokens for row in test) >= 27
    odd = spark.createDataFrame([(0, [], ["a"]), (1, None, None)], "utterance_id int, frames array<array<double>>, tokens array<string>")
    assert [row.decoded for row in model.transform(odd).collect()] == [[], []]
    assert "<VecSize> 2" in hmm.definition_text(model.models, "a")


def test_context_tokens_and_tying(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate("abc")], "utterance_id int, pos int, token string")
    assert [r.context_token for r in hmm.context_tokens(df).orderBy("pos").collect()] == ["a+b", "a-b+c", "b-c"]
    assert [r.context_token for r in hmm.context_tokens(df, left=False).orderBy("pos").collect()] == ["a+b", "b+c", "c"]
    m = hmm.TokenModels(["a", "b"], np.arange(4.0).reshape(2, 2, 1), np.ones((2, 2, 1)), np.full((2, 2), 0.5), np.zeros((2, 2)))
    wide = hmm.with_contexts(m, ["a+b", "b-a", "a"])
    assert wide.tokens == ["a", "b", "a+b", "b-a"] and (wide.mean[2] == m.mean[0]).all()
    wide.mean[3] += 2
    tied = hmm.tie_states(wide, {"a+b": 1, "b-a": 3})
    assert np.allclose(tied.mean[2], m.mean[0] + 1.5) and np.allclose(tied.mean[2], tied.mean[3])


def _brute_hmm(m, frames, penalty, most):
    """The best score of each token sequence of up to ``most`` tokens, by trying all paths of states."""
    n, k = m.means.shape[:2]
    t, s = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    b = m.log_density(np.array(frames), t, s).reshape(len(frames), n, k)
    with np.errstate(divide="ignore"):
        stay, skip, on = np.log(m.stay), np.log(m.skip), np.log(1 - m.stay - m.skip)
    best = {}

    def walk(i, token, state, score, sequence):
        score += b[i, token, state]
        if i == len(frames) - 1:
            if state == k - 1:
                best[sequence] = max(best.get(sequence, -np.inf), score)
            return
        walk(i + 1, token, state, score + stay[token, state], sequence)
        if state + 1 < k:
            walk(i + 1, token, state + 1, score + on[token, state], sequence)
        if state + 2 < k and np.isfinite(skip[token, state]):
            walk(i + 1, token, state + 2, score + skip[token, state], sequence)
        if state == k - 1 and len(sequence) < most:
            for other in range(n):
                walk(i + 1, other, 0, score + on[token, state] + penalty, (*sequence, other))

    for token in range(n):
        walk(0, token, 0, 0.0, (token,))
    return sorted(((score, [m.tokens[i] for i in sequence]) for sequence, score in best.items()), key=lambda x: -x[0])


@pytest.mark.parametrize("full,mixtures", [(False, 1), (True, 2)])
def test_n_best_against_all_paths(spark, full, mixtures):
    r = np.random.default_rng(5)
    shape = (3, 2, mixtures, 2) if mixtures > 1 else (3, 2, 2)
    var = r.uniform(0.5, 2, shape)
    if full:
        var = var[..., None] * np.eye(2) + 0.2
    m = hmm.TokenModels(list("abc"), r.normal(size=shape), var, np.full((3, 2), 0.5), np.full((3, 2), 0.1))
    frames = r.normal(size=(6, 2)).tolist()
    want = _brute_hmm(m, frames, -0.7, 6)
    df = spark.createDataFrame([(1, frames), (2, []), (3, frames[:1])], "utterance_id int, frames array<array<double>>")
    model = hmm.HmmModel(m, -0.7)
    rows = {x.utterance_id: x.decoded for x in model.n_best(df, 8).collect()}
    assert [x.tokens for x in rows[1]] == [w for _, w in want[:8]] and np.allclose([x.score for x in rows[1]], [w for w, _ in want[:8]])
    assert rows[2] == [] and rows[3] == []
    one = {x.utterance_id: x.decoded for x in model.transform(df).collect()}
    assert one[1] == want[0][1] and one[2] == [] and one[3] is None
    text = hmm.definition_text(m, "b")
    assert ("<InvCovar> 2" in text) == full and ("<NumMixes> 2" in text) == (mixtures > 1)


def test_mixtures_and_full_covariances_are_learned(spark):
    r = np.random.default_rng(1)
    cov = np.array([[1.0, 0.8], [0.8, 1.0]])
    rows = []
    for i in range(80):
        centre = r.choice([-4.0, 4.0], 12)
        rows.append((i, (r.multivariate_normal([0, 0], cov, 12) + centre[:, None]).tolist(), ["a"]))
    df = spark.createDataFrame(rows, "utterance_id int, frames array<array<double>>, tokens array<string>")
    m = hmm.HmmTrainer(n_states=1, n_passes=12, n_mixtures=2, full_covariance=True).fit(df).models
    order = m.means[0, 0, :, 0].argsort()
    assert np.allclose(m.means[0, 0, order], [[-4, -4], [4, 4]], atol=0.3) and np.allclose(m.weight, 0.5, atol=0.1)
    assert np.allclose(m.variances[0, 0], cov, atol=0.25)


def test_spans_contexts_and_ties(spark):
    r = np.random.default_rng(2)
    means = {"a": 0.0, "b": 4.0, "c": -4.0}
    rows = []
    for i in range(60):
        tokens, frames, ends, before = r.permutation(list("abc")).tolist(), [], [], None
        for t in tokens:
            for _ in range(int(r.integers(2, 9))):
                frames.append([float(r.normal(means[t] + (1.5 if before == "b" else 0), 0.3))])
            ends.append(len(frames))
            before = t
        rows.append((i, frames, tokens, ends))
    df = spark.createDataFrame(rows, "utterance_id int, frames array<array<double>>, tokens array<string>, ends array<int>")
    spans = hmm.token_spans(df).collect()
    assert len(spans) == 180 and sum(len(x.frames) for x in spans) == sum(len(x[1]) for x in rows)
    odd = spark.createDataFrame([([[1.0]], ["a"], [2]), ([[1.0]], ["a"], None), ([], [], [])], "frames array<array<double>>, tokens array<string>, ends array<int>")
    assert hmm.token_spans(odd).count() == 0
    cut = hmm.reestimate(df, hmm.flat_start(df, 1), uniform=True)
    assert np.allclose(cut.mean[cut.tokens.index("b"), 0, 0], 4.0, atol=0.2)  # by the spans, not by thirds
    model = hmm.HmmTrainer(n_states=1, n_passes=2, left=True, context_passes=2).fit(df)
    assert {"a", "b-a", "c-a"} <= set(model.models.tokens)
    at = model.models.tokens.index
    assert np.allclose([model.models.mean[at(x), 0, 0] for x in ("b-a", "c-a", "b-c")], [1.5, 0, -2.5], atol=0.25)
    got = model.transform(df).collect()
    assert sum(x.decoded == x.tokens for x in got) >= 50
    tied = hmm.HmmTrainer(n_states=1, n_passes=2, left=True, right=True, context_passes=1, tie_below=1e9).fit(df).models
    same = [tied.mean[i] for i, t in enumerate(tied.tokens) if t in ("a-b+c", "c-b", "b+a")]
    assert len(same) == 3 and all(np.array_equal(x, same[0]) for x in same)


def test_penalty_tuned_over_folds(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(24):
        tokens = r.choice(["a", "b"], 3).tolist()
        rows.append((i, [[float(r.normal(3.0 * (t == "b"), 0.8))] for t in tokens for _ in range(4)], tokens))
    df = spark.createDataFrame(rows, "utterance_id int, frames array<array<double>>, tokens array<string>")
    model = hmm.PenaltyTunedHmm(hmm.HmmTrainer(n_states=2, n_passes=2), n_splits=2, low=-30.0, high=30.0, n_calls=3).fit(df)
    assert model.insertion_penalty == 0.0 and 0 < model.accuracy <= 1
    assert {(x.truth, x.pred) for x in model.confusion.collect()} >= {("a", "a"), ("b", "b")}
    assert model.transform(df).where("size(decoded) > 0").count() == 24  # though the model holds a DataFrame


def test_tuned_decoder(spark):
    r = np.random.default_rng(3)
    book = spark.createDataFrame([("a", "l", 1), ("b", "l", 0)], "letter string, region string, bit int")
    rows, letters = [], []
    for run in range(4):
        text = r.choice(list("ab"), 10)
        for pos in range(10):
            letters.append((run, pos, str(text[pos])))
            if pos:
                t = 2 * int(text[pos - 1] == "a") + int(text[pos] == "a")
                rows.append((run, pos, "l", (r.normal(0, 0.2, 2) + np.array([t // 2, t % 2])).tolist(), t, run % 2))
    df = spark.createDataFrame(rows, "run_id int, pos int, region string, x array<double>, transition int, sub int")
    truth = spark.createDataFrame(letters, "run_id int, pos int, letter string")
    bigrams = spark.createDataFrame([(x, y, 0.5) for x in "ab" for y in "ab"], "prev string, next string, p double")
    nodes, edges = language.word_loop(spark, ["a", "b"])
    lattice = decoding.Lattice.of(nodes, language.without_nulls(nodes, edges), {"a": ["a"], "b": ["b"]})
    plain = classifier.TransitionDecoder(book, ["l"], {"l": {"n_features": 40}}, bigrams, lattice)
    search = classifier.Search(n_calls=1)
    model = classifier.TunedTransitionDecoder(plain, truth, search, n_splits=None, n_calls=2).fit(df)
    assert set(model.region_params["l"]) == {"n_features", "C", "gamma"} and model.penalty in (-20.0, 0.0)
    for cm in (model.naive_confusion, model.viterbi_confusion):
        n = {(x.truth, x.pred): x.n for x in cm.collect()}
        assert sum(n.values()) == 40 and n["a", "a"] + n["b", "b"] >= 36
    assert model.decode(df).grammar.count() == 40
