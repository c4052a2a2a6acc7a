from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import decoding, language, letters

P = "run_id int, pos int, letter string, p double"
BIGRAM = "prev string, next string, p double"


def _probabilities(spark, r, runs, length, alphabet="abc"):
    rows = []
    for run in range(runs):
        for pos in range(length):
            w = r.dirichlet(np.ones(len(alphabet)))
            rows += [(run, pos, x, float(v)) for x, v in zip(alphabet, w, strict=True)]
    return spark.createDataFrame(rows, P), rows


def test_transitions_back_to_letters(spark):
    book = spark.createDataFrame([("a", "l", 1), ("a", "r", 0), ("b", "l", 0), ("b", "r", 1), (" ", "l", 0), (" ", "r", 0)], "letter string, region string, bit int")
    text = "ab ba a"
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(text)], "run_id int, pos int, letter string")
    t = letters.transition_labels(df, book)
    assert [r.transition for r in t.where("region = 'l'").orderBy("pos").collect()] == [2, 0, 0, 1, 2, 1]
    states = letters.transition_states(t)
    for bit in ("bit_before", "bit_after"):
        found = letters.letters_from_bits(states, book, bit).orderBy("pos").collect()
        assert "".join(r.letter for r in found) == text
    odd = spark.createDataFrame([(1, 0, "l", 1), (1, 0, "r", 1)], "run_id int, pos int, region string, bit_before int")
    assert letters.letters_from_bits(odd, book).first().letter == "?"


def test_on_probabilities_at_the_ends(spark):
    df = spark.createDataFrame([(1, 1, "l", 0.1, 0.2, 0.3), (1, 2, "l", 0.3, 0.1, 0.5)], "run_id int, pos int, region string, p1 double, p2 double, p3 double")
    found = [r.p_on for r in letters.on_probabilities(df).orderBy("pos").collect()]
    assert found == pytest.approx([0.5, (0.6 + 0.4) / 2, 0.8])
    first = letters.on_probabilities(df, last_in_first=True).orderBy("pos").first().p_on
    assert first == pytest.approx((0.5 + 0.6) / 2)


def test_words(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("ab  c")], "run_id int, pos int, letter string")
    assert [r.word for r in letters.word_segments(df).orderBy("word_idx").collect()] == ["ab", "  ", "c"]
    assert letters.word_segments(df.limit(0)).count() == 0


def test_viterbi_against_all_paths(spark):
    r = np.random.default_rng(3)
    df, rows = _probabilities(spark, r, 4, 5)
    table = {(x, y): float(v) for x in "abc" for y, v in zip("abc", r.dirichlet(np.ones(3)), strict=True)}
    del table["a", "b"]
    bigrams = spark.createDataFrame([(*k, v) for k, v in table.items()], BIGRAM)
    least = min(table.values())
    p = {(run, pos, x): v for run, pos, x, v in rows}
    found = {}
    for row in decoding.decode_letters(df, bigrams).orderBy("run_id", "pos").collect():
        found[row.run_id] = found.get(row.run_id, "") + row.letter
    for run in range(4):
        score = lambda path: np.prod([p[run, i, x] for i, x in enumerate(path)]) * np.prod([table.get(e, least) for e in zip(path, path[1:])])  # noqa: B023, B905, E731
        assert found[run] == "".join(max(product("abc", repeat=5), key=score))


def test_blocks_of_a_long_run(spark):
    r = np.random.default_rng(11)
    df, rows = _probabilities(spark, r, 2, 40, "abcd")
    df = df.where("NOT (run_id = 1 AND pos BETWEEN 10 AND 20)")  # places may be missing
    bigrams = spark.createDataFrame([(x, y, float(v)) for x in "abcd" for y, v in zip("abcd", r.dirichlet(np.ones(4)), strict=True)], BIGRAM)
    whole = decoding.decode_letters(df, bigrams, block=1000).orderBy("run_id", "pos").collect()
    for block in (1, 7, 40):
        assert decoding.decode_letters(df, bigrams, block=block).orderBy("run_id", "pos").collect() == whole
    assert len(whole) == 69
    assert decoding.decode_letters(df.limit(0), bigrams).count() == 0


def test_grammar_decoding_against_all_paths(spark):
    r = np.random.default_rng(5)
    df, rows = _probabilities(spark, r, 5, 5)
    table = {(x, y): float(v) for x in "abc" for y, v in zip("abc", r.dirichlet(np.ones(3)), strict=True)}
    bigrams = spark.createDataFrame([(*k, v) for k, v in table.items()], BIGRAM)
    words = {"ab": ["a", "b"], "ca": ["c", "a"], "b": ["b"]}
    nodes, edges = language.grammar_lattice(spark, "$w = ab | ca ; ( $w { b } $w )")
    lattice = decoding.Lattice.of(nodes, language.without_nulls(nodes, edges), words)
    penalty = -0.3
    p = {(run, pos, x): v for run, pos, x, v in rows}
    found = {}
    for row in decoding.decode_with_lattice(df, bigrams, lattice, penalty).orderBy("run_id", "pos").collect():
        found[row.run_id] = found.get(row.run_id, "") + row.letter
    for run in range(5):
        best = None
        for seq in (("ab", "b", "ab"), ("ab", "b", "ca"), ("ca", "b", "ab"), ("ca", "b", "ca")):
            path = "".join(seq)
            s = sum(np.log10(p[run, i, x]) for i, x in enumerate(path)) + sum(np.log10(table[e]) for e in zip(path, path[1:])) + penalty * 2  # noqa: B905
            best = max(best or (s, path), (s, path))
        assert found[run] == best[1]
    short = decoding.decode_with_lattice(df.where("pos < 3 AND run_id = 0"), bigrams, decoding.Lattice.of(nodes, language.without_nulls(nodes, edges), words))
    assert [r.letter for r in short.collect()] == [None] * 3


def test_grammar_marks(spark):
    def sentences(grammar, longest):
        nodes, edges = language.grammar_lattice(spark, grammar)
        closed = language.without_nulls(nodes, edges).collect()
        symbol = {r.id: r.symbol for r in nodes.collect()}
        end, start = sorted(symbol)[-2:]
        out, todo = set(), [(start, ())]
        while todo:
            at, said = todo.pop()
            for e in closed:
                if e.src == at and e.dst == end:
                    out.add(" ".join(said))
                elif e.src == at and len(said) < longest:
                    todo.append((e.dst, (*said, symbol[e.dst])))
        return out

    assert sentences("( yes | no [ thanks ] )", 3) == {"yes", "no", "no thanks"}
    assert sentences("$d = one | two ; ( < $d > )", 2) == {"one", "two", "one one", "one two", "two one", "two two"}
    assert sentences("( a { b } )", 3) == {"a", "a b", "a b b"}
    with pytest.raises(ValueError):
        language.grammar_lattice(spark, "( $missing )")
    with pytest.raises(ValueError):
        language.grammar_lattice(spark, "( a ")


def test_ngrams_and_discount(spark):
    texts = ["a b a b a c", "a b", "x", ""]
    df = spark.createDataFrame([(t.split(),) for t in texts], "tokens array<string>")
    want = Counter(g for t in texts for g in zip(t.split(), t.split()[1:]))  # noqa: B905
    found = {(r.history, r.next): r["count"] for r in language.ngram_counts(df, 2).collect()}
    assert found == want
    assert {(r.history, r.next): r["count"] for r in language.ngram_counts(df, 1).collect()}[("", "a")] == 4
    assert language.ngram_counts(df, 9).count() == 0
    for r in language.ngram_probabilities(language.ngram_counts(df, 2)).collect():
        assert r.p == pytest.approx(want[r.history, r.next] / sum(v for (h, _), v in want.items() if h == r.history))


def test_discounted_probabilities_leave_a_share(spark):
    counts = Counter({("h", str(i)): 1 for i in range(60)}) + Counter({("h", f"b{i}"): 2 for i in range(20)}) + Counter({("h", f"c{i}"): 3 for i in range(8)})
    df = spark.createDataFrame([(*k, v) for k, v in counts.items()], "history string, next string, count long")
    rows = {r.next: r for r in language.discounted_probabilities(df, cutoff=2).collect()}
    common = 3 * 8 / 60
    d1, d2 = ((2 * 20 / 60) - common) / (1 - common), ((3 * 8 / 20) / 2 - common) / (1 - common)
    total = sum(counts.values())
    assert rows["0"].p == pytest.approx(d1 / total) and rows["b0"].p == pytest.approx(2 * d2 / total) and rows["c0"].p == pytest.approx(3 / total)
    assert rows["0"].backoff == pytest.approx(1 - sum(r.p for r in rows.values()))


def test_arpa_and_lattice_text(spark):
    arpa = "\\data\\\nngram 1=3\nngram 2=1\n\n\\1-grams:\n-1.0\t<s>\t-0.5\n-0.5\ta\t-0.3\n-0.7\t_space_\n\n\\2-grams:\n-0.2\ta _space_\n\n\\end\\"
    lines = spark.createDataFrame(list(enumerate(arpa.split("\n"))), "line_no int, value string")
    found = {(r.n, r.history, r["next"]): r.p for r in language.arpa_ngrams(lines).collect()}
    assert found == {(1, "", "a"): -0.5, (1, "", " "): -0.7, (2, "a", " "): -0.2}
    assert language.arpa_ngrams(lines, use_log=False).where("n = 2").first().p == pytest.approx(10**-0.2)
    nodes, edges = language.lattice(spark.createDataFrame([("N=2 L=1",), ("I=0 W=yes",), ("I=1 W=!NULL",), ("J=0 S=1 E=0",)], "value string"))
    assert [tuple(r) for r in nodes.orderBy("id").collect()] == [(0, "yes"), (1, "!NULL")] and tuple(edges.first()) == (1, 0)
    assert language.log10_table(spark.createDataFrame([(0.0,)], "p double")).first().p == float("-inf")


def test_backoff_model_sums_to_one(spark):
    """Of every history, seen tokens and those that are left to the lower orders."""
    r = np.random.default_rng(0)
    rows = [(r.choice(list("aaabbcde"), int(r.integers(0, 30))).tolist(),) for _ in range(60)]
    model = language.backoff_model(spark.createDataFrame(rows, "tokens array<string>"), 3, cutoff=3).collect()
    p = {(x.order, x.history, x.next): x.p for x in model}
    weight = {f"{x.history} {x.next}".strip(): x.weight for x in model if x.order < 3}
    alphabet = sorted({t for (row,) in rows for t in row})

    def chance(history, token):
        k = len(history) + 1
        if (k, " ".join(history), token) in p:
            return p[k, " ".join(history), token]
        return weight.get(" ".join(history), 1.0) * chance(history[1:], token) if history else 0.0

    histories = {tuple(x.history.split()) for x in model}
    for history in histories:
        assert abs(sum(chance(list(history), t) for t in alphabet) - 1) < 1e-9 or not any(
            (len(history) + 1, " ".join(history), t) not in p for t in alphabet
        )
    assert len(histories) > 20 and {x.order for x in model} == {1, 2, 3}
    assert all(x.weight is None for x in model if x.order == 3)


def test_interpolated_model_of_order_3(spark):
    """Every history's probabilities sum to 1, and each is what its counts give."""
    r = np.random.default_rng(0)
    texts = [[str(w) for w in r.choice(list("abcde"), r.integers(0, 9), p=[0.4, 0.3, 0.15, 0.1, 0.05])] for _ in range(60)] + [["z"], []]
    rows = language.interpolated_model(spark.createDataFrame([(t,) for t in texts], "tokens array<string>"), 3).collect()
    known = {(x.order, tuple(x.history.split()), x.next): x for x in rows}
    words = {w for t in texts for w in t}

    def p(history, w):
        k = len(history) + 1
        if (k, history, w) in known:
            return known[k, history, w].p
        if not history:
            return 0.0
        lower = known.get((k - 1, history[:-1], history[-1]))
        return (lower.weight if lower is not None else 1.0) * p(history[1:], w)

    histories = {()} | {(w,) for w in words} | {(a, b) for a in words for b in words if (2, (a,), b) in known}
    assert {(1, (), w) for w in words} <= set(known)
    for h in histories:
        assert sum(p(h, w) for w in words) == pytest.approx(1.0), h
    grams = [tuple(t[i : i + 3]) for t in texts for i in range(len(t) - 2)]
    counts = {g: grams.count(g) for g in grams}
    n = [sum(c == k for c in counts.values()) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    d = [x if 0 < x < k else y for k, x in enumerate(d, 1)]
    for (a, b, c), m in counts.items():
        after = [v for g, v in counts.items() if g[:2] == (a, b)]
        gamma = sum(d[min(v, 3) - 1] for v in after) / sum(after)
        assert known[3, (a, b), c].p == pytest.approx((m - d[min(m, 3) - 1]) / sum(after) + gamma * p((b,), c))
    assert language.interpolated_model(spark.createDataFrame([], "tokens array<string>"), 2).collect() == []


def test_discounted_probabilities_read_the_texts_once(spark, tmp_path):
    """What is given back reads the written counts alone."""
    folder = str(tmp_path / "texts")
    spark.createDataFrame([("a b a b c",), ("a c",)], "text string").write.parquet(folder)
    counts = language.ngram_counts(spark.read.parquet(folder).select(language.tokens(F.col("text")).alias("tokens")), 2)
    found = language.discounted_probabilities(counts)
    assert not any("texts" in f.rsplit("/", 2)[-2] for f in found.inputFiles())
    # three grams are counted once and one twice, so one count is worth 2 / 3
    assert {(r.history, r.next, round(r.p, 6)) for r in found.collect()} == {("a", "b", 0.666667), ("a", "c", 0.222222), ("b", "a", 0.333333), ("b", "c", 0.333333)}


def test_models_cut_texts_once_a_word_and_write_what_is_read_again(spark, monkeypatch):
    df = spark.createDataFrame([(" A b\t\tA ",), ("",), ("b",)], "text string").select(language.tokens(F.col("text")).alias("tokens"))
    assert sorted(r.tokens for r in df.collect()) == [[], ["a", "b", "a"], ["b"]]
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan(df) and "arrays_zip" not in plan(language.ngram_counts(df, 1))
    written, keep = [], language.cut_lineage
    monkeypatch.setattr(language, "cut_lineage", lambda d, label: written.append(label) or keep(d, label))
    assert language.interpolated_model(df, 2).count() == 4 and written.count("interpolated") == 1
