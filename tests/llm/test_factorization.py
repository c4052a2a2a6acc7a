import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import factorization, quality, toxicity


def test_sum_of_squares_identity():
    r = np.random.default_rng(1)
    model = factorization.Model({i: i for i in range(6)}, 0.3, r.normal(size=6), r.normal(size=(6, 3)))
    x = r.normal(size=6)
    pairs = sum(model.factors[i] @ model.factors[j] * x[i] * x[j] for i in range(6) for j in range(i + 1, 6))
    got = model.raw(np.zeros(6, int), np.arange(6), x, 1)[0]
    assert got == pytest.approx(0.3 + model.linear @ x + pairs)


@pytest.mark.parametrize("kind", ["and", "xor"])
def test_it_learns_a_pair_of_terms(spark, kind):
    """In xor neither term tells anything alone."""
    r = np.random.default_rng(2)
    a, b = r.random(3000) < 0.5, r.random(3000) < 0.5
    toxic = a & b if kind == "and" else a ^ b
    rows = [(i, " ".join(["plain"] * 2 + ["insult"] * int(x) + ["group"] * int(y) + [f"w{i % 7}"])) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic.tolist())], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(docs, labels).collect()}
    assert np.mean([(got[i].score > 0.5) == t for i, t in enumerate(toxic.tolist()) if got[i].held_out]) > 0.98


def explicit_score(model, text, n_chars):
    """By every pair of features of one text, with words, marks and statistics looked up one by one."""
    words = set(text.lower().split())
    features = {model.terms[factorization._hash(t)]: 1.0 for w in words for t in factorization.terms_of(w) if factorization._hash(t) in model.terms}
    if len(model.mean):
        for k, x in enumerate(factorization.statistics_of(text, text.lower().split(), n_chars)):
            features[len(model.terms) + k] = min(4.0, max(-4.0, (x - model.mean[k]) / model.scale[k]))
    raw = model.bias + sum(model.linear[i] * x for i, x in features.items())
    for i, x in features.items():
        for j, y in features.items():
            if i < j:
                raw += sum(model.factors[i, f] * model.factors[j, f] for f in range(model.factors.shape[1])) * x * y
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, raw))))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_scores_of_texts_against_every_pair(spark, kind):
    docs, labels, _ = _corpus(spark, 300)
    with_stats = kind == "quality"
    model = factorization.fit_on_labels(docs, labels, kind, 4, 2, with_stats=with_stats)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in factorization.score(docs, model).collect())
    rows = [(r.doc_id is None, r.doc_id or 0, explicit_score(model, r.text or "", r.n_chars)) for r in docs.collect()]
    assert np.allclose([x[2] for x in got], [x[2] for x in sorted(rows)], atol=1e-9)
    again = factorization.fit_on_labels(docs.repartition(3), labels.repartition(2), kind, 4, 2, with_stats=with_stats)
    assert again.terms == model.terms and np.array_equal(again.factors, model.factors)  # the order of rows is of no matter


def test_the_sample_is_bounded(spark):
    docs, labels, _ = _corpus(spark, 400)
    docs = docs.union(docs.where("doc_id = 5").withColumn("text", F.concat("text", F.lit(" other")))).union(docs)
    model = factorization.fit_on_labels(docs, labels, "toxic", 3, 1, max_rows=50, with_stats=False, max_terms=30, frequent=10)
    assert 10 <= len(model.terms) <= 30
    assert len(factorization.fit_on_labels(docs, labels, "toxic", 3, 1, max_rows=0, with_stats=False).terms) == 0


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_labels_without_a_row_take_no_place_in_the_sample(spark, kind):
    docs, labels, truth = _corpus(spark)
    foreign = spark.range(10**6, 10**6 + 20_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(id % 2 AS int) AS toxic", "'x' AS lang")
    modulus, remainder, column = (4, 2, 6) if kind == "quality" else (3, 1, 5)
    model = factorization.fit_on_labels(docs, labels, kind, modulus, remainder, max_rows=200, with_stats=kind == "quality")
    more = factorization.fit_on_labels(docs, labels.unionByName(foreign), kind, modulus, remainder, max_rows=200, with_stats=kind == "quality")
    assert more.terms == model.terms and np.array_equal(more.linear, model.linear)
    rows = factorization.classify(docs, more, modulus, remainder, 0.5).collect()
    assert np.mean([r.predicted == truth[r.doc_id][column] for r in rows if r.held_out and r.doc_id in truth]) > 0.95


def test_too_many_terms_are_refused(spark):
    docs, labels, _ = _corpus(spark, 20)
    with pytest.raises(ValueError):
        factorization.fit_on_labels(docs, labels, "toxic", 3, 1, max_terms=70_000)


def _corpus(spark, n=1500):
    r = random.Random(0)
    words = [a + b for a in ("an", "the", "or", "in", "re", "st") for b in ("ing", "ed", "er", "ly", "ou", "ha")]
    rows = []
    for i in range(n):
        text, toxic, good = [r.choice(words) for _ in range(r.randint(3, 60))], int(r.random() < 0.3), int(r.random() < 0.7)
        if toxic:
            text.insert(r.randint(0, len(text)), r.choice(["Idiot!", "moron,", "trash"]))
        if not good:
            text = [w + r.choice(["###", "$$$"]) for w in text]
        rows.append((i, " ".join(text), len(text), "clash", 0.5, toxic, good))
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, label string, score double, toxic int, good int").repartition(4)
    extra = spark.createDataFrame([(n, None, None, "x", 0.0), (n + 1, "", None, None, 0.0), (None, "no id", -1, "x", 0.0), (n + 2, "long " * 100_000 + "idiot", 1, "x", 0.0)], "doc_id long, text string, n_chars long, label string, score double")
    docs = df.drop("toxic", "good").unionByName(extra)
    labels = df.selectExpr("doc_id", "good as quality", "toxic", "'en' as lang").unionByName(
        spark.createDataFrame([(None, 1, 1, "x"), (5, None, None, "x"), (n + 9, 1, 0, "x")], "doc_id long, quality int, toxic int, lang string")
    )
    return docs, labels, {x[0]: x for x in rows}


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy_and_odd_rows(spark, kind):
    docs, labels, truth = _corpus(spark)
    run = quality.score_quality if kind == "quality" else toxicity.score_toxicity
    modulus, remainder, column = (4, 2, 6) if kind == "quality" else (3, 1, 5)
    rows = run(docs, labels).collect()
    assert len(rows) == len(truth) + 4 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder)
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][column] for r in held]) > 0.97
    if kind == "toxic":
        assert next(r for r in rows if r.doc_id == len(truth) + 2).predicted == 1


def test_no_labels_and_no_rows(spark):
    docs, labels, _ = _corpus(spark, 20)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(docs.where("false"), labels).collect() == []
