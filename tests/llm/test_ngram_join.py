import random
import re

import numpy as np
import pytest

from seqloom.llm import common, ngram_join
from seqloom.llm.common import mix64
from seqloom.llm.components import components
from seqloom.llm.shingles import WordHashes, shingle_set, words_of


def brute_sets(rows):
    sets = []
    for d, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall("[^\x20\x09-\x0d]+", t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return sets


def brute(rows):
    sets = brute_sets(rows)
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def meet(a, b):
    """Whether a key of both is among the first own + 1 of each, in a few orders."""
    for order in range(3):
        first = []
        for s in (a, b):
            found = set()
            for band, own, keys in ngram_join.key_sets(s):
                keys = np.unique(keys)
                keys = keys[np.argsort(mix64(keys + np.uint64(order)))] if order else keys
                found |= {(band, k) for k in keys[: own + 1].tolist()}
            first.append(found)
        if not first[0] & first[1]:
            return False
    return True


def corpus(seed, n=150):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    common = [r.choice(vocab) for _ in range(40)]
    out = []
    for _ in range(n // 3):
        base = [r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 6, 8, 12, 20, 21, 25, 40, 70, 130, 270, 700, 1500]))]
        if r.random() < 0.3:
            at = r.randint(0, len(base))
            base[at:at] = common
        out.append(base)
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, max(1, len(base) // 40), max(1, len(base) // 33), len(base) // 25])):
                k = r.randrange(len(copy))
                what = r.random()
                if what < 0.6:
                    copy[k] = r.choice(vocab)
                elif what < 0.8 and len(copy) > 1:
                    del copy[k]
                else:
                    copy.insert(k, r.choice(vocab))
            out.append(copy)
    texts = [r.choice([" ", "  ", "\n"]).join(w).upper() if r.random() < 0.2 else " ".join(w) for w in out]
    return texts


ODD = ["", None, " \t\n", "one", "ONE", "é É", "É É", "a\xa0b c", "a b c", "x\x1cy z w v u", "É a B c d e", "É a b c d e"]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed) + ODD
    rows = list(zip(random.Random(seed).sample(range(10_000), len(texts)), texts, strict=True))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, cls string").repartition(5)
    small = {"small_group": 3, "block": 4, "held": 500} if seed == 2 else {}
    found = ngram_join.near_duplicates(df, **small)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_meeting_and_sketch_bounds():
    hashes = WordHashes()
    texts = [t for s in range(6) for t in corpus(100 + s)]
    sets = [shingle_set(t, hashes) for t in texts]
    by = {}
    n = 0
    for i, a in enumerate(sets):
        for j in range(max(0, i - 6), i):
            b = sets[j]
            both = len(np.intersect1d(a, b))
            distance = len(a) + len(b) - 2 * both
            assert ngram_join.hamming(ngram_join.bit_sketch(a), ngram_join.bit_sketch(b)) <= distance
            if ngram_join.linked(a, b):
                n += 1
                assert meet(a, b)
                assert ngram_join.may_link(len(a), len(b), ngram_join.bit_sketch(a), ngram_join.bit_sketch(b))
    assert n > 200


def test_pairs_at_the_threshold_meet():
    r = np.random.default_rng(3)
    for _ in range(400):
        n = int(r.choice([7, 14, 17, 28, 64, 128, 250, 300, 512, 513, 600, 1100, 2500, 6000]))
        both = r.integers(0, 2**63, n).astype(np.uint64)
        spare = n // 3  # |A | B| = n + spare: as far apart as a link allows
        cut = int(r.integers(0, spare + 1))
        extra = r.integers(0, 2**63, spare).astype(np.uint64)
        a, b = np.unique(np.concatenate([both, extra[:cut]])), np.unique(np.concatenate([both, extra[cut:]]))
        assert ngram_join.linked(a, b)
        assert meet(a, b)


def test_empty_parts_are_keys_where_they_are_needed():
    """Sets dealt into so few parts that D of them are all: only empty parts can agree."""
    r = np.random.default_rng(4)
    band, parts = 5, ngram_join._parts(5)
    deal = lambda x: (mix64(x ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(20)) % np.uint64(parts)
    pool = r.integers(0, 2**63, 4000).astype(np.uint64)
    pool = pool[deal(pool) < 7]
    a = np.unique(pool[:28])
    b = np.unique(np.concatenate([a[4:], pool[100:104]]))
    assert ngram_join.linked(a, b) and len(np.unique(deal(a))) <= 2 * 28 // 7
    own = {x: own for x, own, _ in ngram_join.key_sets(a)}
    assert own[band] == parts and meet(a, b)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text), (4, text), (None, text), (9, text + " end"), (None, "alone here"), (2, "by itself"), (11, "long " + " ".join(str(i % 977) for i in range(60_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect()), key=str) == brute(rows)
    assert ngram_join.near_duplicates(df.where("false")).collect() == []


def just_below():
    """Two texts that don't link, but meet and pass the filter."""
    for seed in range(2000):
        r = random.Random(seed)
        a = [f"w{i}" for i in range(1000)]
        b = list(a)
        for k in r.sample(range(1000), 30):
            b[k] = f"x{k}"
        x, y = (shingle_set(" ".join(t), WordHashes()) for t in (a, b))
        if meet(x, y) and not ngram_join.linked(x, y) and ngram_join.may_link(len(x), len(y), ngram_join.bit_sketch(x), ngram_join.bit_sketch(y)):
            return " ".join(a), " ".join(b)
    raise AssertionError("no such pair")


@pytest.mark.parametrize("other", [False, True])
def test_repeats_beside_a_candidate_that_does_not_link(spark, other):
    a, b = just_below()
    again = [" ".join(f"{c}{i}" for i in range(80)) for c in "pq"] if other else [a, b]
    rows = [(4, a), (4, again[0]), (9, b), (9, again[1])]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)
    assert {row.component_id for row in found} == {4, 9}


def test_components(spark):
    r = random.Random(0)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3)]
    label = {}

    def root(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    want = {x: root(x) for x in label}
    got = {row.node: row.label for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_words():
    assert words_of("Aé\xa0B\x1cc  ÀD") == ["aé\xa0b\x1cc", "Àd"]


@pytest.mark.parametrize("rows_to_broadcast", [1_000_000, 0])
def test_near_copies_go_row_by_row(spark, monkeypatch, rows_to_broadcast):
    """Of two texts of one id only the near copy goes; rows that repeat what stays, stay."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_to_broadcast)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (5, text + " end"), (5, "an innocent text of the same id"), (None, text), (7, None), (8, "")]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, mark string, node int")
    left = ngram_join.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([r for r in rows if r != rows[2]], key=str)


def test_pairs_of_small_groups_need_no_arrays(spark):
    met = spark.createDataFrame([(1, 5, 3), (1, 2, 3), (1, 9, 3), (1, 9, 3), (2, 7, 1), (3, 2, 2), (3, 5, 2)], "key long, node long, size int")
    pairs = ngram_join._paired(met)
    assert sorted(map(tuple, pairs.collect())) == [(2, 5), (2, 5), (2, 9), (5, 9)]
    assert "collect_" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("repeats", [1, 3])
def test_texts_of_classes_are_shuffled_only_if_rows_are_repeated(spark, monkeypatch, repeats):
    written, keep = [], ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, label, *a: written.append(df) or keep(df, label, *a))
    docs = spark.createDataFrame([(1, "a b c d e f", 11), (2, "g h i j k l", 12)] * repeats, "doc_id long, text string, mark long")
    meeting = spark.createDataFrame([(100, 1, 11), (200, 2, 12)], "node long, doc_id long, mark long")
    assert sorted((r.node, r.n) for r in ngram_join._packed(docs, meeting).collect()) == [(100, 2), (200, 2)]
    assert ["Aggregate" in df._jdf.queryExecution().executedPlan().toString() for df in written] == [False, True][: min(2, repeats)]


def test_a_task_gives_back_what_arrow_keeps(monkeypatch):
    told = []
    pool = type("Pool", (), {"release_unused": lambda self: told.append(True)})()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    assert list(common.tidy(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3] and told == [True]
