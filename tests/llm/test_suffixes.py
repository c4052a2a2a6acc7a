import random

import numpy as np
import pytest

from seqloom.llm.suffixes import minimisers, repeated_passages


def brute(rows, least=50):
    where = {}
    for k, (d, t) in enumerate(rows):
        w = (t or "").lower().split()
        for i in range(len(w) - least + 1):
            where.setdefault(tuple(w[i : i + least]), set()).add(d)
    out = []
    for d in sorted({d for d, _ in rows if d is not None}):
        t = next(t for x, t in rows if x == d)
        w = (t or "").lower().split()
        marked = np.zeros(len(w) + 1, dtype=bool)
        for i in range(len(w) - least + 1):
            if len(where[tuple(w[i : i + least])] - {d, None}):
                marked[i : i + least] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(int)])))
        out += [(d, a, b, b - a) for a, b in edge.reshape(-1, 2).tolist()]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in "bcdfghklm" for b in ("an", "en", "or", "us", "it")]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    passages = [say(n) for n in (49, 50, 51, 60, 75, 120, 400)]
    rows = []
    for i in range(90):
        w = say(r.choice([0, 10, 60, 200, 700]))
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3) if r.random() < 0.5 else 0
            at = r.randint(0, len(w))
            w[at:at] = p[a : len(p) - (r.randint(0, 10) if r.random() < 0.3 else 0)]
        rows.append((i * 7, " ".join(w)))
    rows += [(1000 + i, " ".join(say(20) + passages[3] + say(20))) for i in range(60)]  # a large group
    own = say(80)
    rows += [(2000, " ".join(own + say(10) + own)), (2001, "same " * 300), (2002, "same " * 120), (2003, None), (2004, ""), (2005, " ".join(say(49)))]
    rows += [(2006, " ".join(say(70_000) + passages[4]))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*x, 1, "k") for x in rows] + [(None, rows[1][1], 0, "n")], "doc_id long, text string, place int, key string").repartition(6)
    assert sorted(map(tuple, repeated_passages(df).collect())) == brute(rows)


def near_copies(seed, n=150, length=300):
    """Copies of one text in each of which other words are changed, so that a seed's partners differ by place."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10_000)}" for _ in range(length)]
    return [(i, " ".join(w if r.random() > 0.03 else f"x{i}y{k}" for k, w in enumerate(base))) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 40])
def test_near_copies_of_differing_edits(spark, partitions):
    rows = near_copies(partitions)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, found)) == brute(rows)


@pytest.mark.parametrize("least", [75, 100])
def test_longer_passages(spark, least):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows, least)
    assert want and sorted(map(tuple, repeated_passages(df, least).collect())) == want


def test_minimisers_cover_every_window():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 500).astype(np.uint64)
    places, _ = minimisers(h)
    kept = set(places.tolist())
    assert all(kept & set(range(i, i + 31)) for i in range(500 - 50 + 1))
    again, _ = minimisers(h[100:260])
    assert set(again.tolist()) <= {p - 100 for p in kept}
    assert len(kept) < 60


def test_empty_table(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
