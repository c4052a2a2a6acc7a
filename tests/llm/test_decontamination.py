import random

import numpy as np
import pytest

from seqloom.llm import common
from seqloom.llm.decontamination import decontaminate, leaks, tiles, words_of


def brute_tiles(a, b, least):
    """Greedy tiling by trying all pairs of places again after each mark."""
    ua, ub, out = [x >= 0 for x in a], [x >= 0 for x in b], []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and ua[i + n] and ub[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            ua[best[0] + k] = ub[best[1] + k] = False


@pytest.mark.parametrize("seed", range(40))
def test_tiles_against_brute_force(seed):
    r = random.Random(seed)
    n = r.choice([2, 4, 30])
    b = [r.randrange(n) for _ in range(r.randint(0, 30))]
    a = [r.randrange(-1, n) for _ in range(r.randint(0, 20))]
    for _ in range(3):
        at, k, to = r.randint(0, len(b)), r.randint(0, 15), r.randint(0, len(a))
        a[to:to] = b[at : at + k]
    least = r.choice([1, 2, 3, 5])
    assert tiles(np.array(a, int), np.array(b, int), least) == brute_tiles(a, b, least)


def brute(docs, items, least=5, threshold=0.6):
    out = []
    for d, text in docs:
        for i, item in items:
            v = {}
            a, b = ([v.setdefault(w, len(v)) for w in words_of(t or "")] for t in (text, item))
            n = sum(t[2] for t in brute_tiles(a, b, least))
            if len(b) >= least and n >= threshold * len(b):
                out.append((d, i, n, len(b)))
    return sorted(out, key=str)


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocab = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "en", "or", "us")]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, say(r.randint(8, 30))) for i in range(12)] + [(90, say(3)), (91, [])]
    items += [(92, items[0][1]), (92, items[0][1])]
    docs = []
    for i in range(60):
        w = say(r.randint(0, 50))
        item = r.choice(items)[1]
        kind = i % 5
        if kind == 1:
            w[len(w) // 2 : len(w) // 2] = item
        elif kind == 2:  # in another order
            k = len(item) // 2
            w = item[k:] + w + item[:k]
        elif kind == 3:  # a third of it
            w += item[: len(item) // 3]
        elif kind == 4:
            w[1:1] = [x.upper() + r.choice([",", "!!", "###"]) if r.random() < 0.5 else x + " |" for x in item]
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "?! | ..."), (None, " ".join(items[3][1])), (7, docs[7][1]), (103, "long " * 50_000 + " ".join(items[2][1]))]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, tiles string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w), "y") for i, w in items] + [(None, None, "z")], "item_id long, text string, doc_id string")
    short = [d for d in docs if d[0] != 103]
    want = brute(short, [(i, " ".join(w)) for i, w in items])
    for chars in (4_000_000, 300):
        rows = leaks(df, bench, block_chars=chars).collect()
        assert sorted(((x.doc_id, x.item_id, x.covered_words, x.item_words) for x in rows if x.doc_id != 103), key=str) == want
        assert [x.item_id for x in rows if x.doc_id == 103] == [2]
    leaked = {d for d, *_ in want if d is not None} | {103}
    left = decontaminate(df, bench)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(d for d, _ in docs if d is not None and d not in leaked)
    assert left.columns == df.columns and left.where("doc_id IS NULL").count() == 0  # it leaks as row 103 does
    assert leaks(df.where("false"), bench).collect() == [] and leaks(df, bench.where("false")).collect() == []


@pytest.mark.parametrize("rows_to_broadcast", [1_000_000, 0])
def test_rows_go_by_their_own_text(spark, monkeypatch, rows_to_broadcast):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows_to_broadcast)
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "so " + item), (1, "an innocent text with the id of one that leaks"), (None, item), (None, "innocent too"), (2, None), (3, ""), (4, item), (4, item)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, item_id string, mark int")
    bench = spark.createDataFrame([(9, item), (10, None)], "item_id long, text string")
    left = decontaminate(df, bench)
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    assert decontaminate(df.where("false"), bench).collect() == [] and decontaminate(df, bench.where("false")).count() == len(rows)


def test_long_repetitive_texts_take_no_square():
    r = random.Random(1)
    for period in (1, 2, 7):
        text, item = np.arange(100_000) % period, np.arange(3_000) % period
        found = tiles(text, item, 5)
        assert sum(t[2] for t in found) == len(item)
    noise = np.array([r.randrange(3) for _ in range(100_000)])
    assert sum(t[2] for t in tiles(noise, noise[5_000:6_000][::-1].copy(), 5)) > 0
