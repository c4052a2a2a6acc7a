import hashlib
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from seqloom.llm import queries, vector_codes

SF = "/root/testdata/sf0.001"


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{Path(SF) / 'embeddings.parquet'}'")
    columns = ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()['op12_vector_codes']})").fetchall()
    got = [tuple(r) for r in queries.op12_vector_codes(spark, SF).select(*columns).collect()]
    assert sorted(got) == sorted(want) and len(got) == 500


def brute_force(rows, parts, entries, rounds):
    """In Python's whole numbers, one part at a time."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda c, p: min((far(c[p], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [[] for _ in books[p]]
            for c in cut:
                of[best(c, p)[1]].append(c[p])
            new.append([[sum(x) // len(members) for x in zip(*members, strict=True)] if members else e for e, members in zip(books[p], of, strict=True)])
        books = new
    found = [[best(c, p) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    totals = {}
    for (_, label, _), e in zip(kept, errors, strict=True):
        totals[label] = totals.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return [(i, label, "".join(f"{k:02x}" for _, k in f), e, totals[label], sha) for (i, label, _), f, e in zip(kept, found, errors, strict=True)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_rows_against_whole_numbers(spark, partitions):
    r = np.random.default_rng(3)
    rows = [(int(i), int(i % 3) if i % 5 else None, [float(np.float32(x)) for x in r.normal(size=8)]) for i in r.permutation(150)]
    rows += [(200 + k, 1, [0.25] * 8) for k in range(120)] + [(3, 2, [1.0] * 8), (None, 0, [-0.5] * 8)]
    odd = [(400, 1, None), (401, 1, [None] + [0.0] * 7), (402, 1, [math.nan] * 8), (403, 1, [math.inf] * 8), (-1, 1, None)]
    schema = "vec_id long, label int, embedding array<float>, code string, size int"
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows + odd], schema).repartition(partitions)
    got = [tuple(x) for x in vector_codes.compress(df, entries=20).collect()]
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted(brute_force(rows + odd, 4, 20, 4), key=key)
    assert vector_codes.compress(df.where("false")).collect() == [] and vector_codes.compress(df.where("vec_id = 400")).collect() == []


def test_few_rows_other_sizes_and_large_components(spark):
    rows = [(1, 0, [0.0] * 8), (2, 0, [1.0] * 8), (3, 0, [1.0] * 9), (4, 0, []), (5, 0, [3e38] * 8), (6, 0, [2e5] * 8)]
    got = {x.vec_id: x for x in vector_codes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    assert [got[k].code for k in (1, 2, 6)] == ["00000000", "01010101", "02020202"] and {got[k].error for k in (1, 2, 6)} == {0}
    assert all(got[k].code is None and got[k].error is None and got[k].label_error == 0 for k in (3, 4, 5))
    uneven = vector_codes.compress(spark.createDataFrame([(k, 0, [float(k)] * 6) for k in range(3)], "vec_id long, label int, embedding array<float>")).collect()
    assert sorted(x.code for x in uneven) == ["00000000", "01010100", "02020200"]  # filled up with zeros
    assert [x.code for x in vector_codes.compress(spark.createDataFrame([(1, 0, [])], "vec_id long, label int, embedding array<float>")).collect()] == ["00000000"]


def test_products_are_exact_and_ties_take_the_first():
    r = np.random.default_rng(4)
    for top in (1000, vector_codes.LARGEST):
        a, b = r.integers(-top, top, (50, 16)), r.integers(-top, top, (30, 16))
        b[7] = b[3]
        entry, far = vector_codes.nearest(a, b)
        want = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(p, e, strict=True)), k) for k, e in enumerate(b)) for p in a]
        assert [(d, k) for d, k in zip(far.tolist(), entry.tolist(), strict=True)] == want
    with pytest.raises(ValueError):
        vector_codes.compress(None, entries=257)
