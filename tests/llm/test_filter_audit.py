import itertools
import re
from collections import Counter
from pathlib import Path

import duckdb

from seqloom.llm import filter_audit, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_same_rows_as_sql(spark):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({queries.OP11_SQL})").fetchall()
    got = [tuple(r) for r in queries.op11_filter_audit(spark, SF).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(want) and len(got) % 600 == 0


def brute_force(docs, labels):
    """Every order is walked with the documents themselves."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        rows.append((part or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        here, shapley, steps = [r for r in rows if r[0] == part], Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for k, f in enumerate(order):
                gone, rest = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                all_fail, alone = sum(f in r[1] for r in here), sum(r[1] == {f} for r in here)
                shapley[f] += len(gone)
                steps.append((part, order, k + 1, len(rest), len(gone), all_fail - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)))
                left = rest
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_odd_rows_against_every_order(spark):
    many = " ".join(f"w{k}" for k in range(100))
    docs = [
        (1, many, "en"), (2, many, "de"), (3, many, None), (3, many, "en"), (1, many, "en"), (None, many, "en"), (None, None, None), (4, "", "en"), (5, None, "de"),
        (6, "A" * 9 + " \u00e9\U0001f600" * 60, "en"), (7, "x#", "en"), (8, "\t\n\x0b\x0c\r ", ""), (9, "\u00a0".join(["one"] * 50), "en"),
        (10, many.upper(), "en"), (11, many + " |", "en"), (12, f"  {many}  ", "en"), (13, "a " * 300_000 + "$", "en"), (14, " " * 300_000 + "b", "fr"),
        *[(100 + k, "copy " * 120, "en") for k in range(300)],
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, None, 1), (3, 1, None), (3, 0, 0), (6, 0, 1), (None, 1, 1), (99, 1, 1), (150, 1, 1), (13, 1, 0)]
    df = spark.createDataFrame([(*d, "clash", 0) for d in docs], "doc_id long, text string, lang string, mask string, quality int").repartition(5)
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.audit(df, marks).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute_force(docs, labels)
    assert filter_audit.audit(df.where("false"), marks).collect() == []
    assert {r.good_lost for r in filter_audit.audit(df, marks.where("false")).collect()} == {0}
