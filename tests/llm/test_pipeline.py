import hashlib
import re

import numpy as np
import public_tokenizers
from test_decontamination import brute_tiles
from test_ngram_join import brute as brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from seqloom.llm import toxicity
from seqloom.llm.decontamination import words_of

SF = "/root/testdata/sf0.001"


def _copies(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", r.text), []).append(r)
    return {min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values()}


def _leaking(rows, items):
    out = set()
    for r in rows:
        for item in items:
            v = {}
            a, b = ([v.setdefault(w, len(v)) for w in words_of(t)] for t in (r.text, item.text))
            seeds = {tuple(b[i : i + 5]) for i in range(len(b) - 4)}
            near = sorted({k for i in range(len(a) - 4) if tuple(a[i : i + 5]) in seeds for k in range(i, i + 5)})
            parts = [a[k] if n == 0 or near[n - 1] == k - 1 else None for n, k in enumerate(near)]
            text = [x for n, k in enumerate(near) for x in ([-1, a[k]] if parts[n] is None else [a[k]])]
            if len(b) >= 5 and sum(t[2] for t in brute_tiles(text, b, 5)) >= 0.6 * len(b):
                out.add(r.doc_id)
    return out


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    kept = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if not r.predicted}
    for name in list(stages)[:-1]:
        following = stages[name](spark, docs, SF)
        assert following.columns == docs.columns
        if name == "exact dedup":
            kept = _copies(rows)
        elif name == "near dedup":
            kept = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in rows]) if d == c}
        elif name == "decontamination":
            kept = {r.doc_id for r in rows} - _leaking(rows, items)
        assert sorted(map(tuple, following.collect())) == sorted(tuple(r) for r in rows if r.doc_id in kept)
        rows = [r for r in rows if r.doc_id in kept]
        docs = spark.createDataFrame(rows, docs.schema)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == sorted(r.doc_id for r in rows)
    for r in rows:
        ids = tok.encode(r.text, add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        assert bytes(got[r.doc_id].ids) == data and got[r.doc_id].ids_sha256 == hashlib.sha256(data).hexdigest()


def test_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11),
        (3, "another text", "en", "s", 12), (4, "a  b c d e f", "en", "s", 12), (None, "no id", None, "s", 5), (None, "no id", None, "s", 5),
    ]
    for name, kept in (("toxicity", None), ("exact dedup", [1, 3, 4, None, None]), ("near dedup", None), ("decontamination", None)):
        df = spark.createDataFrame(rows, schema)
        got = dict(corpus_pipeline.STAGES)[name](spark, df, SF)
        ids = sorted((r.doc_id for r in got.collect()), key=str)
        if kept:
            assert ids == sorted(kept, key=str)
        else:
            assert {1, 2, None} <= set(ids)
        assert dict(corpus_pipeline.STAGES)[name](spark, df.where("false"), SF).collect() == []
    last = dict(corpus_pipeline.STAGES)["bpe encoding"]
    assert last(spark, spark.createDataFrame(rows, schema), SF).count() == len(rows)
