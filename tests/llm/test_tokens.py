import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqloom.llm import bpe, simple8b, token_counts, token_files
from seqloom.llm.common import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, "a", "It's the end; they'll say WE'RE don't I'd", "Ünïcode ÉCOLE ΣΑΣ İstanbul ﬁ ½ ²³ Ⅷ", "  \t\r\n ",
    "x<|endoftext|>y <|startoftext|><|endoftext|> < | <|endof", "日本語 テキスト 한국어 ไทย हिन्दी", "é ̈ äb​c d e\x1cf\x1dg",
    "supercalifragilisticexpialidocious antidisestablishmentarianism", "aaaaaaaaaaaaaaaaaaaaaaaaaaa ababababababab !!!!???...", "😀😀👩‍👩‍👧 ok", "12345 3.14 1e10 _under_score_",
    "word " * 3000, "the the the", "the the the",
]


def _random_texts(n, seed=5):
    r = random.Random(seed)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "ab", "'stmdlvre ", "éèüößñçÀÉ", "0123456789", "!?.,;:-_()", " \n\t", "ΣσςабвгДЖ", "的一是不了"]
    return ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randint(1, 120))) for _ in range(n)]


def _library(specials_as_text=False):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = specials_as_text
    return tok


def test_pairwise_check_equals_merging_step_by_step():
    tok, rules = _library(), bpe.WordBpe(PATH)
    texts = [t or "" for t in TEXTS] + _random_texts(3000)
    vocab = [t.replace("</w>", "") for t in random.Random(1).sample(list(rules.vocab), 6000)]
    texts += ["".join(random.Random(i).sample(vocab, 2)) for i in range(3000)]
    cache = bpe.PieceCache(rules.encode_pieces)
    for text, ids in zip(texts, cache.encode(texts), strict=True):
        want = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert rules.decode(ids) == tok.decode(want, skip_special_tokens=False)
    assert 0 < rules.merged


def test_encode_decode_rows(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "y", 2)], "doc_id long, text string, ids string, n_tokens int")
    tok = _library()
    rows = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(df, PATH)
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, PATH).collect()} == {r.doc_id: r.decoded for r in bpe.encode_decode(df, PATH).collect()}
    assert bpe.digests(df.where("false"), PATH).collect() == []


def test_long_words():
    """Letters that no longest match gets right, so that a whole megabyte is merged step by step."""
    tok, rules = _library(), bpe.WordBpe(PATH)
    r = random.Random(2)
    for word in ("".join(r.choice("etaoinshrdlu") for _ in range(1_000_000)), "a" * 200_000, "ab" * 50_000):
        want = tok.encode(word, add_special_tokens=False).ids
        assert rules.exact(rules.symbols(word)) == want
        assert np.frombuffer(rules.encode_pieces([word])[0], "<u4").tolist() == want


@pytest.mark.parametrize("kind", range(8))
def test_simple8b_round_trip(kind):
    r = np.random.default_rng(kind)
    for n in [0, 1, 2, 7, 59, 60, 61, 239, 240, 241, 5000]:
        top = [1, 2, 49408, 1 << 30, 1 << 31, 1 << 60, 2**64, 300][kind]
        ids = r.integers(0, top, n, dtype=np.uint64, endpoint=False) if top < 2**64 else r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        if kind == 7:
            ids = np.where(r.random(n) < 0.1, np.uint64(2**64 - 1), np.where(r.random(n) < 0.5, np.uint64(0), ids))
        words, marks = simple8b.encode(ids)
        assert (simple8b.decode(words, marks, n) == ids).all()
        if kind == 0 and n == 240:
            assert len(words) == 1


def test_token_files(spark):
    docs = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(3, "a repeated id"), (None, "no id")]
    random.Random(3).shuffle(docs)
    df = spark.createDataFrame([(*d, "clash", 7) for d in docs], "doc_id long, text string, part string, block int").repartition(5)
    path = shared_folder(spark, "test-token-files")
    token_files.write_token_files(df, path, PATH)
    tok = _library()
    rows = sorted(token_files.summarise_token_files(spark, path).collect(), key=lambda r: r.start)
    back = {(r.doc_id, r.start): r.ids for r in token_files.read_token_files(spark, path).collect()}
    assert [r.doc_id for r in rows] == sorted((d for d, _ in docs), key=lambda x: (x is not None, x))
    texts = {}
    for d, t in docs:
        texts.setdefault(d, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
        data = back[r.doc_id, r.start]
        assert len(data) == 4 * r.n_tokens and zlib.crc32(data) == r.ids_crc32
        texts[r.doc_id].remove(bytes(data))
    assert not any(texts.values())
    empty = shared_folder(spark, "test-token-files")
    token_files.write_token_files(df.where("false"), empty, PATH)
    assert token_files.summarise_token_files(spark, empty).collect() == []


def test_token_files_of_rows_without_ids(spark):
    docs = [(None, f"text {i}") for i in range(400)] + [(5, f"other {i}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    path, again = shared_folder(spark, "test-token-files"), shared_folder(spark, "test-token-files")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the table were large
    try:
        token_files.write_token_files(df, path, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(path).select("part").distinct().count() > 2  # not one part for each id
    key = lambda r: (r.doc_id, r.start, r.n_tokens, r.ids_crc32)
    found = sorted(map(key, token_files.summarise_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None] * 400 + [5] * 200 and len({r[3] for r in found}) == 600
    token_files.write_token_files(df.repartition(7), again, PATH)
    assert sorted(map(key, token_files.summarise_token_files(spark, again).collect()), key=lambda r: r[1]) == found


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN", 3)
    end, r = 9, np.random.default_rng(0)
    blocks, want = [], []
    for file in range(4):
        ids = r.integers(0, 12, 4000).astype("<u4")
        ids[r.random(4000) < [0.0, 0.4, 0.99, 1.0][file]] = 1
        if file == 2:
            ids[-1] = end
        start = doc = 0
        for stop in np.flatnonzero(ids == end).tolist():
            want.append((file, doc, start, stop - start, True))
            start, doc = stop + 1, doc + 1
        if start < len(ids):
            want.append((file, doc, start, len(ids) - start, False))
        blocks += [(file, b, ids[b * 97 : b * 97 + 97].tobytes()) for b in range(42)]
    blocks += [(7, 0, None), (7, 1, b"")]
    df = spark.createDataFrame(blocks, "file int, block long, payload binary").repartition(6)
    assert sorted(map(tuple, token_counts.count_tokens(df, end).collect())) == sorted(want)
    assert token_counts.count_tokens(df.where("false"), end).collect() == []


def test_flat_files_round_trip(spark):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "a repeated id"), (3, "a repeated id")]
    df = spark.createDataFrame([(*x, None) for x in texts], "doc_id long, text string, file string").repartition(3)
    path = shared_folder(spark, "test-flat")
    token_counts.write_flat_tokens(df, path, PATH, 49407, block_bytes=4096)
    flat = spark.read.schema(token_counts.FLAT).parquet(path)
    found = token_counts.count_tokens(flat.where(F.col("kind") == "tokens"), 49407)
    rows = found.join(flat.where(F.col("kind") == "names").select("file", "doc_no", "doc_id"), ["file", "doc_no"]).collect()
    tok = _library(True)
    want = [(d, len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in texts]
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=str) == sorted(want, key=str) and all(r.closed for r in rows)
    none = shared_folder(spark, "test-flat")
    token_counts.write_flat_tokens(df.where("false"), none, PATH, 49407)
    assert spark.read.schema(token_counts.FLAT).parquet(none).count() == 0


def test_a_worker_keeps_rules_but_no_pieces():
    path = public_tokenizers.path("word_bpe_49k.json")
    (rules, cache), (again, other) = bpe._codec(path), bpe._codec(path)
    cache.encode(["some words here"])
    assert rules is again and cache is not other and not other.whole.now and other.encode(["some words here"]) == cache.encode(["some words here"])
