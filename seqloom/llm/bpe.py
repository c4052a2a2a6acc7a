"""Operator 5: BPE encoding by speculation and verification, and decoding.

For each new word the longest tokens from the left are proposed. A proposal is the exact result if
each token is the exact result for its own letters and no merge reaches across any two neighbours
while the merges inside them are made; that is tested for all pairs of many words at once. Only
words that fail are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import texts, tidy
from seqloom.llm.vocabulary import PieceCache, byte_letters

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_loaded: dict = {}


class WordBpe:
    """The rules of a tokenizer file of the kind BPE with word ends, lower case and byte letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        if kinds != ["NFC", "Replace", "Lowercase"] or bytes_["type"] != "ByteLevel" or not split["invert"] or spec["decoder"]:
            raise ValueError("this kind of tokenizer file is not known")
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        # in this pattern \s is Unicode's White_Space
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", r"\p{White_Space}"))
        self.letters = byte_letters()
        self.tokens: list[str] = [""] * (1 + max([*self.vocab.values(), *self.specials.values()]))
        for t, i in [*self.vocab.items(), *self.specials.items()]:
            self.tokens[i] = t
        n = len(self.tokens)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.made = np.full(n, -1, np.int64)  # the rank of the merge that makes a token; letters -1
        self.ranks: dict[tuple[str, str], int] = {}
        keys, values = [], []
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            self.ranks[a, b] = rank
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            keys.append((x << 32) | y)
            values.append(rank)
            if self.made[z] < 0:
                self.left[z], self.right[z], self.made[z] = x, y, rank
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.longest = max(map(len, self.vocab))
        self.fine: dict[int, bool] = {}
        self.merged = 0

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a and b; very large where they don't merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b stay apart: undo their merges, latest first, and at each state ask
        whether the two parts at the border would have merged sooner than what was undone."""
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 39, np.int64)
        while len(live):
            clash = self._rank(x, y) < limit
            ok[live[clash]] = False
            made_x, made_y = self.made[x], self.made[y]
            on = ~clash & ((made_x >= 0) | (made_y >= 0))
            live, x, y, made_x, made_y = live[on], x[on], y[on], made_x[on], made_y[on]
            undo_x = made_x > made_y
            # on the left a merge of the same rank comes first, on the right it comes after
            limit = np.where(undo_x, made_x, made_y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def exact(self, symbols: list[str]) -> list[int]:
        """Merging step by step: the lowest rank first, of equal ranks the leftmost. Pairs wait in a heap
        and symbols are linked to their neighbours, so a word of n letters takes n log n steps."""
        self.merged += 1
        s: list[str | None] = list(symbols)
        n, ranks = len(s), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(s, s[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if s[i] != x or j >= n or s[j] != y:
                continue  # one of the two has been merged since
            s[i], s[j] = x + y, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (rank := ranks.get((s[left], s[right]))) is not None:
                    heapq.heappush(heap, (rank, left, s[left], s[right]))
        return [self.vocab[x] for x in s if x is not None]

    def symbols(self, word: str) -> list[str]:
        s = [self.letters[b] for b in word.encode("utf-8")]
        s[-1] += self.end
        return s

    def _own(self, token: int) -> bool:
        """Whether merging the letters of a token gives just that token."""
        if token not in self.fine:
            t = self.tokens[token]
            closed = t.endswith(self.end) and len(t) > len(self.end)
            s = list(t[: -len(self.end)] if closed else t)
            if closed:
                s[-1] += self.end
            self.fine[token] = self.exact(s) == [token]
        return self.fine[token]

    def propose(self, letters: str) -> list[int] | None:
        """Longest tokens from the left; None if a token isn't the exact result for its letters."""
        found, at, n, vocab = [], 0, len(letters), self.vocab
        while at < n:
            if n - at <= self.longest and (t := vocab.get(letters[at:] + self.end)) is not None:
                at = n
            else:
                for to in range(min(n - 1, at + self.longest), at, -1):
                    if (t := vocab.get(letters[at:to])) is not None:
                        break
                else:
                    return None
                at = to
            if not (self.fine.get(t) if t in self.fine else self._own(t)):
                return None
            found.append(t)
        return found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        letters = self.letters
        proposals = [self.propose("".join([letters[b] for b in w.encode("utf-8")])) for w in words]
        sizes = np.array([len(p) if p else 0 for p in proposals])
        flat = np.array([t for p in proposals if p for t in p], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        failed = sizes == 0
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            pairs, back = np.unique((flat[inner] << 32) | flat[inner + 1], return_inverse=True)
            ok = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            failed[owner[inner[~ok[back]]]] = True
        for k in np.flatnonzero(failed).tolist():
            proposals[k] = self.exact(self.symbols(words[k]))
        return proposals

    def normalise(self, piece: str) -> str:
        # each character on its own, so a final sigma has no form of its own
        return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without white space, as little-endian uint32."""
        plans, words = [], {}
        for piece in pieces:
            plan: list = []
            for part in self.special_split.split(piece) if self.special_split and "<" in piece else [piece]:
                if part in self.specials:
                    plan.append(self.specials[part])
                elif part:
                    for w in self.words.findall(self.normalise(part)):
                        words.setdefault(w, len(words))
                        plan.append(w)
            plans.append(plan)
        encoded = self.encode_words(list(words))
        out = []
        for plan in plans:
            ids: list[int] = []
            for w in plan:
                if isinstance(w, int):
                    ids.append(w)
                else:
                    ids += encoded[words[w]]
            out.append(np.array(ids, dtype="<u4").tobytes())
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _codec(path: str) -> tuple[WordBpe, PieceCache]:
    """The rules, which a worker keeps, and a cache of pieces of the task's own: a worker that kept it would hold
    some 100 MB beside whatever runs next."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    rules = _loaded[path]
    return rules, PieceCache(rules.encode_pieces)


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids binary of little-endian uint32); a null text is empty and has no ids."""
    return _run(df, tokenizer_path, id_col, text_col, False).select("doc_id", "n_tokens", "ids")


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode`` with ``decoded``, the text made again from the ids alone (tokens joined by a blank)."""
    return _run(df, tokenizer_path, id_col, text_col, True)


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) from ids as ``encode`` returns them; null ids are none."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        rules, _ = _codec(tokenizer_path)
        for batch in batches:
            found = [rules.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], schema=schema)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(run, "doc_id long, decoded string")


def _run(df: DataFrame, path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    def result(docs, ids, rules):
        again = [rules.decode(x) for x in ids] if decoded else [None] * len(ids)
        return [docs, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(again, pa.string())]

    return _map(df, path, id_col, text_col, result, _RESULT, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(df: DataFrame, tokenizer_path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): ``encode_decode`` with the digests made
    where the ids are, so that texts, and ids unless asked for, don't leave the worker.

    Every row gives a row, repeated ones too; a null or empty text has no ids and the digests of
    nothing; a null id stays null. Other columns are ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema, ddl = schema.append(pa.field("ids", pa.binary())), ddl + ", ids binary"

    def result(docs, ids, rules):
        of_ids = [hashlib.sha256(x).hexdigest() for x in ids]
        of_texts = [hashlib.sha256(rules.decode(x).encode()).hexdigest() for x in ids]
        columns = [docs, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_texts, pa.string())]
        return [*columns, pa.array(ids, pa.binary())] if with_ids else columns

    return _map(df, tokenizer_path, id_col, text_col, result, schema, ddl)


def _map(df: DataFrame, path: str, id_col: str, text_col: str, result, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, cache = _codec(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                ids = cache.encode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(result(some.column(0), ids, rules), schema=schema)

    return texts(df, id_col, text_col).mapInArrow(tidy(run), ddl)
