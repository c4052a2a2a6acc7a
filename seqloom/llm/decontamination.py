"""Operator 2: benchmark decontamination by greedy string tiling.

The benchmark is a stated query set: it is taken in blocks of bounded size, and every text is held
against each block. Runs of LEAST words that a text shares with an item are the seeds that join the
two. For such pairs the longest common run of unmarked words is marked again and again (running
Karp-Rabin: window hashes of one length, doubled and halved to the longest), and the item counts as
leaked if the marked tiles, in whatever order they stand in the text, cover at least THRESHOLD of its words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import if_small, materialise, mix64, texts, tidy

LEAST, THRESHOLD = 5, 0.6
#: Characters of items that one block may hold; a longer item is a block of its own.
BLOCK_CHARS = 4_000_000
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’…¿¡"


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation at their ends; pieces of punctuation alone are none."""
    return [w for w in (p.strip(_EDGES) for p in text.lower().split()) if w]


#: An odd base for the rolling hash and its inverse, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``width`` ids in linear time: sum over k of mix(id k) * base**k."""
    n = len(ids)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(ids.astype(np.uint64)) * _powers(_BASE, n), dtype=np.uint64)])
        return (sums[width:] - sums[:-width]) * _powers(_INVERSE, n - width + 1)


def _runs(free: np.ndarray, width: int) -> np.ndarray:
    """Places where ``width`` free words begin."""
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[width:] - sums[:-width] == width)


def _longest(text: np.ndarray, item: np.ndarray, free_t: np.ndarray, free_i: np.ndarray, least: int, most: int) -> int:
    """The length, up to ``most``, of the longest run of free words that both have; 0 if it is below ``least``."""

    def common(width: int) -> bool:
        at_t, at_i = _runs(free_t, width), _runs(free_i, width)
        return bool(len(at_t) and len(at_i) and np.isin(_rolling(item, width)[at_i], _rolling(text, width)[at_t]).any())

    if most < least or not common(least):
        return 0
    width = 2 * least
    while width <= most and common(width):
        width *= 2
    lo, hi = width // 2, min(width, most + 1)  # lo is common, hi is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if common(mid) else (lo, mid)
    return lo


def tiles(text: np.ndarray, item: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Tiles (place in the text, place in the item, length) by greedy tiling, in order of marking.

    Ids below zero match nothing. Of equal lengths the first in the text, then in the item, is marked.
    All tiles of one length are marked in one pass over the text, in which each place of the item is
    looked at once; so repetitive texts cost no more than others.
    """
    free_t, free_i = text >= 0, item >= 0
    found: list[tuple[int, int, int]] = []
    most = min(len(text), len(item))
    while width := _longest(text, item, free_t, free_i, least, most):
        at_t, at_i = _runs(free_t, width), _runs(free_i, width)
        hash_t, hash_i = _rolling(text, width)[at_t], _rolling(item, width)[at_i]
        near = np.isin(hash_t, hash_i)
        waiting: dict[int, deque[int]] = {}
        for h, i in zip(hash_i.tolist(), at_i.tolist(), strict=True):
            waiting.setdefault(h, deque()).append(i)
        end = 0
        for t, h in zip(at_t[near].tolist(), hash_t[near].tolist(), strict=True):
            if t < end:
                continue
            places = waiting[h]
            # tiles of this pass have one length, so a place is free if both its ends are
            while places and not (free_i[places[0]] and free_i[places[0] + width - 1]):
                places.popleft()
            if not places:
                continue
            i = places[0]
            if (text[t : t + width] != item[i : i + width]).any():
                continue  # the hashes agree, the words don't
            end = t + width
            free_t[t:end] = free_i[i : i + width] = False
            found.append((t, i, width))
        most = width - 1
    return found


class _Block:
    """Items of one block: ids of their words, and where each run of LEAST words stands."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.vocab: dict[str, int] = {}
        self.least = least
        self.items = []
        seeds, owners = [], []
        for item_id, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)], dtype=np.int64)
            if len(ids) >= least:
                seeds.append(np.unique(_rolling(ids, least)))
                owners.append(np.full(len(seeds[-1]), len(self.items)))
                self.items.append((item_id, ids))
        seeds, owners = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, owners))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners = seeds[order], owners[order]
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text's words; -1 where no item has the word. Punctuation alone is left out."""
        pieces = text.split()
        known = self.known
        if len(known) > 500_000:
            known.clear()
        try:
            return np.frombuffer(b"".join([known[p] for p in pieces]), dtype="<i4")
        except KeyError:
            for p in set(pieces).difference(known):
                words = words_of(p)
                known[p] = np.array([self.vocab.get(w, -1) for w in words], dtype="<i4").tobytes()
            return np.frombuffer(b"".join([known[p] for p in pieces]), dtype="<i4")

    def hits(self, batch_texts: list[str], threshold: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(index of the text, item id, words covered, words of the item, tiles), all texts at once."""
        parts, lengths = [], []
        for text in batch_texts:
            ids = self.ids(text)
            parts += (ids, np.array([-1], dtype="<i4"))
            lengths.append(len(ids) + 1)
        if not parts or not len(self.seeds):
            return
        flat = np.concatenate(parts).astype(np.int64)
        ends = np.cumsum(lengths)
        places = _runs(flat >= 0, self.least)
        if not len(places):
            return
        hashes = np.zeros(len(places), np.uint64)
        mixed = mix64(flat.astype(np.uint64))
        with np.errstate(over="ignore"):
            for k, power in enumerate(_powers(_BASE, self.least)):
                hashes += mixed[places + k] * power
        lo = np.searchsorted(self.seeds, hashes, "left")
        hi = np.searchsorted(self.seeds, hashes, "right")
        hit = np.flatnonzero(hi > lo)
        by_pair: dict[tuple[int, int], list[int]] = {}
        owner_of = np.searchsorted(ends, places[hit], "right")
        for k, doc in zip(hit.tolist(), owner_of.tolist(), strict=True):
            for owner in self.owners[lo[k] : hi[k]].tolist():
                by_pair.setdefault((doc, owner), []).append(int(places[k]))
        for (doc, owner), at in by_pair.items():
            item_id, item = self.items[owner]
            # only words inside seeds can be in a tile; a break stands between runs of them
            covered = np.unique((np.array(at)[:, None] + np.arange(self.least)).ravel())
            if len(covered) < threshold * len(item):
                continue
            gaps = np.flatnonzero(np.diff(covered) > 1) + 1
            text = np.insert(flat[covered], gaps, -1)
            found = tiles(text, item, self.least)
            n = sum(t[2] for t in found)
            if n >= threshold * len(item):
                yield doc, item_id, n, len(item), len(found)


LEAKS = "doc_id long, mark long, item_id long, covered_words long, item_words long, tiles long, coverage double"
_LEAKS = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("item_id", pa.int64()), ("covered_words", pa.int64()), ("item_words", pa.int64()), ("tiles", pa.int64()), ("coverage", pa.float64())]
)


def leaks(
    df: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row for each text and item that it leaks; texts that leak nothing have no row.

    Items with fewer than ``least`` words, null items and null texts leak nothing. Of each repeated
    row of a text or an item there is a row; null ids stay null. Other columns are ignored.
    ``benchmark`` may be of any size: it is read in blocks of about ``block_chars`` characters, each of
    which goes to the tasks whole; the driver holds one of them.
    """
    return _leaks(df, benchmark, least, threshold, block_chars, id_col, text_col, item_col, item_text_col).drop("mark")


def _leaks(df, benchmark, least, threshold, block_chars, id_col, text_col, item_col, item_text_col) -> DataFrame:
    """``leaks`` with a hash of the text, which tells rows of one id apart."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // block_chars) + 1
    docs = texts(df, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    found = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        rows = [(r.item_id, r.text) for r in part.collect()]  # about block_chars characters
        hits = docs.mapInArrow(tidy(_search(rows, least, threshold)), LEAKS)
        if blocks > 1:
            hits = materialise(hits, "leaks")  # and the block is no longer needed
        found = hits if found is None else found.unionByName(hits)
    return found


def _search(items: list[tuple[int, str]], least: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(items, least)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                docs, marks = some.column(0).to_pylist(), some.column(2).to_pylist()
                rows = [(docs[d], marks[d], i, n, m, t, n / m) for d, i, n, m, t in block.hits(some.column(1).to_pylist(), threshold)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LEAKS, strict=True)], schema=_LEAKS)

    return run


def decontaminate(
    df: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``df`` that leak no item, with all their columns.

    Each row goes by its own text: of several texts of one id those that leak nothing stay, and a row
    with a null id goes if it leaks. Null and empty texts stay.
    """
    found = _leaks(df, benchmark, least, threshold, block_chars, id_col, text_col, item_col, item_text_col)
    found = materialise(found.select(F.col("doc_id").alias("__leaked"), F.col("mark").alias("__mark")).distinct(), "leaking")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.join(if_small(found), F.col(id_col).cast("long").eqNullSafe(F.col("__leaked")) & (F.xxhash64(text) == F.col("__mark")), "left_anti")
