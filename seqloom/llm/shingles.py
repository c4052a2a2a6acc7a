"""Words and sets of five-word shingles as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from seqloom.llm.common import mix64

WIDTH = 5
_WORDS = re.compile("[^\x20\x09-\x0d]+")
#: Characters at which str.split() splits too.
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def words_of(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z alone."""
    # bytes.lower() changes A-Z alone
    text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return _WORDS.findall(text) if _ODD.search(text) else text.split()


class WordHashes:
    """64-bit hashes of words; those met before are kept, up to a limit."""

    def __init__(self, limit: int = 300_000):
        self.known: dict[str, bytes] = {}
        self.limit = limit

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), dtype=np.uint64)
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")).to_bytes(8, "little")
            return np.frombuffer(b"".join([known[w] for w in words]), dtype=np.uint64)


#: Odd multipliers, one for each place in a run of words.
_PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words, in order; all words as one run if there are fewer."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out += hashes[i : n - k + 1 + i] * _PLACES[i]
    return mix64(out)


def shingle_set(text: str, hashes: WordHashes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(windows(hashes.of(words_of(text)), width))
