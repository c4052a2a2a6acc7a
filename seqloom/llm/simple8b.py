"""Simple-8b: word-aligned coding of ids, whole arrays at a time.

Each 64-bit word has a selector in its top four bits and ``count`` values of ``width`` bits below.
Selector 15 is the escape: the next word is one value of up to 64 bits, as it is.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: (values in a word, bits of each) by selector; 0 and 1 hold runs of zeros.
SELECTORS = [
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30),
]
#: The last selector of all: one value of up to 64 bits in a word of its own.
ESCAPE = 15
#: A mark for every so many words tells where their ids begin, so that spans decode on their own.
SPAN = 1024


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and marks. A mark is (word, id) at which a span begins.

    Near the end a selector may only be used where that many values are left, and a last value of
    more than 30 bits, or one that no selector fits, is escaped.
    """
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    best = np.full(n, ESCAPE, dtype=np.int8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[s]
        # where ``count`` values of at most ``width`` bits begin, by doubling
        fits, have = ids < np.uint64(1 << width), 1
        while have < count and len(fits) > count - have and fits.any():
            step = min(have, count - have)
            fits, have = fits[:-step] & fits[step:], have + step
        if have < count:
            break  # the narrower selectors hold more values
        best[: len(fits)][fits] = s
    # the walk from word to word; the rest is done on whole arrays
    step = np.array([c for c, _ in SELECTORS] + [1])[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, dtype=np.int64)
    chosen = best[starts] if n else best
    size = 1 + (chosen == ESCAPE)
    place = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = np.zeros(place[-1], dtype="<u8")
    for s in np.unique(chosen):
        which = np.flatnonzero(chosen == s)
        to = place[which]
        words[to] = np.uint64(int(s) << 60)
        if s == ESCAPE:
            words[to + 1] = ids[starts[which]]
            continue
        count, width = SELECTORS[s]
        for k in range(count if width else 0):
            words[to] |= ids[starts[which] + k] << np.uint64(k * width)
    marked = np.arange(0, len(starts), SPAN)
    return words, np.stack([place[marked], starts[marked]], axis=1).astype("<i8") if n else np.zeros((0, 2), "<i8")


def decode(words: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
    """The ids; every span between two marks on its own, all words of one selector at once."""
    out = np.zeros(n, dtype=np.uint64)
    words = np.asarray(words, dtype=np.uint64)
    ends = np.append(marks[1:, 0], len(words)) if len(marks) else []
    for (lo, to), hi in zip(marks, ends, strict=True):
        _decode_span(words[int(lo) : int(hi)], out, int(to))
    return out


def _decode_span(words: np.ndarray, out: np.ndarray, to: int) -> None:
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():
        # a word after an escape is a value: an escape counts if an even number of them stands just before
        own, i = np.ones(len(words), dtype=bool), 0
        for i in np.flatnonzero(selector == ESCAPE).tolist():
            if own[i]:
                own[i + 1] = False
    else:
        own = slice(None)
    heads = np.arange(len(words))[own]
    selector = selector[own]
    counts = np.array([c for c, _ in SELECTORS] + [1])[selector]
    place = to + np.concatenate([[0], np.cumsum(counts)[:-1]])
    for s in np.unique(selector):
        which = selector == s
        if s == ESCAPE:
            out[place[which]] = words[heads[which] + 1]
            continue
        count, width = SELECTORS[s]
        if width == 0:
            continue
        shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
        values = (words[heads[which]][:, None] >> shifts) & np.uint64((1 << width) - 1)
        out[place[which][:, None] + np.arange(count)] = values
