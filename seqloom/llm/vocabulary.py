"""Splitting of texts at white space and the ids of each distinct piece.

The tokenizer drops white space and no token reaches across it, so the ids of a text are those of
its white-space-separated pieces in turn. Pieces repeat; each worker keeps those it has met.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: str.split() also splits at these four controls, which Unicode does not count as white space.
_EXTRA = re.compile("[\x1c-\x1f]")
#: Unicode's White_Space characters.
_WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def pieces(text: str) -> list[str]:
    if _EXTRA.search(text):
        return [p for p in _WHITE.split(text) if p]
    return text.split()


class _Generations:
    """A dict that forgets what two generations of ``limit`` entries haven't asked for."""

    def __init__(self, limit: int):
        self.limit, self.now, self.before = limit, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that are not known; those that are known are in ``now`` afterwards."""
        if len(self.now) > self.limit:
            self.now, self.before = {}, self.now
        absent = keys.difference(self.now)
        if self.before:
            found = {k: v for k in absent if (v := self.before.get(k)) is not None}
            self.now.update(found)
            absent.difference_update(found)
        return list(absent)


#: Punctuation that ends a piece and is a run of its own, whatever letters stand before it.
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def plain(word: str) -> bool:
    """Letters in composed form whose lower case does not depend on what stands beside them."""
    return word.isalpha() and (word.isascii() or (unicodedata.is_normalized("NFC", word) and "Σ" not in word and "İ" not in word))


class PieceCache:
    """Ids of pieces as little-endian uint32 bytes, computed in batches by ``encode_many``.

    A new piece that is letters and then punctuation is put together from its two parts, so that a
    word is encoded once for all its endings and capitals.
    """

    def __init__(self, encode_many, limit: int = 250_000):
        self.encode_many = encode_many
        self.whole, self.parts = _Generations(limit), _Generations(limit)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [pieces(t) for t in texts]
        new = self.whole.missing(set().union(*split)) if split else []
        if new:
            plans, wanted = [], set()
            for piece in new:
                core = piece.rstrip(_TAIL)
                if plain(core):
                    plan = (core.lower(), piece[len(core) :])
                else:
                    plan = (piece, "")
                plans.append(plan)
                wanted.update(plan)
            wanted.discard("")
            unknown = self.parts.missing(wanted)
            for start in range(0, len(unknown), 50_000):
                some = unknown[start : start + 50_000]
                self.parts.now.update(zip(some, self.encode_many(some), strict=True))
            known = self.parts.now
            for piece, (core, tail) in zip(new, plans, strict=True):
                self.whole.now[piece] = known[core] + known[tail] if tail else known[core]
        ids = self.whole.now
        return [b"".join([ids[p] for p in s]) for s in split]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain_bytes = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain_bytes}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(plain_bytes)))
    return [letters[b] for b in range(256)]


_loaded: dict = {}


class LibraryPieces(dict):
    """Ids of pieces as little-endian uint32 bytes, by the tokenizers library; pieces are encoded
    when they are first asked for. A piece of letters and then punctuation is put together from its
    two parts, so that a word is encoded once for all its endings and capitals."""

    def __init__(self, path: str, specials_as_text: bool, limit: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        tok.encode_special_tokens = specials_as_text
        self.tok, self.model, self.limit = tok, tok.model, limit
        self.parts: dict[str, bytes] = {}
        self.coded = [x.tobytes() for x in np.arange(tok.get_vocab_size(with_added_tokens=True), dtype="<u4")]
        self.letters = {b: x for b, x in enumerate(byte_letters())}

    def __missing__(self, piece: str) -> bytes:
        core = piece.rstrip(_TAIL)
        if plain(core):
            low, tail = core.lower(), piece[len(core) :]
            ids = self.parts.get(low)
            if ids is None:
                # a word of lower-case letters needs neither normalising nor splitting
                form = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
                ids = self.parts[low] = b"".join([self.coded[t.id] for t in self.model.tokenize(form)])
            if tail:
                ends = self.parts.get(tail)
                ids += ends if ends is not None else self.parts.setdefault(tail, self._encode(tail))
        else:
            ids = self._encode(piece)
        self[piece] = ids
        return ids

    def _encode(self, piece: str) -> bytes:
        return b"".join([self.coded[i] for i in self.tok.encode(piece, add_special_tokens=False).ids])

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > self.limit:
            self.clear()
        if len(self.parts) > self.limit:
            self.parts.clear()
        get = self.__getitem__
        return [b"".join(map(get, pieces(t))) for t in texts]


def library_cache(path: str, specials_as_text: bool = False, limit: int = 600_000) -> LibraryPieces:
    """The pieces of one tokenizer; one cache of ``limit`` pieces (about 0.4 KB each) for each worker process."""
    key = (path, specials_as_text, limit)
    if key not in _loaded:
        _loaded[key] = LibraryPieces(path, specials_as_text, limit)
    return _loaded[key]
