"""Operator 8: passages of at least 50 words that repeat in another document, by a sparse suffix array.

1. Of each text only the suffixes that begin at a minimiser are kept: the smallest hash of SEED words
   in any WINDOW successive places. Two texts with a common passage of WINDOW + SEED - 1 = LEAST
   words or more keep the same suffixes inside it.
2. Suffixes whose first SEED words occur once in all are dropped. Tasks combine what they have
   first, so that a frequent seed sends a row or two from each task and not each place.
3. The others get the words around them: WINDOW - 1 before and, from the seed on, as many as a passage
   must have at least. That is all that can be needed: the first LEAST words of any passage hold a kept
   suffix, which begins at most WINDOW - 1 words after it.
4. They are sorted by seed and following words over ranges (a frequent seed is spread over many tasks)
   and neighbours are compared. For each reach to the left, the suffixes of a seed that share so many
   preceding words stand in the order of their following words, and each is extended to the right with the
   nearest suffix of another document on either side, which has the longest common prefix of all. A match is
   kept if reach and prefix make ``least`` words. Words themselves are compared, not hashes of them.
5. The seeds at the two ends of a range may go on in others, where their neighbours are not at hand. Their
   windows of ``least`` words are counted over all ranges: one row for those that two documents of the
   range have, a row for each of the others.
6. The stretches are united per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import materialise, tasks, texts
from seqloom.llm.shingles import WordHashes, windows, words_of

LEAST, SEED, WINDOW = 50, 20, 31
BEFORE = WINDOW - 1
#: Rows that a task compares at once, if a group of one seed isn't larger.
ROWS = 16_384


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) of every run of ``width`` values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def minimisers(hashes: np.ndarray, seed: int = SEED, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Places of minimisers among the words, and the hashes of their seeds."""
    if len(hashes) < seed + window - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = windows(hashes, seed)
    least = _slide(h, window, np.minimum)
    # a place is chosen if some window that holds it has its hash as the least
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    chosen = np.flatnonzero(_slide(padded, window, np.maximum) == h)
    return chosen, h[chosen]


_ROW = pa.schema([("bucket", pa.int32()), ("shared", pa.bool_()), ("key", pa.binary()), ("doc_id", pa.binary()), ("place", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("place", pa.int32()), ("key", pa.int64())])


def _suffixes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        keys, docs, places, held = [], [], [], 0

        def flush():
            k, d, p = (np.concatenate(x) for x in (keys, docs, places))
            for x in (keys, docs, places):
                x.clear()
            order = np.argsort(k, kind="stable")
            k, d, p = k[order], d[order], p[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(first, len(k)))
            group = np.repeat(np.arange(len(first)), size)
            # a seed that this task has in two documents is known to be shared; one row of it still
            # goes on, for tasks that have it once
            mixed = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first)
            shared = mixed[group]
            head = np.zeros(len(k), dtype=bool)
            head[first] = True
            # of a seed in one document alone one row would not tell the places: all go on
            for flag, rows in ((True, shared), (False, ~shared | head)):
                kk, dd, pp = k[rows], d[rows], p[rows]
                if not len(kk):
                    continue
                bucket = ((kk >> np.uint64(40)) if not flag else dd.astype(np.uint64)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                kk, dd, pp, bucket = kk[order], dd[order], pp[order], bucket[order]
                start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                spans = list(zip(start.tolist(), np.append(start[1:], len(kk)).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[start].astype(np.int32)), pa.array([flag] * len(spans))]
                    + [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (kk.astype("<u8"), dd.astype("<i8"), pp.astype("<i4"))],
                    schema=_ROW,
                )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                place, key = minimisers(hashes.of(words_of(text)))
                if len(place) and doc is not None:
                    keys.append(key)
                    docs.append(np.full(len(key), doc, dtype=np.int64))
                    places.append(place.astype(np.int32))
                    held += len(key)
                    if held > 2_000_000:
                        yield from flush()
                        held = 0
        if keys:
            yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes whose seed stands in two documents. Rows come in order of buckets, of which one is held."""

    def of(chunks):
        k, d, p = (np.concatenate([c[i] for c in chunks]) for i in range(3))
        order = np.argsort(k, kind="stable")
        k, d, p = k[order], d[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        mixed = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first)
        keep = np.repeat(mixed, np.diff(np.append(first, len(k))))
        return pa.RecordBatch.from_arrays([pa.array(d[keep]), pa.array(p[keep]), pa.array(k[keep].view("<i8"))], schema=_FOUND)

    held, held_bucket = [], None
    for batch in batches:
        for bucket, shared, k, d, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = np.frombuffer(k, "<u8"), np.frombuffer(d, "<i8"), np.frombuffer(p, "<i4")
            if shared:
                yield pa.RecordBatch.from_arrays([pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[0].view("<i8"))], schema=_FOUND)
                continue
            if bucket != held_bucket and held:
                yield of(held)
                held = []
            held_bucket = bucket
            held.append(rows)
    if held:
        yield of(held)


_CONTEXT = pa.schema([("key", pa.int64()), ("following", pa.binary()), ("preceding", pa.binary()), ("doc_id", pa.int64()), ("places", pa.list_(pa.int32()))])
#: Bytes of a word that go as they are; a longer one goes as its SHA-256, which is longer than that too.
LONG_WORD = 64


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        data = [squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "packed"])


def _joined(words: list[bytes]) -> tuple[bytes, list[int]]:
    """The words with a blank after each, and where each begins, and the end."""
    return b" ".join(words) + b" ", np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)]).tolist()


def _contexts(after: int):
    """(doc, packed text, places, keys) to rows of places with the words around them: those from the
    place on, and those before it from the nearest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, packed, places, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [w.encode("utf-8", "surrogatepass") for w in words_of(unpack.decompress(packed, max_output_size=1 << 31).decode("utf-8", "surrogatepass"))]
                words = [w if len(w) <= LONG_WORD else b"\0" + hashlib.sha256(w).hexdigest().encode() for w in words]
                n = len(words)
                ahead, at = _joined(words)
                back, back_at = _joined(words[::-1])
                same: dict[tuple, list[int]] = {}  # places with the same words around them are one row
                for p, k in dict(zip(places, keys, strict=True)).items():
                    same.setdefault((k, ahead[at[p] : at[min(p + after, n)]], back[back_at[n - p] : back_at[min(n - p + BEFORE, n)]]), []).append(p)
                rows = [(*around, doc, ps) for around, ps in same.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTEXT, strict=True)], schema=_CONTEXT)

    return run


def _shared_words(rows: list[bytes]) -> np.ndarray:
    """How many words each row has in common with the one before it, from their beginnings on; 0 for the first."""
    out = np.zeros(len(rows), dtype=np.int64)
    for lo in range(1, len(rows), ROWS):
        some = rows[lo - 1 : lo + ROWS]
        width = max(1, max(map(len, some)))
        cells = np.frombuffer(b"".join([r.ljust(width, b"\n") for r in some]), np.uint8).reshape(len(some), width)
        differs = cells[1:] != cells[:-1]
        same = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        out[lo : lo + ROWS] = ((cells[1:] == 32) & (np.arange(width) < same[:, None])).sum(axis=1)
    return out


def _count_words(rows: list[bytes]) -> np.ndarray:
    return np.array([r.count(b" ") for r in rows], dtype=np.int64)


class _Least:
    """The least of any stretch x[lo:hi], hi > lo, by tables of stretches of 1, 2, 4 ... values."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        while 2 ** len(self.levels) <= len(x):
            half = 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for k in np.unique(level):
            rows = level == k
            out[rows] = np.minimum(self.levels[k][lo[rows]], self.levels[k][hi[rows] - 2**k])
        return out


class _Neighbours:
    """Suffixes in order of seed and following words: what each shares with others of its seed."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, following: list[bytes], preceding: list[bytes], least: int):
        self.doc, self.least, n = doc, least, len(key)
        new_seed = np.concatenate([[True], key[1:] != key[:-1]])
        right = np.minimum(_shared_words(following), least)
        right[new_seed] = 0
        self.right = _Least(right)
        seed = np.cumsum(new_seed).tolist()
        self.back = np.array(sorted(range(n), key=lambda i: (seed[i], preceding[i])), dtype=np.int64)
        self.left = _shared_words([preceding[i] for i in self.back])
        seeds = np.array(seed)[self.back]
        self.left[np.concatenate([[True], seeds[1:] != seeds[:-1]])] = -1

    def groups(self, reach: int) -> np.ndarray:
        """A number for each row, equal for rows of a seed that share ``reach`` preceding words."""
        out = np.empty(len(self.back), dtype=np.int64)
        out[self.back] = np.cumsum(self.left < reach)
        return out

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows with a match of ``least`` words in another document, and how far it goes to the left and right."""
        n = len(self.doc)
        left, right = np.full(n, -1), np.zeros(n, dtype=np.int64)
        active = np.arange(n)
        for reach in range(BEFORE + 1):
            group = self.groups(reach)[active]
            order = np.argsort(group, kind="stable")
            rows, group = active[order], group[order]
            doc = self.doc[rows]
            border = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])]))
            size = np.diff(np.append(border, len(rows)))
            before, after = np.repeat(border, size) - 1, np.repeat(border + size, size)
            has_before = (before >= 0) & (group[before] == group)
            has_after = after < len(rows)
            has_after[has_after] = group[after[has_after]] == group[has_after]
            best = np.zeros(len(rows), dtype=np.int64)
            best[has_before] = self.right.of(rows[before[has_before]] + 1, rows[has_before] + 1)
            best[has_after] = np.maximum(best[has_after], self.right.of(rows[has_after] + 1, rows[after[has_after]] + 1))
            found = best >= self.least - reach
            left[rows[found]] = reach
            right[rows[found]] = np.maximum(right[rows[found]], best[found])
            active = np.sort(rows[has_before | has_after])
            if not len(active):
                break
        rows = np.flatnonzero(left >= 0)
        return rows, left[rows], right[rows]

    def windows(self, chosen: np.ndarray, before: np.ndarray, after: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each reach: the ``chosen`` rows whose texts hold a window of ``least`` words from there on, with
        equal windows side by side, and where each group of equal windows begins."""
        for reach in range(BEFORE + 1):
            rows = chosen[(before >= reach) & (after >= self.least - reach)]
            if len(rows):
                group = self.groups(reach)[rows]
                order = np.argsort(group, kind="stable")
                rows, group = rows[order], group[order]
                same = group[1:] == group[:-1]
                same[same] = self.right.of(rows[:-1][same] + 1, rows[1:][same] + 1) >= self.least - reach
                yield reach, rows, np.flatnonzero(np.concatenate([[True], ~same]))


_OUT = pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("high", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()),
                  ("window", pa.binary()), ("places", pa.list_(pa.int32()))])
_OUT_DDL = "kind string, doc_id long, high long, start long, stop long, window binary, places array<int>"


def _out(kind: str, **columns) -> Iterator[pa.RecordBatch]:
    n = len(columns["doc_id"])
    columns["kind"] = pa.repeat(kind, n)
    arrays = [c if isinstance(c := columns.get(f.name), pa.Array) else pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for f in _OUT]
    batch = pa.RecordBatch.from_arrays(arrays, schema=_OUT)
    for lo in range(0, n, 20_000):
        yield batch.slice(lo, 20_000)


def _first_words(row: bytes, n: int) -> bytes:
    return b" ".join(row.split(b" ", n)[:n])


def _compare(least: int):
    """Stretches of one range as ``span``; windows of the seeds at its ends as ``open``: those that two of
    its documents have once, with the least and greatest document, the others with their places."""

    def compared(table: pa.Table, ends: tuple) -> Iterator[pa.RecordBatch]:
        key, doc = table.column("key").to_numpy(), table.column("doc_id").to_numpy()
        following, preceding = table.column("following").to_pylist(), table.column("preceding").to_pylist()
        places = pa.concat_arrays(table.column("places").chunks)
        near = _Neighbours(key, doc, following, preceding, least)
        rows, left, right = near.matches()
        at = places.take(pa.array(rows))
        each, at = pc.list_value_length(at).to_numpy(), at.flatten().to_numpy().astype(np.int64)
        yield from _out("span", doc_id=np.repeat(doc[rows], each), start=at - np.repeat(left, each), stop=at + np.repeat(right, each))
        chosen = np.flatnonzero(np.isin(key, ends))
        before, after = (_count_words([side[i] for i in chosen]) for side in (preceding, following))
        for reach, rows, first in near.windows(chosen, before, after):
            size = np.diff(np.append(first, len(rows)))
            low, high = np.minimum.reduceat(doc[rows], first), np.maximum.reduceat(doc[rows], first)
            heads = rows[first]
            names = [xxhash.xxh3_128_digest(_first_words(preceding[i], reach) + b"\n" + _first_words(following[i], least - reach)) for i in heads.tolist()]
            met = np.flatnonzero(low != high)
            yield from _out("open", doc_id=low[met], high=high[met], window=[names[k] for k in met.tolist()])
            lone = np.repeat(low == high, size)
            of = np.repeat(np.arange(len(first)), size)[lone].tolist()
            begin = np.full(len(of), -reach)
            yield from _out("open", doc_id=doc[rows[lone]], high=doc[rows[lone]], start=begin, stop=begin + least, window=[names[k] for k in of], places=places.take(pa.array(rows[lone])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, first = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[batch.num_rows - 1].as_py()
            first = batch.column(0)[0].as_py() if first is None else first
            held.append(batch)
            rows += batch.num_rows
            if rows >= ROWS and held[0].column(0)[0].as_py() != last:
                table = pa.Table.from_batches(held)
                whole = int(np.searchsorted(table.column("key").to_numpy(), last))
                yield from compared(table.slice(0, whole), (first,))
                held = table.slice(whole).to_batches()
                rows = table.num_rows - whole
        if held:
            yield from compared(pa.Table.from_batches(held), (first, held[-1].column(0)[held[-1].num_rows - 1].as_py()))

    return run


def _stretches(around: DataFrame, n: int, least: int) -> DataFrame:
    """doc_id, start, stop of words that another document has too, in passages of ``least`` words or more."""
    order = ["key", "following", "preceding", "doc_id"]
    ranged = around.repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = materialise(ranged.mapInArrow(_compare(least), _OUT_DDL), "stretches", partition_by="kind")
    # a range has few rows of one window, as its documents that share it are one row
    same = Window.partitionBy("window")
    met = found.where("kind = 'open'").withColumn("least_doc", F.min("doc_id").over(same)).withColumn("greatest_doc", F.max("high").over(same))
    met = met.where("least_doc != greatest_doc AND places IS NOT NULL").withColumn("place", F.explode("places"))
    met = met.select("doc_id", (F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("stop")).alias("stop"))
    return found.where("kind = 'span'").select("doc_id", "start", "stop").union(met)


def repeated_passages(df: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, stop, n_words: the longest stretches of words (places in the text's words, stop
    excluded) in which each word is in a passage of ``least`` words or more that another document has.

    ``least`` may be LEAST or more. A text without such a passage has no row, nor has a null, empty or
    short one, nor a row with a null id. Rows with one id count as one document. Words are
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Other columns are ignored.
    """
    if least < LEAST:
        raise ValueError(f"least must be {LEAST} at least")
    n = tasks(df.sparkSession)
    docs = texts(df, id_col, text_col)
    rows = docs.mapInArrow(_suffixes(16 * n), "bucket int, shared boolean, key binary, doc_id binary, place binary")
    shared = rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "doc_id long, place int, key long")
    by_doc = shared.groupBy("doc_id").agg(F.collect_list(F.struct("place", "key")).alias("found"))
    by_doc = by_doc.select("doc_id", F.col("found.place").alias("places"), F.col("found.key").alias("keys"))
    packed = docs.where("doc_id IS NOT NULL").mapInArrow(_pack, "doc_id long, packed binary")
    around = packed.join(by_doc, "doc_id").select("doc_id", "packed", "places", "keys")
    around = around.mapInArrow(_contexts(least), "key long, following binary, preceding binary, doc_id long, places array<int>")
    around = materialise(around, "suffixes")
    spans = _stretches(around, n, least)
    # unite what overlaps or touches
    line = Window.partitionBy("doc_id").orderBy("start", "stop")
    reach = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    united = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return united.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"))
