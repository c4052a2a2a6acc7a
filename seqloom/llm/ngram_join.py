"""Operator 9: Jaccard join of five-word shingle sets by parity sketches.

Two texts link when 100 * |A & B| >= 75 * |A | B|; then |A ^ B| <= (|A| + |B|) / 7 =: D.

* Texts with one set are one class; from there on classes are joined, each once.
* Keys. Sizes fall into bands (powers of two). A band deals its shingles into P > D parts and XORs the
  hashes of each part into a sketch of the part, which is a key. At most D parts hold a shingle that
  only one of two linked texts has; the sketches of all others agree. A text stands in its own band
  and in the next one if a partner can lie there. Should a text have no more than D parts with
  shingles, its empty parts are keys too. Sets of up to 16 shingles have their shingles as keys.
* Prefixes. Of the keys of a linked text at most D are its own, so in any order that is the same for
  all texts its first D + 1 keys hold one of its partner. The order is by the number of classes that
  have a key: keys that one class alone has come first and need no partner, and a frequent key (of a
  passage that many texts quote) is used by those texts alone that have too few others. Nothing is
  lost by this, whatever the counts are.
* Filter. Each class has a bit sketch: every shingle flips one bit. The Hamming distance of two
  sketches is at most |A ^ B|, so pairs beyond D are dropped; the longer sketch is folded first.
* Verification compares the whole sets, made again from the texts.

Large meeting groups are not paired out. Their members are compared with the first one. Where the
members aren't all in one component then, each member outside the largest one is compared with its
nearest partner by bit sketch, and at last the pairs between components that are still left are
tested, in blocks of bounded size, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import if_small, materialise, mix64, tasks, texts, tidy
from seqloom.llm.components import components
from seqloom.llm.shingles import WordHashes, shingle_set

#: Meeting groups up to this size are paired out at once.
SMALL_GROUP = 48
#: Members of a larger group that one task compares with as many others.
BLOCK = 2048
#: Pairs of one class that a task compares in one go; the class's sketch or text is sent once for each.
PAIR_BLOCK = 256
SMALL_SET = 16
#: The size of a key that was not counted, as a task alone had many classes with it.
UNCOUNTED = 2**31 - 1


def _band(size: int) -> int:
    return max(0, (size - 1).bit_length())


def _parts(band: int) -> int:
    """The number of parts into which a band deals shingles; more than two linked sets can differ in."""
    return int(2 * (1 << band) / 7 * (2.0 if band <= 6 else 1.3)) + 1


def key_sets(shingles: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(band, how many keys a link may leave without partner, keys) of a sorted set of shingle hashes.

    Small sets are band 0. Of linked sets' keys in the band of the larger one one at least agrees,
    also among the first (that number + 1) of each in any common order.
    """
    n, found = len(shingles), []
    if n <= SMALL_SET:
        found.append((0, n // 4, mix64(shingles ^ np.uint64(0x5BD1E995))))
    for band in sorted({_band(n), _band(4 * n // 3)}):
        if 1 << band <= SMALL_SET:
            continue
        parts = _parts(band)
        part = (mix64(shingles ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(20)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sketches, at = np.bitwise_xor.reduceat(shingles[order], first), part[first]
        differing = (n + min(4 * n // 3, 1 << band)) // 7
        if len(at) <= differing:
            at = np.concatenate([at, np.setdiff1d(np.arange(parts, dtype=np.uint64), at)])
            sketches = np.concatenate([sketches, np.zeros(len(at) - len(sketches), np.uint64)])
            differing = parts
        found.append((band, differing, mix64(sketches ^ mix64(at + np.uint64(band << 32)))))
    return found


def bit_sketch(shingles: np.ndarray) -> bytes:
    """Each shingle flips one of 2**k bits, 256 to 32768, at least eight for each shingle where that is
    possible, so that the distance of two sketches is seldom below the symmetric difference."""
    bits = 1 << min(15, max(8, _band(8 * len(shingles))))
    at = mix64(shingles ^ np.uint64(0xE7037ED1A0B428DB)) & np.uint64(bits - 1)
    flips = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as it would be with fewer bits."""
    x = np.frombuffer(sketch, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def hamming(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())


def may_link(n_a: int, n_b: int, sketch_a: bytes, sketch_b: bytes) -> bool:
    return 4 * min(n_a, n_b) >= 3 * max(n_a, n_b) and 7 * hamming(sketch_a, sketch_b) <= n_a + n_b


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


_SETS = pa.list_(pa.struct([("band", pa.int32()), ("keys", pa.int32()), ("own", pa.int32())]))
_PLAIN = [("kind", pa.string()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("cls2", pa.int64()), ("ref", pa.int64()), ("sets", _SETS)]
_SCAN = pa.schema([*_PLAIN, ("bucket", pa.int32()), ("bands", pa.binary()), ("keys", pa.binary()), ("places", pa.binary()), ("marked", pa.binary())])
_MET = pa.schema([*_PLAIN, ("band", pa.int32()), ("key", pa.int64()), ("size", pa.int32())])
#: What tells the keys of a block.
_BLOCK = ["bucket", "ref", "bands", "keys", "places", "marked"]
_PLAIN_SQL = "kind string, doc_id long, mark long, n long, cls long, cls2 long, ref long, sets array<struct<band: int, keys: int, own: int>>"
_SCAN_SQL = f"{_PLAIN_SQL}, bucket int, bands binary, keys binary, places binary, marked binary"
_MET_SQL = f"{_PLAIN_SQL}, band int, key long, size int"
#: Keys that a task holds before it gives them out (those of at most HELD_SETS classes), and that a task
#: which counts them holds before it looks for frequent ones.
HELD_KEYS, HELD_SETS = 1_000_000, 1 << 16


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _SCAN], schema=_SCAN)


def _heads(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin in a sorted array, and their lengths."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(x)))


def _placed(keys: np.ndarray, band: int, buckets: int) -> np.ndarray:
    """Bucket, band and 32 bits of each key in one number; from here on they are the key."""
    return np.unique((keys >> np.uint64(32)) % np.uint64(buckets) << np.uint64(37) | np.uint64(band << 32) | keys & np.uint64(0xFFFFFFFF))


def _blocks(ref: int, sets: list[np.ndarray], places: list[int], small_group: int) -> Iterator[pa.RecordBatch]:
    """What a task holds as one row for each bucket: how many keys of each band, 32 bits of each key, and
    the place of its class among those from ``ref`` on. Keys that the task has in more than
    ``small_group`` classes don't go to their bucket but for one, marked; so no bucket gets all of a hot key."""
    k = np.concatenate(sets)
    c = np.repeat(np.array(places, "<u2"), [len(x) for x in sets])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first, size = _heads(k)
    hot = np.repeat(size > small_group, size)
    lead = np.zeros(len(k), bool)
    lead[first] = True
    for kind, some in (("keys", ~hot | lead), ("hot", hot)):
        kk, cc, marked = k[some], c[some], hot[some]
        at, size = _heads(kk >> np.uint64(37))
        low, bands = (kk & np.uint64(0xFFFFFFFF)).astype("<u4"), ((kk >> np.uint64(32)) & np.uint64(31)).astype(np.int64)
        for lo in range(0, len(at), 1024):
            rows = []
            for a, m in zip(at[lo : lo + 1024].tolist(), size[lo : lo + 1024].tolist(), strict=True):
                of = slice(a, a + m)
                rows.append({
                    "kind": kind, "bucket": int(kk[a] >> np.uint64(37)), "ref": ref, "bands": np.bincount(bands[of]).astype("<u4").tobytes(),
                    "keys": low[of].tobytes(), "places": cc[of].tobytes(), "marked": np.flatnonzero(marked[of]).astype("<u4").tobytes(),
                })
            yield _batch(rows)


def _scan(buckets: int, small_group: int):
    """Members (doc, text's mark, size, class), classes that are new to this task, under a number (ref)
    of its own, and the keys of these. Members and classes are dealt evenly to the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        ref = TaskContext.get().partitionId() << 36
        held: list[np.ndarray] = []
        places: list[int] = []
        n, classes, turn = 0, 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                rows = []
                for doc, text, mark in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    turn = (turn + 1) % buckets
                    s = shingle_set(text, hashes)
                    digest = xxhash.xxh3_128_digest(s.tobytes())
                    cls, cls2 = (int.from_bytes(x, "little", signed=True) for x in (digest[:8], digest[8:])) if len(s) else (None, None)
                    rows.append({"kind": "member", "doc_id": doc, "mark": mark, "n": len(s), "cls": cls, "cls2": cls2, "bucket": turn})
                    if len(s) and digest not in seen and doc is not None:
                        seen.add(digest)
                        sets = []
                        for band, differing, found in key_sets(s):
                            held.append(_placed(found, band, buckets))
                            places.append(classes)
                            sets.append({"band": band, "keys": len(held[-1]), "own": differing})
                            n += len(held[-1])
                        rows.append({"kind": "class", "doc_id": doc, "mark": mark, "n": len(s), "cls": cls, "cls2": cls2, "ref": ref | classes, "sets": sets, "bucket": turn})
                        classes += 1
                        if n > HELD_KEYS or classes == HELD_SETS:
                            yield from _blocks(ref, held, places, small_group)
                            held.clear(), places.clear()
                            n, classes, ref = 0, 0, ref + HELD_SETS
                if len(seen) > 300_000:
                    seen.clear()
                yield _batch(rows)
        if held:
            yield from _blocks(ref, held, places, small_group)

    return run


def _met(k: np.ndarray, refs: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    band = ((k >> np.uint64(32)) & np.uint64(31)).astype(np.int32)
    for lo in range(0, len(k), 100_000):
        some = slice(lo, lo + 100_000)
        columns = {"kind": pa.repeat("met", len(k[some])), "ref": refs[some], "band": band[some], "key": k[some].view(np.int64), "size": size[some].astype(np.int32)}
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(k[some]), f.type) for f in _MET], schema=_MET)


def _opened(bucket: int, ref: int, bands: bytes, keys: bytes, places: bytes, marked: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and refs of a block, and those of its keys that are marked."""
    counts = np.frombuffer(bands, "<u4")
    k = np.repeat(np.arange(len(counts), dtype=np.uint64) << np.uint64(32), counts) | np.uint64(bucket << 37) | np.frombuffer(keys, "<u4").astype(np.uint64)
    return k, np.frombuffer(places, "<u2").astype(np.int64) + ref, k[np.frombuffer(marked, "<u4")]


def _shared_keys(small_group: int, limit: int = 4 * HELD_KEYS):
    """Members and classes as they come; keys that two refs have, with their number of refs (UNCOUNTED if
    a task that sent them, or this one when it held ``limit`` keys, found the key frequent). Rows come in
    order of buckets, of which one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        frequent = np.zeros(0, np.uint64)
        n, room, bucket = 0, limit, None

        def sorted_():
            k, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(k, kind="stable")
            return k[order], c[order]

        def of_bucket():
            nonlocal frequent, n, room
            if held:
                k, c = sorted_()
                first, size = _heads(k)
                each = size.copy()
                size[np.isin(k[first], frequent)] = UNCOUNTED
                size = np.repeat(size, each)
                shared = size > 1
                yield from _met(k[shared], c[shared], size[shared])
            frequent, n, room = np.zeros(0, np.uint64), 0, limit

        for batch in batches:
            kind = batch.column(0)
            plain = batch.filter(pc.is_in(kind, pa.array(["member", "class"])))
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([*plain.columns[: len(_PLAIN)], *[pa.nulls(plain.num_rows, f.type) for f in list(_MET)[len(_PLAIN) :]]], schema=_MET)
            blocks = batch.filter(pc.is_in(kind, pa.array(["keys", "hot"]))).select(["kind", *_BLOCK])
            for what, *row in zip(*(col.to_pylist() for col in blocks.columns), strict=True):
                k, c, marked = _opened(*row)
                if what == "hot":
                    yield from _met(k, c, np.full(len(k), UNCOUNTED))
                    continue
                if row[0] != bucket:
                    yield from of_bucket()
                    bucket = row[0]
                if len(marked):
                    frequent = np.union1d(frequent, marked)
                held.append((k, c))
                n += len(k)
                if n > room:
                    k, c = sorted_()
                    first, size = _heads(k)
                    frequent = np.union1d(frequent, k[first[size > small_group]])
                    hot = np.isin(k, frequent)
                    yield from _met(k[hot], c[hot], np.full(int(hot.sum()), UNCOUNTED))
                    held.append((k[~hot], c[~hot]))
                    n = len(held[0][0])
                    room = max(limit, 2 * n)
        yield from of_bucket()

    return run


_PACKED = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("packed", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to the class's size, bit sketch and compressed text."""
    hashes, squeeze = WordHashes(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            some = batch.slice(lo, 512)
            texts_ = some.column(1).to_pylist()
            sets = [shingle_set(t, hashes) for t in texts_]
            packed = [squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in texts_]
            columns = [some.column(0), [len(s) for s in sets], [bit_sketch(s) for s in sets], packed]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)


def _packed(docs: DataFrame, meeting: DataFrame) -> DataFrame:
    """The classes (node, doc_id, mark) with size, sketch and text, one row for each. They are written where their texts
    are read; only where rows are repeated are they shuffled, as that sorts all sketches and texts."""
    rows = docs.join(if_small(meeting), ["doc_id", "mark"]).select("node", "text").mapInArrow(tidy(_pack), "node long, n long, sketch binary, packed binary")
    rows = materialise(rows, "meeting-texts")
    return rows if rows.count() == meeting.count() else materialise(rows.dropDuplicates(["node"]), "meeting-texts")


def _paired(met: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, of the nodes of each key, of which none has more than a small group's. A join, as no
    array of a key's nodes is held."""
    nodes = met.select("key", "node").distinct()
    return nodes.withColumnRenamed("node", "a").join(nodes.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b")


def _prefixes(met: DataFrame, refs: DataFrame) -> DataFrame:
    """(node, key, size): of each class and band the rarest keys, as many as hold one of each partner."""
    sets = refs.select("node", "ref", F.explode("sets").alias("s")).select("node", "ref", "s.*")
    rows = met.join(sets, ["ref", "band"])
    same = Window.partitionBy("node", "band")
    # a key that comes from several refs of a class has one rank
    ranked = rows.withColumn("rank", F.dense_rank().over(same.orderBy("size", "key"))).withColumn("shared", F.max("rank").over(same))
    return ranked.where("rank <= own + 1 - (keys - shared)").select("node", "key", "size").distinct()


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compared(pairs: DataFrame, classes: DataFrame, opened, agree) -> DataFrame:
    """The pairs (a, b) of which ``agree`` is true of what ``opened`` makes of both classes' rows (node, n,
    data). The pairs of one a go to blocks of about PAIR_BLOCK; a's row is sent once for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, root, open_row = None, None, opened()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                found = []
                for a, block, node, n, data in zip(*(c.to_pylist() for c in batch.slice(lo, 1024).columns), strict=True):
                    one = open_row(n, data)
                    if node == a:
                        open_, root = (a, block), one
                    elif open_ != (a, block):
                        raise ValueError(f"class {a} is not there for its pairs")
                    elif agree(root, one):
                        found.append((a, node))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], schema=_PAIRS)

    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).alias("blocks"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    wanted = dealt.select("a", "block", F.col("b").alias("node")).union(dealt.select("a", "block", F.col("a").alias("node")).distinct())
    sent = wanted.join(classes, "node").withColumn("other", F.col("node") != F.col("a"))
    sent = sent.repartition(tasks(pairs.sparkSession), "a", "block").sortWithinPartitions("a", "block", "other", "node")
    return sent.select("a", "block", "node", "n", "data").mapInArrow(tidy(run), "a long, b long")


def _filter_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sizes and bit sketches allow a link."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * least(n_a, n_b) >= 3 * greatest(n_a, n_b)").select("a", "b")
    opened = lambda: lambda n, sketch: (n, sketch)
    return _compared(sized, classes.select("node", "n", F.col("sketch").alias("data")), opened, lambda x, y: may_link(x[0], y[0], x[1], y[1]))


def _verify(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets, made again from the texts, link."""

    def opened():
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()
        return lambda n, packed: shingle_set(unpack.decompress(packed, max_output_size=1 << 31).decode("utf-8", "surrogatepass"), hashes)

    return _compared(pairs, classes.select("node", "n", F.col("packed").alias("data")), opened, linked)


def _within_groups(groups: DataFrame, labels: DataFrame, classes: DataFrame, block: int, best: bool) -> DataFrame:
    """Pairs between the components of large meeting groups that sizes and sketches allow to link.

    The members of a group's largest component need no test among themselves; every other member is
    compared with all members of other components, in blocks of about ``block`` by ``block``. With
    ``best`` only the nearest partner of each such member is returned.
    """
    named = groups.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    named = named.select("key", "node", F.coalesce("label", "node").alias("label"))
    counts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    sizes = counts.groupBy("key").agg(
        F.sum("m").alias("size"), F.max("m").alias("top"), F.max_by("label", F.struct("m", "label")).alias("main")
    )
    open_ = sizes.where("size > top").select(
        "key", "main", F.ceil((F.col("size") - F.col("top")) / block).cast("int").alias("m_blocks"), F.ceil(F.col("size") / block).cast("int").alias("blocks")
    )
    rows = named.join(open_, "key").join(classes.select("node", "n", "sketch"), "node")
    rows = rows.withColumn("minor", F.col("label") != F.col("main")).withColumn("h", F.xxhash64("node"))
    # i: block of the members outside the largest component; j: block of all members
    rows = rows.withColumn(
        "at",
        F.expr("""explode(if(m_blocks = 1 AND blocks = 1, array(struct(0 AS i, 0 AS j, minor AS x, true AS y)), concat(
          if(minor, transform(sequence(0, blocks - 1), j -> struct(cast(pmod(h, m_blocks) AS int) AS i, j AS j, true AS x, false AS y)),
             cast(array() AS array<struct<i: int, j: int, x: boolean, y: boolean>>)),
          transform(sequence(0, m_blocks - 1), i -> struct(i AS i, cast(pmod(h, blocks) AS int) AS j, false AS x, true AS y)))))"""),
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        n, label, node = (pdf[c].to_numpy() for c in ("n", "label", "node"))
        least = min(map(len, pdf["sketch"]))
        wide = np.stack([_folded(s, least) for s in pdf["sketch"]])
        # all pairs by a quarter of the bits; only those that these allow by all bits
        narrow = np.stack([_folded(s, max(8, least // 4)) for s in pdf["sketch"]])
        x, y = np.flatnonzero(pdf["x"]), np.flatnonzero(pdf["y"])
        found = [np.zeros((0, 2), np.int64)]
        far = [np.zeros(0)]
        for lo in range(0, len(x) if len(y) else 0, 32):
            some = x[lo : lo + 32]
            n1, n2 = n[some][:, None], n[y][None]
            ok = (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)) & (label[some][:, None] != label[y][None])
            distance = np.zeros(ok.shape, np.int64)
            for part in range(narrow.shape[1]):
                distance += np.bitwise_count(narrow[some, part][:, None] ^ narrow[y, part][None])
            i, k = np.nonzero(ok & (7 * distance <= n1 + n2))
            distance = np.bitwise_count(wide[some[i]] ^ wide[y[k]]).sum(axis=1, dtype=np.int64)
            both = n[some[i]] + n[y[k]]
            near = 7 * distance <= both
            i, k, ratio = i[near], k[near], (distance / both)[near]
            if best:
                order = np.lexsort((k, ratio, i))
                first = np.concatenate([[True], i[order][1:] != i[order][:-1]]) if len(order) else np.zeros(0, bool)
                i, k, ratio = i[order][first], k[order][first], ratio[order][first]
            found.append(np.stack([node[some[i]], node[y[k]]], axis=1))
            far.append(ratio)
        out = pd.DataFrame(np.concatenate(found), columns=["z", "x"])
        out["far"] = np.concatenate(far)
        return out

    rows = rows.select("key", "node", "label", "n", "sketch", "at.i", "at.j", "at.x", "at.y")
    met = rows.groupBy("key", "i", "j").applyInPandas(compare, "z long, x long, far double")
    if best:
        met = met.groupBy("z").agg(F.min(F.struct("far", "x")).alias("to")).select("z", "to.x")
    return met.select(F.least("z", "x").alias("a"), F.greatest("z", "x").alias("b")).distinct()


def _labelled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between classes as links between the components that are known."""
    for side in ("a", "b"):
        of = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        links = links.join(of, side, "left")
    links = links.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    return links.where("a != b").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after one step along the links: what is joined is connected, though not all that is."""
    step = _labelled(links, labels)
    least = step.select(F.greatest("a", "b").alias("old"), F.least("a", "b").alias("new")).groupBy("old").agg(F.min("new").alias("new"))
    own = labels.select("node", "label").union(least.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("old").alias("label")))
    return own.join(least, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components of the labels' and these links."""
    over = components(_labelled(links, labels)).select(F.col("node").alias("old"), F.col("label").alias("new"))
    own = labels.select("node", "label").union(over.join(labels, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("old").alias("label")))
    return materialise(own.join(over, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), "labels")


def _components(df: DataFrame, id_col: str, text_col: str, small_group: int, block: int, held: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component_id for every row of ``df``."""
    n = tasks(df.sparkSession)
    docs = texts(df, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    # one pass over the texts gives members, classes and keys; of the keys those that are shared are kept
    scanned = docs.mapInArrow(tidy(_scan(4 * n, small_group)), _SCAN_SQL).repartition(n, "bucket").sortWithinPartitions("bucket")
    scanned = scanned.mapInArrow(tidy(_shared_keys(small_group, held)), _MET_SQL)
    scanned = materialise(scanned, "shingle-classes", partition_by="kind")
    members = scanned.where("kind = 'member'").select("doc_id", "mark", "n", "cls", "cls2")
    copies = scanned.where("kind = 'class'").select("ref", "cls", "cls2", "doc_id", "mark", "sets")
    # of each class the one text that stands for it, however many rows have its id or repeat it
    classes = copies.groupBy("cls", "cls2").agg(F.min(F.struct("doc_id", "mark", "ref")).alias("of"))
    classes = materialise(classes.select("cls", "cls2", "of.doc_id", "of.mark", F.col("of.ref").alias("node")), "classes")
    refs = copies.select("ref", "cls", "cls2", "sets").join(classes.select("cls", "cls2", "node"), ["cls", "cls2"])
    met = materialise(_prefixes(scanned.where("kind = 'met'").select("ref", "band", "key", "size"), refs), "meetings")
    # only classes that meet others go on, with their sketches and texts
    meeting = materialise(classes.join(met.select("node").distinct(), "node").select("node", "doc_id", "mark"), "meeting-classes")
    meeting = _packed(docs, meeting)
    small = _paired(met.where(F.col("size") <= small_group))
    large = met.where(F.col("size") > small_group).select("key", "node").distinct()
    first = large.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    groups = materialise(large.join(first, "key").select("key", "a", "node"), "meeting-groups")
    stars = groups.where("a != node").select("a", F.col("node").alias("b"))
    candidates = materialise(_filter_pairs(small.union(stars).distinct(), meeting), "candidates")
    # first each class with its first candidate; then what these leave open
    first = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialise(_verify(first, meeting), "links")
    root = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    rest = candidates.join(first, ["a", "b"], "left_anti")
    rest = rest.join(root.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
    rest = rest.join(root.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left")
    rest = materialise(rest.where("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b"), "candidates")
    if not rest.isEmpty():
        links = links.union(materialise(_verify(rest, meeting), "links"))
    labels = components(links)
    groups = groups.select("key", "node")
    if not groups.isEmpty():
        # the nearest partners join most of what is left; then every pair that may still matter
        near, more = labels, None
        for best in (True, False):
            met_late = materialise(_within_groups(groups, near, meeting, block, best), "candidates")
            if met_late.isEmpty():
                break
            found = materialise(_verify(met_late, meeting), "links")
            more = found if more is None else more.union(found)
            if best:
                near = materialise(_merged(labels, found), "labels")
        if more is not None:
            labels = _joined(labels, more)
    # the smallest document of each component, by way of the classes
    smallest = members.where("cls IS NOT NULL").groupBy("cls", "cls2").agg(F.min("doc_id").alias("doc_id"))
    smallest = smallest.join(classes.select("node", "cls", "cls2"), ["cls", "cls2"]).join(labels, "node", "left")
    smallest = smallest.select("cls", "cls2", "doc_id", F.coalesce("label", "node").alias("label"))
    least = smallest.groupBy("label").agg(F.min("doc_id").alias("component"))
    of_class = materialise(smallest.join(least, "label").select("cls", "cls2", "component"), "class-components")
    return members.join(of_class, ["cls", "cls2"], "left").select(
        "doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", small_group: int = SMALL_GROUP, block: int = BLOCK, held: int = 4 * HELD_KEYS
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``df``.

    component_id is the smallest doc_id that links reach. A null, empty or blank text has no
    shingles and links with nothing. Rows with equal ids or texts are kept as they are; rows with a
    null id get the component of their text, null if no row with an id has it. Other columns are
    ignored. The other parameters change the work, not the result.
    """
    return _components(df, id_col, text_col, small_group, block, held).drop("mark")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component, with all their columns.

    Each row goes by its own text: of several texts of one id those alone go that link with a smaller
    id. Rows with a null id stay, as do empty texts and rows that repeat the one that stays.
    """
    found = _components(df, id_col, text_col, SMALL_GROUP, BLOCK, 4 * HELD_KEYS).where("doc_id != component_id")
    gone = materialise(found.select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct(), "near-copies")
    same = (F.col(id_col).cast("long") == F.col("__gone")) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col("__mark"))
    return df.join(if_small(gone), same, "left_anti")
