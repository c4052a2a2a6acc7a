"""Factorisation machines over hashed terms: fitting on a bounded sample, scoring of whole texts.

A text's features are the terms that occur in it (hashed to 64 bits; the model holds the terms it has
learned, others count as absent) and, if asked for, statistics of its structure and metadata. The
score is the logistic of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

whose last sum is taken in linear time as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import if_small, materialise, tasks, tidy

#: Punctuation at the ends of a word; the word inside is a term of its own.
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’…"
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_UPPER, _DIGITS, _SPACES = bytes(range(65, 91)), b"0123456789", b" \t\n\x0b\x0c\r"
STATISTICS = 12


def terms_of(word: str) -> list[str]:
    """A lower-case word as it stands, without punctuation at its ends, its beginnings, and its end marks."""
    core = word.strip(_EDGES)
    found = {word, core}
    found.update(f"^{core[:n]}" for n in (3, 4, 5, 6, 7) if len(core) > n)
    tail = word[len(word.rstrip(_EDGES)) :]
    if tail:
        found.add(f"~{tail[-4:]}")
    found.discard("")
    return list(found)


def _hash(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass"))


def statistics_of(text: str, words: list[str], n_chars: int | None) -> list[float]:
    """Structure and metadata; all of them bounded or logarithmic, so that a very long text is no outlier."""
    raw = text.encode("utf-8", "surrogatepass")
    n, n_words = max(1, len(raw)), max(1, len(words))
    gone = lambda which: n - len(raw.translate(None, which)) if raw else 0
    letters, spaces, digits = gone(_LETTERS), gone(_SPACES), gone(_DIGITS)
    lines = [x for x in text.split("\n") if x]
    n_lines = max(1, len(lines))
    return [
        math.log1p(len(text)), math.log1p(len(words)), min(40.0, len(text) / n_words) / 10, letters / n, digits / n,
        gone(_UPPER) / n, (n - letters - spaces - digits) / n if raw else 0.0, len(set(words)) / n_words, math.log1p(n_lines),
        len(set(lines)) / n_lines, text.count("|") / n_words, math.log1p(len(text) if n_chars is None else max(0, n_chars)),
    ]


@dataclass
class Model:
    terms: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _sums(self, rows, columns, values, n):
        linear = np.bincount(rows, self.linear[columns] * values, n)
        vx = self.factors[columns] * values[:, None]
        total = np.stack([np.bincount(rows, vx[:, f], n) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(rows, (vx * vx).sum(axis=1), n)
        return linear, vx, total, squares

    def raw(self, rows, columns, values, n) -> np.ndarray:
        linear, _, total, squares = self._sums(rows, columns, values, n)
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)


def _entries(term_lists: list, stats: np.ndarray | None, model: Model):
    """Rows, columns and values of the features; a term's value is 1, a statistic's its standard score."""
    sizes = np.array([len(t) for t in term_lists], dtype=np.int64)
    rows = np.repeat(np.arange(len(term_lists)), sizes)
    columns = np.fromiter((c for t in term_lists for c in t), dtype=np.int64, count=int(sizes.sum()))
    values = np.ones(len(columns))
    if len(model.mean):
        z = np.clip((stats - model.mean) / model.scale, -4, 4)
        k = z.shape[1]
        rows = np.concatenate([rows, np.repeat(np.arange(len(z)), k)])
        columns = np.concatenate([columns, np.tile(np.arange(len(model.terms), len(model.terms) + k), len(z))])
        values = np.concatenate([values, z.ravel()])
    return rows, columns, values


def fit(
    terms: dict[int, int], lists: list[np.ndarray], stats: np.ndarray | None, labels: np.ndarray, rank: int = 6, epochs: int = 30,
    step: float = 0.05, decay: float = 2e-3, seed: int = 7,
) -> Model:
    """Fit by Adam on mini-batches. ``terms`` has the column of each term to be learned, ``lists`` the
    columns of the terms that each row has."""
    y = labels.astype(float)
    n, n_pos = len(y), float(y.sum())
    share = n_pos / max(n, 1)
    width = len(terms) + (0 if stats is None else stats.shape[1])
    r = np.random.default_rng(seed)
    model = Model(terms, math.log((n_pos + 1) / (n - n_pos + 1)), np.zeros(width), r.normal(0, 0.02, (width, rank)))
    if stats is not None:
        model.mean, model.scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-6) if n else (np.zeros(stats.shape[1]), np.ones(stats.shape[1]))
    weight = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) ** 0.5  # half way to equal classes
    slots = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.linear, model.factors)]
    bias_slot, t = [0.0, 0.0], 0
    for _ in range(epochs if n else 0):
        order = r.permutation(n)
        for lo in range(0, n, 256):
            batch = order[lo : lo + 256]
            m = len(batch)
            rows, cols, values = _entries([lists[b] for b in batch], None if stats is None else stats[batch], model)
            linear, vx, total_v, squares = model._sums(rows, cols, values, m)
            raw = model.bias + linear + 0.5 * ((total_v * total_v).sum(axis=1) - squares)
            error = weight[batch] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]) / m
            g_linear = np.bincount(cols, error[rows] * values, len(model.linear)) + decay * model.linear / 10
            pull = (error[rows] * values)[:, None] * (total_v[rows] - vx)
            g_factors = np.stack([np.bincount(cols, pull[:, f], len(model.linear)) for f in range(rank)], axis=1) + decay * model.factors
            t += 1
            fix = math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, s in ((model.linear, g_linear, slots[0]), (model.factors, g_factors, slots[1])):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                p -= step * fix * s[0] / (np.sqrt(s[1]) + 1e-8)
            g = float(error.sum())
            bias_slot = [0.9 * bias_slot[0] + 0.1 * g, 0.999 * bias_slot[1] + 0.001 * g * g]
            model.bias -= step * fix * bias_slot[0] / (math.sqrt(bias_slot[1]) + 1e-8)
        step *= 0.93
    return model


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    text = F.coalesce(F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.lit(None)).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % modulus == remainder


def _inputs(df: DataFrame, id_col: str, text_col: str, n_chars_col: str | None) -> DataFrame:
    n_chars = F.col(n_chars_col).cast("long") if n_chars_col and n_chars_col in df.columns else F.lit(None).cast("long")
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), n_chars.alias("n_chars")
    )


_FEATURES = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int64())), ("stats", pa.list_(pa.float64()))])
_COLUMNS = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("columns", pa.binary()), ("stats", pa.list_(pa.float64()))])


def _features(with_stats: bool):
    """Terms, as signed 64-bit hashes, and statistics of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                if len(known) > 200_000:
                    known.clear()
                hashes, stats = [], []
                for text, n_chars in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    words = text.lower().split()
                    found: set[int] = set()
                    for w in set(words):
                        if w not in known:
                            known[w] = [_hash(t) for t in terms_of(w)]
                        found.update(known[w])
                    hashes.append(np.fromiter(found, dtype=np.uint64, count=len(found)).view(np.int64))
                    stats.append(statistics_of(text, words, n_chars) if with_stats else [])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(hashes, _FEATURES.field(2).type), pa.array(stats, _FEATURES.field(3).type)], schema=_FEATURES)

    return run


def _chosen_columns(terms: np.ndarray):
    """Rows of ``_features`` with the columns (places in ``terms``) of their terms as 16-bit numbers."""
    order = np.argsort(terms)
    known = terms[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.column(2):
                x = row.values.to_numpy()
                at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                found.append(np.sort(order[at[known[at] == x]] if len(known) else at[:0]).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), batch.column(3)], schema=_COLUMNS)

    return run


def _telling_terms(features: DataFrame, max_terms: int, least_rows: int, frequent: int) -> np.ndarray:
    """Terms to be learned: those in ``least_rows`` rows at least whose shares in the two classes differ
    most for their counts, and, as a term may tell something only beside another, the ``frequent`` most
    frequent of the others. They are counted in Spark; ``max_terms`` at most come to the driver."""
    n, n_pos = features.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = n_pos / max(n, 1)
    counts = features.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("rows"), F.sum("label").alias("pos"))
    z = (F.col("pos") - F.col("rows") * share) / F.sqrt(F.greatest(F.col("rows") * (share * (1 - share)), F.lit(1e-9)))
    counts = counts.where(F.col("rows") >= least_rows).select("term", "rows", F.abs(z).alias("z"))
    strong = counts.where("z >= 4").orderBy(F.desc("z"), "term").limit(max_terms - frequent)
    others = counts.where("z < 4").orderBy(F.desc("rows"), "term").limit(frequent)
    found = strong.unionByName(others).select("term").toArrow().column(0).to_numpy()
    return np.sort(found)


def fit_on_labels(
    df: DataFrame, labels: DataFrame, label_col: str, modulus: int, remainder: int, max_rows: int = 8000, with_stats: bool = True,
    id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", max_terms: int = 8192, least_rows: int = 5,
    frequent: int = 256, **options,
) -> Model:
    """Fit on at most ``max_rows`` labelled rows that aren't held out: those whose ids have the least hashes.

    Terms of the sample are made and counted in Spark. The driver gets ``max_terms`` terms (65536 at most)
    and, of each row, the columns of those alone. Rows without a label or id are not learned from, and labels
    whose id has no row are not counted or chosen, however many there are; of several labels of one id the
    largest counts, of several texts the one with the least hash. With no labelled rows every score is 0.5.
    """
    if max_terms > 1 << 16:
        raise ValueError("columns are 16-bit numbers: max_terms must be 65536 at most")
    usable = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id", modulus, remainder))
    usable = materialise(usable.groupBy("doc_id").agg(F.max("label").alias("label")), "usable-labels")
    # only what has a row; the ids of all rows are shuffled only where labels are too many to be broadcast
    ids = df.select(F.col(id_col).cast("long").alias("doc_id"))
    met = materialise(ids.join(if_small(usable), "doc_id").distinct(), "labelled-rows")
    n = met.count()
    # a few more than wanted by a bound on the hash, of these the least
    share = min(1.0, (max_rows + 10 * max_rows**0.5) / n) if n else 1.0
    few = met.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = few.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(max_rows)
    # at most max_rows rows of two numbers
    sample = _inputs(df, id_col, text_col, n_chars_col).join(F.broadcast(chosen), "doc_id").repartition(tasks(df.sparkSession), "doc_id")
    one = sample.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "n_chars")).alias("d"))
    rows = one.select("doc_id", "label", "d.text", "d.n_chars")
    features = materialise(rows.mapInArrow(tidy(_features(with_stats)), "doc_id long, label int, terms array<long>, stats array<double>"), "sample-terms")
    terms = _telling_terms(features, max_terms, least_rows, frequent)
    found = features.mapInArrow(_chosen_columns(terms), "doc_id long, label int, columns binary, stats array<double>").orderBy("doc_id").toArrow()
    lists = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in found.column("columns")]
    stats = np.array(found.column("stats").to_pylist(), dtype=float).reshape(len(lists), STATISTICS) if with_stats else None
    columns = {h: k for k, h in enumerate(terms.view(np.uint64).tolist())}
    return fit(columns, lists, stats, np.array(found.column("label").to_pylist(), dtype=float), **options)


def score(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars"
) -> DataFrame:
    """(doc_id, score) for every row; a null text is empty and is scored like an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        terms, with_stats = model.terms, len(model.mean) > 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                lists, stats = [], []
                for text, n_chars in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    lists.append(sorted(_columns_of(text, terms, known)))
                    if with_stats:
                        stats.append(statistics_of(text, text.lower().split(), n_chars))
                raw = model.raw(*_entries(lists, np.array(stats) if with_stats else None, model), len(lists))
                scores = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores, pa.float64())], schema=schema)

    return _inputs(df, id_col, text_col, n_chars_col).mapInArrow(tidy(run), "doc_id long, score double")


def classify(df: DataFrame, model: Model, modulus: int, remainder: int, threshold: float = 0.7, **columns) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold)."""
    return score(df, model, **columns).select(
        "doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def below(df: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is below ``threshold``, with all their columns; nothing is shuffled.

    Only for models without statistics, which need the text alone.
    """
    if len(model.mean):
        raise ValueError("this model needs statistics and metadata")
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                lists = [sorted(_columns_of(t or "", model.terms, known)) for t in some.column(at).to_pylist()]
                raw = model.raw(*_entries(lists, None, model), len(lists))
                yield some.filter(pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))) < threshold))

    return df.mapInArrow(tidy(run), df.schema)


def _columns_of(text: str, terms: dict[int, int], known: dict[str, tuple[int, ...]]) -> set[int]:
    """The model's columns of the terms of a text."""
    if len(known) > 200_000:
        known.clear()
    found: set[int] = set()
    for w in set(text.lower().split()):
        hit = known.get(w)
        if hit is None:
            hit = known[w] = tuple(terms[h] for h in map(_hash, terms_of(w)) if h in terms)
        if hit:
            found.update(hit)
    return found
