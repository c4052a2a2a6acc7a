"""Language models: n-gram counts, probabilities and back-off, and word lattices from grammars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.scalar import log10_or_minus_infinity
from seqloom.sources.storage import cut_lineage


def tokens(text: Column, pattern: str = r"[ \t\n\x0b\x0c\r]+") -> Column:
    return F.array_remove(F.split(F.lower(text), pattern), "")


def ngram_counts(df: DataFrame, n: int, token_col: str = "tokens") -> DataFrame:
    """(history, next, count): n-grams of each row's token array; the history has n - 1 tokens.

    Grams are made inside each row, from the array beside itself moved by one, and counted before they
    are shuffled.
    """
    t = F.col(token_col)
    m = F.greatest(F.size(t) - (n - 1), F.lit(0))
    names = [f"t{i}" for i in range(n)]
    # single tokens need no array made of the array
    grams = df.select(F.inline(F.arrays_zip(*[F.slice(t, i + 1, m) for i in range(n)])).alias(*names) if n > 1 else F.explode(t).alias(*names))
    history = F.concat_ws(" ", *names[:-1]) if n > 1 else F.lit("")
    return grams.select(history.alias("history"), F.col(names[-1]).alias("next")).groupBy("history", "next").agg(F.count(F.lit(1)).alias("count"))


def ngram_probabilities(counts: DataFrame, use_log: bool = False) -> DataFrame:
    """Relative frequencies of the next token after each history."""
    totals = counts.groupBy("history").agg(F.sum("count").alias("total"))
    p = F.col("count") / F.col("total")
    return counts.join(totals, "history").select("history", "next", (F.log10(p) if use_log else p).alias("p"))


def discounted_probabilities(counts: DataFrame, cutoff: int = 7) -> DataFrame:
    """Frequencies with the Good-Turing discount for counts up to ``cutoff``: history, next, p, backoff.

    ``backoff`` is the share of the history that is left for tokens not seen after it. Where counts of
    counts are missing or don't fall, a count stays as it is.
    """
    counts = cut_lineage(counts, "ngrams")  # read three times, while the texts are read once
    of_counts = counts.where(F.col("count") <= cutoff + 1).groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    by = {r["count"]: r["n"] for r in of_counts.toLocalIterator()}  # at most cutoff + 1 rows
    common = (cutoff + 1) * by.get(cutoff + 1, 0) / by[1] if by.get(1) else 1.0
    rate = F.lit(1.0)
    for r in range(1, cutoff + 1):
        if by.get(r) and by.get(r + 1) and common != 1.0:
            d = ((r + 1) * by[r + 1] / by[r] / r - common) / (1 - common)
            if 0 < d < 1:
                rate = F.when(F.col("count") == r, F.lit(d)).otherwise(rate)
    totals = counts.groupBy("history").agg(F.sum("count").alias("total"), F.sum(F.col("count") * rate).alias("kept"))
    return counts.join(totals, "history").select(
        "history", "next", (F.col("count") * rate / F.col("total")).alias("p"), (1 - F.col("kept") / F.col("total")).alias("backoff")
    )


def backoff_model(df: DataFrame, n: int, token_col: str = "tokens", cutoff: int = 7) -> DataFrame:
    """A back-off model of orders 1 to ``n``: order, history, next, p, weight.

    p is the discounted frequency of ``discounted_probabilities`` (of order 1 the plain one). ``weight``
    is what the model of the next lower order is multiplied by for tokens not seen after history + next,
    so that all of them sum to 1; it is null for the highest order and 1 for a gram that is no history.
    """
    counts = [ngram_counts(df, k, token_col) for k in range(1, n + 1)]
    orders = [cut_lineage(ngram_probabilities(counts[0]).select("history", "next", "p"), "backoff")]
    out = None
    for k in range(2, n + 1):
        found = cut_lineage(discounted_probabilities(counts[k - 1], cutoff), "backoff")
        # what the lower order gives to the tokens seen after a history, which lacks its first token there
        shorter = F.expr("array_join(slice(split(history, ' '), 2, size(split(history, ' '))), ' ')") if k > 2 else F.lit("")
        lower = orders[-1].select(F.col("history").alias("__h"), F.col("next").alias("__n"), F.col("p").alias("__p"))
        met = found.withColumn("__s", shorter).join(lower, (F.col("__s") == F.col("__h")) & (F.col("next") == F.col("__n")))
        weights = met.groupBy("history").agg(F.sum("__p").alias("seen"), F.max("backoff").alias("left"))
        left = 1 - F.col("seen")
        weights = weights.select(F.col("history").alias("__gram"), F.when(left > 1e-12, F.greatest(F.col("left"), F.lit(0.0)) / left).otherwise(0.0).alias("weight"))
        gram = F.concat_ws(" ", *(["history"] if k > 2 else []), "next")
        below = orders[-1].withColumn("__g", gram).join(weights, F.col("__g") == F.col("__gram"), "left")
        part = below.select(F.lit(k - 1).alias("order"), "history", "next", "p", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        out = part if out is None else out.unionByName(part)
        orders.append(found.select("history", "next", "p"))
    last = orders[-1].select(F.lit(n).alias("order"), "history", "next", "p", F.lit(None).cast("double").alias("weight"))
    return last if out is None else out.unionByName(last)


def _without_first(order: int) -> Column:
    """The history of an n-gram of ``order`` without its first token."""
    return F.expr("array_join(slice(split(history, ' '), 2, size(split(history, ' '))), ' ')") if order > 2 else F.lit("")


def modified_discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What is taken from counts of 1, 2 and more, by the numbers of n-grams that are counted 1 to 4 times. Where
    these are missing or give no discount between 0 and the count, it is n1 / (n1 + 2 n2), or a half."""
    rows = counts.where(F.col("count") <= 4).groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect()  # 4 rows at most
    n = {r["count"]: r["n"] for r in rows}
    plain = n[1] / (n[1] + 2 * n[2]) if n.get(1) and n.get(2) else 0.5
    found = [k - (k + 1) * plain * n[k + 1] / n[k] if n.get(k) and n.get(k + 1) else plain for k in (1, 2, 3)]
    return tuple(d if 0 < d < k else plain for k, d in enumerate(found, 1))


def interpolated_model(df: DataFrame, n: int, token_col: str = "tokens") -> DataFrame:
    """An interpolated model with modified discounts of orders 1 to ``n``: order, history, next, p, weight.

    The highest order has its counts; an n-gram of a lower one counts once for each token that stands
    before it, so that a frequent word of one context isn't taken to be likely in all. p is the discounted
    share plus the history's ``weight`` times the probability of the next lower order, and of order 1 plus
    a share of all tokens alike. For a token not seen after a history it is that weight times the lower
    probability; so p sums to 1 over all tokens for every history. ``weight`` is that of history + next as a
    history; it is null for the highest order and 1 for a gram that is no history.
    """
    raw = {k: cut_lineage(ngram_counts(df, k, token_col), "ngrams") for k in range(1, n + 1)}
    vocabulary = raw[1].select("next")
    size = vocabulary.count()
    out, lower = None, None
    for k in range(1, n + 1):
        counts = raw[k]
        if k < n:
            counts = raw[k + 1].select(_without_first(k + 1).alias("history"), "next").groupBy("history", "next").agg(F.count(F.lit(1)).alias("count"))
            counts = cut_lineage(counts, "continuations")
        one, two, more = modified_discounts(counts)
        c = F.col("count")
        taken = F.when(c == 1, one).when(c == 2, two).otherwise(more)
        totals = counts.groupBy("history").agg(F.sum("count").alias("total"), F.sum(taken).alias("taken"))
        totals = cut_lineage(totals.select("history", "total", (F.col("taken") / F.col("total")).alias("gamma")), "histories")
        shares = counts.join(totals, "history").select("history", "next", ((c - taken) / F.col("total")).alias("share"), "gamma")
        if k == 1:
            of_all = totals.select("gamma").first()
            gamma = of_all[0] if of_all else 1.0
            p = F.coalesce("share", F.lit(0.0)) + F.lit(gamma) / F.lit(max(1, size))
            found = vocabulary.join(shares.select("next", "share"), "next", "left").select(F.lit("").alias("history"), "next", p.alias("p"))
        else:
            below = lower.select(F.col("history").alias("__h"), F.col("next").alias("__n"), F.col("p").alias("__p"))
            met = shares.withColumn("__s", _without_first(k)).join(below, (F.col("__s") == F.col("__h")) & (F.col("next") == F.col("__n")))
            found = met.select("history", "next", (F.col("share") + F.col("gamma") * F.col("__p")).alias("p"))
            gram = F.concat_ws(" ", *(["history"] if k > 2 else []), "next")
            weights = totals.select(F.col("history").alias("__gram"), "gamma")
            part = lower.withColumn("__g", gram).join(weights, F.col("__g") == F.col("__gram"), "left")
            part = part.select(F.lit(k - 1).alias("order"), "history", "next", "p", F.coalesce("gamma", F.lit(1.0)).alias("weight"))
            out = part if out is None else out.unionByName(part)
        lower = cut_lineage(found, "interpolated") if k < n else found  # the highest order is read once
    last = lower.select(F.lit(n).alias("order"), "history", "next", "p", F.lit(None).cast("double").alias("weight"))
    return last if out is None else out.unionByName(last)


def arpa_ngrams(lines: DataFrame, use_log: bool = True, space_token: str = "_space_") -> DataFrame:
    """n-grams of an ARPA file (line_no, value): n, history, next, p.

    Back-off weights are left out, as are the marks of sentence ends; the token for a space becomes ' '.
    The section of a line is that of the last heading before it. Headings, one for each order, are read first;
    the lines of a file then stay where they are, in as many tasks as it takes.
    """
    heading = F.regexp_extract("value", r"^\\(\d+)-grams:", 1)
    heads = lines.select("line_no", heading.alias("n")).where("n <> ''").orderBy("line_no").limit(1001).collect()
    if len(heads) > 1000:
        raise ValueError("a file of n-grams has more than 1000 headings")
    section = F.lit(None).cast("int")
    for at, n in heads:
        section = F.when(F.col("line_no") >= at, F.lit(int(n))).otherwise(section)
    rows = lines.withColumn("n", section).withColumn("f", F.split(F.trim("value"), r"\s+"))
    rows = rows.where("n IS NOT NULL AND value NOT LIKE '\\\\\\\\%' AND size(f) > n")
    words = F.transform(F.slice("f", F.lit(2), F.col("n")), lambda w: F.when(w == space_token, " ").otherwise(w))
    rows = rows.withColumn("w", words).where("NOT exists(w, x -> x IN ('<s>', '</s>'))")
    p = F.col("f")[0].cast("double")
    return rows.select(
        "n", F.array_join(F.slice("w", F.lit(1), F.col("n") - 1), "").alias("history"), F.element_at("w", F.col("n")).alias("next"),
        (p if use_log else F.pow(F.lit(10.0), p)).alias("p"),
    )


def lattice(text_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, symbol) and edges (src, dst) of a lattice in text form (one column ``value``)."""
    field = lambda name: F.regexp_extract("value", rf"(?:^|\s){name}=(\S+)", 1)
    nodes = text_lines.where(F.col("value").rlike(r"^I=")).select(field("I").try_cast("int").alias("id"), field("W").alias("symbol"))
    edges = text_lines.where(F.col("value").rlike(r"^J=")).select(field("S").try_cast("int").alias("src"), field("E").try_cast("int").alias("dst"))
    return nodes, edges


def without_nulls(nodes: DataFrame, edges: DataFrame, null: str = "!NULL") -> DataFrame:
    """Edges between words only: paths through null nodes become one edge. The first and last nodes,
    which are null too, stay as ends.

    A lattice is as small as its grammar; chains of null nodes of any length are followed.
    """
    ends = nodes.agg(F.max("id").alias("start"), (F.max("id") - 1).alias("end"))
    kind = nodes.crossJoin(F.broadcast(ends)).select("id", ((F.col("symbol") == null) & (F.col("id") != F.col("start")) & (F.col("id") != F.col("end"))).alias("inner"))
    target = kind.select(F.col("id").alias("dst"), F.col("inner").alias("through"))
    source = kind.select(F.col("id").alias("src"), F.col("inner").alias("from_null"))
    marked = edges.join(target, "dst").join(source, "src")
    # null nodes that null nodes lead to, by squaring: as many rounds as the logarithm of the longest chain
    chain = cut_lineage(marked.where("from_null AND through").select("src", "dst").distinct(), "lattice")
    n = -1
    while (m := chain.count()) > n:
        n = m
        longer = chain.join(chain.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        chain = cut_lineage(chain.unionByName(longer).distinct(), "lattice")
    into = marked.where("NOT from_null AND through").select("src", F.col("dst").alias("via"))
    along = into.unionByName(into.join(chain.select(F.col("src").alias("via"), F.col("dst").alias("far")), "via").select("src", F.col("far").alias("via")))
    out = marked.where("from_null AND NOT through").select(F.col("src").alias("via"), "dst")
    direct = marked.where("NOT from_null AND NOT through").select("src", "dst")
    return direct.unionByName(along.join(out, "via").select("src", "dst")).distinct()


_TOKEN = re.compile(r"\s*(\$?[\w'.!-]+|[=|;()\[\]{}<>])")


def grammar_lattice(spark: SparkSession, grammar: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the word network of a grammar such as ``$w = a | b; ( < $w > )``.

    | are alternatives, [ ] optional, { } zero or more, < > one or more times. The last node is the
    start and the one before it the end, both null.
    """
    words = _TOKEN.findall(grammar)
    rules: dict[str, list[str]] = {}
    while len(words) > 2 and words[0].startswith("$") and words[1] == "=":
        stop = words.index(";")
        rules[words[0]], words = words[2:stop], words[stop + 1 :]
    symbols: list[str] = []
    links: set[tuple[int, int]] = set()

    def node(symbol: str) -> int:
        symbols.append(symbol)
        return len(symbols) - 1

    def join(a: int, b: int) -> None:
        links.add((a, b))

    def choice(at: list[str]) -> tuple[int, int]:
        """The network of alternatives at the front of ``at``, which is used up to a closing mark."""
        first, last = node("!NULL"), node("!NULL")
        while True:
            here = first
            while at and at[0] not in "|)]}>":
                a, b = factor(at)
                join(here, a)
                here = b
            join(here, last)
            if not at or at[0] != "|":
                return first, last
            at.pop(0)

    def factor(at: list[str]) -> tuple[int, int]:
        word = at.pop(0)
        if word in "([{<":
            a, b = choice(at)
            if not at or at.pop(0) != dict(zip("([{<", ")]}>", strict=True))[word]:
                raise ValueError(f"the grammar lacks the end of {word!r}")
            first, last = node("!NULL"), node("!NULL")
            join(first, a)
            join(b, last)
            if word in "{<":
                join(b, a)
            if word in "[{":
                join(first, last)
            return first, last
        if word.startswith("$"):
            if word not in rules:
                raise ValueError(f"the grammar doesn't define {word}")
            return choice([*rules[word]])
        n = node(word)
        return n, n

    first, last = choice(words)
    end, start = node("!NULL"), node("!NULL")
    join(start, first)
    join(last, end)
    nodes = spark.createDataFrame(list(enumerate(symbols)), "id int, symbol string")
    return nodes, spark.createDataFrame(sorted(links), "src int, dst int")


def word_loop(spark: SparkSession, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """The lattice in which any of the words follows any other."""
    return grammar_lattice(spark, f"$word = {' | '.join(words)} ; ( < $word > )")


def log10_table(p: DataFrame, column: str = "p") -> DataFrame:
    """The table with log10 of its probabilities; -inf for 0."""
    return p.withColumn(column, log10_or_minus_infinity(column))
