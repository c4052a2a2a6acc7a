"""The queries of this subpackage and their SQL, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import (
    bpe, chat, decontamination, exact_dedup, filter_audit, html_extraction, ngram_join, quality, suffixes, token_counts, token_files, toxicity, vector_codes,
)
from seqloom.llm.common import materialise, shared_folder, table


def tokenizer_path() -> str:
    """The public tokenizer that the queries take."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return token_files.summarise_token_files(spark, path)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "flat-tokens")
    end_id = 49407
    token_counts.write_flat_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id)
    flat = spark.read.schema(token_counts.FLAT).parquet(path)
    counts = token_counts.count_tokens(flat.where(F.col("kind") == "tokens"), end_id)
    names = flat.where(F.col("kind") == "names").select("file", "doc_no", "doc_id")
    return counts.join(names, ["file", "doc_no"], "left").select("doc_id", "n_tokens", "file", "doc_no", "start", "closed")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(materialise(chat.format_conversations(rows), "conversations"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


#: The marks that the pages of this corpus have: one article of h1 and p, of which nothing else is in it.
OP6_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', ' ', 'g') AS body FROM a),
c AS (
  SELECT page_id, url, list_filter(list_transform(string_split(body, chr(1)),
           lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls
  FROM (SELECT page_id, url, replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS body FROM b))
SELECT page_id, url, array_to_string(ls, chr(10)) AS text, length(array_to_string(ls, chr(10))) AS n_chars FROM c
"""

OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
           WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
rare AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS (SELECT e.* FROM e JOIN rare USING (g)),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p WHERE 100 * i >= 75 * (na + nb - i)),
both_ways AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
reach AS (
  SELECT doc_id AS u, doc_id AS v FROM documents
  UNION
  SELECT reach.u, both_ways.v FROM reach JOIN both_ways ON reach.v = both_ways.u)
SELECT s.doc_id, len(s.sh) AS n_shingles, c.component_id
FROM s JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON s.doc_id = c.u
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS mask
  FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v (letter, bit)),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM o, range(1, 6) AS r (step)),
x AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM s CROSS JOIN c GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x
"""


def _op12_sql() -> str:
    """Four rounds and the last assignment, one after another; whole numbers in doubles are exact here."""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, c[part * w + 1:part * w + w] AS a FROM (SELECT *, len(c) // 4 AS w FROM v), range(4) AS r (part)),
b0 AS MATERIALIZED (
  SELECT part, entry, a AS b FROM (SELECT part, a, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 256)"""
    ]
    for k in range(5):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(d := list_inner_product(a, a) - 2 * list_inner_product(a, b) + list_inner_product(b, b), e := entry)) AS best
  FROM p JOIN b{k} USING (part) GROUP BY vec_id, part)""")
        if k < 4:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT o.part, o.entry, coalesce(m.b, o.b) AS b
  FROM b{k} o LEFT JOIN (
    SELECT part, entry, list(floor(total / n) ORDER BY place) AS b
    FROM (SELECT part, entry, place, sum(x) AS total, count(*) AS n
          FROM (SELECT part, a{k}.best.e AS entry, unnest(a) AS x, generate_subscripts(a, 1) AS place FROM p JOIN a{k} USING (vec_id, part))
          GROUP BY part, entry, place)
    GROUP BY part, entry) m ON m.part = o.part AND m.entry = o.entry)""")
    return (
        "WITH "
        + ",\n".join(steps)
        + """,
h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256
      FROM (SELECT part, entry, unnest(b) AS x, generate_subscripts(b, 1) AS place FROM b4)),
c AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id)
SELECT v.vec_id, v.label, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM v JOIN c ON v.vec_id = c.vec_id CROSS JOIN h
"""
    )


OP13_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
  SELECT *, length(regexp_replace(text, '(<s>|</s>|\[/?(?:SYS|INST|ROLE)\]|\[TEXT\]|<\|(?:image|audio|document|file)\|>)', '\\\1', 'g'))
            + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
                        ELSE 24 + length(regexp_replace(role, '(<s>|</s>|\[/?(?:SYS|INST|ROLE)\]|\[TEXT\]|<\|(?:image|audio|document|file)\|>)', '\\\1', 'g')) END AS n
  FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attached_tokens
FROM e GROUP BY conv_id
"""


def queries() -> dict:
    return {
        "op1_token_files": op1_token_files,
        "op2_decontamination": op2_decontamination,
        "op3_token_counts": op3_token_counts,
        "op4_quality": op4_quality,
        "op5_bpe_round_trip": op5_bpe_round_trip,
        "op6_main_text": op6_main_text,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_repeated_passages": op8_repeated_passages,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_toxicity": op10_toxicity,
        "op11_filter_audit": op11_filter_audit,
        "op12_vector_codes": op12_vector_codes,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_main_text": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op9_ngram_jaccard": OP9_SQL,
            "op11_filter_audit": OP11_SQL, "op12_vector_codes": _op12_sql(), "op13_chat_format": OP13_SQL}
