"""One registered query per operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaint.llm import (bitslice, bpe, decontaminate, html, language, minhash, negatives, ngram, pii, simhash, toxicity,
                        trie, urls)
from plaint.llm.common import LOWER, UPPER, remainder, table

#: Searches ask for rows whose id is divisible by this, against all rows.
SEARCH_EVERY = 50

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return add


@query("op1_pii")
def op1(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op3_minhash_dedup", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c JOIN s p ON p.doc_id = u JOIN s q ON q.doc_id = v WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)),
r AS (SELECT doc_id, doc_id AS m FROM s UNION SELECT e.v, r.m FROM r JOIN e ON e.u = r.doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.m) AS component_id, s.doc_id = min(r.m) AS kept
FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s""")
def op3(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query("op4_decontamination", f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
    lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT n FROM p),
o AS (
  SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'i': i, 'g': array_to_string(w[i:i + n - 1], ' ')}})) AS x
  FROM d, k WHERE len(w) >= n),
h AS (SELECT o.doc_id, o.n, o.x.i AS i, p.item_id FROM o JOIN p ON p.n = o.n AND p.g = o.x.g),
m AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(m.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op4(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    return ngram.lm_scores(table(spark, sf_dir, "documents"))


def tokenizer() -> tuple[str, str]:
    """The rank file and split pattern of the public tokenizer."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), *tokenizer())


@query("op7_url_filter")
def op7(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op8_simhash")
def op8(spark, sf_dir):
    marks = simhash.edit_likeness(table(spark, sf_dir, "documents"))
    return simhash.with_neighbours(marks, F.col("doc_id") % SEARCH_EVERY == 0)


@query("op9_html_text")
def op9(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


@query("op10_toxicity")
def op10(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Rows of embeddings that take part, with their components as whole numbers.
WHOLE = """SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query("op11_bitslice_topk", f"""
WITH e AS ({WHOLE.format(label="0", scale=1024)}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op11(spark, sf_dir):
    return bitslice.top_k(table(spark, sf_dir, "embeddings"))


#: crc32 of the bytes of a text, as in zlib: each byte is folded in, then eight shifts.
CRC32 = """xor(list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)),
    CAST(4294967295 AS BIGINT)), 4294967295)"""


@query("op12_prefix_trie", f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, md5(concat(length(r), ':', r, x))) AS s,
    {CRC32.format(text="CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t GROUP BY conv_id),
c AS (SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s
  FROM s a LEFT JOIN s b ON b.conv_id = a.conv_id - a.conv_id % 5),
m AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM c),
n AS (SELECT s[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(coalesce(strlen(s[d].x), 0)) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM m GROUP BY 1, 2),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT n.p, n.d, n.saved, k.n IS NULL AS leaf FROM n LEFT JOIN k ON k.p = n.p AND k.d = n.d),
u AS (SELECT p[1:e] AS p, e AS d, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM f) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, u.n_leaves,
  CAST(u.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN u ON u.p = n.p AND u.d = n.d LEFT JOIN k ON k.p = n.p AND k.d = n.d
  LEFT JOIN n o ON n.d > 0 AND o.d = n.d - 1 AND o.p = n.p[1:n.d - 1]""")
def op12(spark, sf_dir):
    convs = trie.conversations(table(spark, sf_dir, "conversations"))
    return trie.trie(trie.rebuilt(convs, F.col("conv_id") - F.col("conv_id") % 5, remainder("conv_id", 9)))


@query("op13_hard_negatives", f"""
WITH e AS (SELECT * FROM ({WHOLE.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", scale=256)}) WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved))
