"""The registered queries of the training-data operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm import (bpe, html, licenses, lines, mixing, neardup, pii, quality, repair, search, sharding, suffixes,
                           trie)

RANKS = "byte_bpe_multi_50k.tiktoken"

# op5: a line goes that more distinct texts of a source have, and a document of which less is left.
SHARED_TEXTS, LEAST_LEFT = 20, 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), mixing.word_count(F.col("text")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(_table(spark, sf_dir, "documents"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                                public_tokenizers.PATTERN)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), fraction=0.0, at_least=SHARED_TEXTS, least_left=LEAST_LEFT)
    return judged.select("doc_id", *quality.FIGURES, "base_failed", "kept", "n_removed_lines", "n_removed_words")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(pii.BASE_KINDS), 256).alias("base_sha256"), pii.joined(tuple(pii.PATTERNS)).alias("spans"),
        pii.joined(tuple(pii.PATTERNS), scored=True).alias("scores"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(_table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mixing, op2_line_dedup, op3_minhash_neardup, op4_byte_bpe, op5_quality_rules, op6_suffix_dedup,
    op7_sharding, op8_pii, op9_topk_search, op10_html_extraction, op11_prefix_trie, op12_license_scan,
    op13_structure_repair)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

# DuckDB has no crc32: the table of its 256 steps (s), and the sum over a decimal number's digits.
_CRC_STEPS = """
SELECT list(v ORDER BY i) AS s FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) AS b(i))"""


def _crc32(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), "
            "lambda c, b: xor(c >> 8, s[1 + (xor(c, b) & 255)])), 4294967295)")


def _listed(templates: tuple[licenses.Template, ...]) -> str:
    return ", ".join(f"({n}, '{t.label}', {str(t.exact).lower()}, '{t.text}')" for n, t in enumerate(templates))


ORACLE = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, 'null')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total
  FROM s),
f AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size, CASE WHEN level >= most / weight THEN most ELSE weight * (
           SELECT arg_min(level, most / weight) FROM f WHERE level < most / weight) END AS target
  FROM f),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size * size
         + least(size, greatest(0, budget % source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM p""",
    "op3_minhash_neardup": f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
g AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
b AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.r <> y.r GROUP BY ALL),
l AS (
  SELECT b.a, b.b FROM b JOIN n x ON x.r = b.a JOIN n y ON y.r = b.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b),
m AS (SELECT t.a AS r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.b GROUP BY t.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)""",
    "op5_quality_rules": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
f AS (
  SELECT r, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM d),
x AS (SELECT r, source, text AS whole, unnest(string_split(text, chr(10))) AS text FROM d),
y AS (
  SELECT r, source, whole, text AS line, len(v)::BIGINT AS words, array_to_string(v, ' ') AS norm
  FROM (SELECT *, regexp_extract_all({_LOWER}, {_WORD}) AS v FROM x) WHERE len(v) > 0),
u AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM y GROUP BY r),
q AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n
  FROM (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k
        FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8))),
p AS (
  SELECT r, count(DISTINCT i + o)::BIGINT AS n_repeat_words
  FROM (SELECT r, i, unnest(range(0, 8)) AS o FROM q WHERE n > 1) GROUP BY r),
o AS (SELECT source, norm FROM y GROUP BY source, norm HAVING count(DISTINCT whole) > {SHARED_TEXTS}),
z AS (
  SELECT r, count(DISTINCT y.norm)::INTEGER AS n_lines, sum(words)::BIGINT AS n_gone
  FROM y JOIN o ON o.norm = y.norm AND o.source IS NOT DISTINCT FROM y.source GROUP BY r),
j AS (
  SELECT d.r, d.doc_id, f.n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_removed_lines,
         coalesce(n_gone, 0) AS n_removed_words
  FROM d JOIN f USING (r) LEFT JOIN u USING (r) LEFT JOIN p USING (r) LEFT JOIN z USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
       NOT failed AND n_words - n_removed_words >= {LEAST_LEFT}::DOUBLE * n_words AS kept, n_removed_lines, n_removed_words
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed FROM j)""",
    "op9_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x::DOUBLE) > 1.7976931348623157e308 / 64)) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_prefix_trie": f"""
WITH RECURSIVE crc AS ({_CRC_STEPS}),
o AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
           PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS root, {_crc32("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc),
t AS (
  SELECT c.conv_id, 0 AS own, o.pos, r, x FROM c JOIN o ON o.conv_id = c.root AND o.pos < c.h
  UNION ALL SELECT conv_id, 1, pos, r, x FROM c JOIN o USING (conv_id) WHERE pos >= h),
u AS (
  SELECT conv_id, row_number() OVER w AS depth, length(x)::BIGINT AS chars,
         string_agg(md5(length(r) || ':' || r || ':' || x), '') OVER w AS path
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)),
p AS (
  SELECT conv_id, depth, chars, path, left(path, 32 * (depth - 1)::INTEGER) AS up,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM u
  UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM u) FROM c),
n AS (
  SELECT path, depth, up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM p GROUP BY path, depth, up),
k AS (SELECT up AS path, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT path, path AS top FROM n UNION ALL SELECT a.path, n.up FROM a JOIN n ON n.path = a.top WHERE n.up IS NOT NULL),
s AS (
  SELECT a.top AS path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM a JOIN n USING (path) LEFT JOIN k USING (path) GROUP BY a.top)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, n.ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN n m ON m.path = n.up""",
    "op12_license_scan": rf"""
WITH t AS (
  SELECT t, label, exact, string_split(text, ' ') AS w FROM (VALUES {_listed(licenses.BASE + licenses.NOTICES)}) AS v(t, label, exact, text)),
tg AS (
  SELECT t, label, exact, len(w) - 2 AS grams, p - 1 AS p, array_to_string(w[p:p + 2], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM t)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (
  SELECT r, i - 1 AS i, array_to_string(w[i:i + 2], ' ') AS gram
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
v AS (SELECT r, t, label, exact, grams, i - p AS start, list(DISTINCT p) AS found FROM g JOIN tg USING (gram) GROUP BY ALL),
m AS (
  SELECT r, label, exact, start, (CASE WHEN exact THEN len(found) ELSE len(list_distinct(flatten(list(found) OVER (
           PARTITION BY r, t ORDER BY start RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)))) END)::DOUBLE / grams AS coverage FROM v),
f AS (
  SELECT r, count(*) FILTER (exact AND coverage = 1) AS n_base, min(start) FILTER (exact AND coverage = 1) AS first_word,
         max(start) FILTER (exact AND coverage = 1) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND coverage = 1) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (CASE WHEN exact THEN coverage = 1 ELSE coverage >= 0.8::DOUBLE END) AS labels,
         max(coverage) AS score
  FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN f USING (r)""",
}
