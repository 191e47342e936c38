"""Queries of the text operators, each over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decafix.llm import chat, decontaminate, embeddings, html, language, licenses, mixing, quality, simhash, suffix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op3_quality(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"), learn=quality.crc_mod(F.col("id"), 5) != 0)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (quality.crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_language(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.fit(docs, learn=quality.crc_mod("doc_id", 4) != 2)
    out = language.predict(docs, model)
    return out.select("doc_id", (quality.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_chat(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


SQL["op2_chat"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + 10 + 9 + 4
    + length(text) - length(replace(text, chr(92), '')) + length(role) - length(replace(role, chr(92), ''))
    + len(regexp_extract_all(text, '</?s>|\\[/?INST\\]')) + len(regexp_extract_all(role, '</?s>|\\[/?INST\\]')) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op7_html(spark, sf):
    return html.extract(table(spark, sf, "pages"))


@query
def op6_decontaminate(spark, sf):
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


SQL["op6_decontaminate"] = r"""
WITH d AS (SELECT doc_id, len(w) AS size, generate_subscripts(w, 1) AS p, unnest(w) AS x FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)),
b AS (SELECT item_id, len(w) AS n, CASE WHEN len(w) >= 7 THEN least(11, len(w) - 1) ELSE len(w) END AS need, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
m AS (SELECT doc_id, item_id, need, p - i AS diagonal, i FROM d JOIN b USING (x) WHERE n >= 4 OR n = size),
f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS near, count(*) OVER (PARTITION BY doc_id, item_id, diagonal) AS matched
  FROM m QUALIFY matched >= need),
l AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, max(matched) AS matched FROM f WHERE near >= need GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(matched, 0) AS matched FROM documents LEFT JOIN l USING (doc_id)
"""


@query
def op10_licenses(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


def _license_sql() -> str:
    rows = ", ".join(f"({s}, '{label}', {sorted(t)!r}, {need})" for s, label, t, need in licenses._sets())
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in licenses.PHRASES.items())
    return rf"""
WITH t(s, label, words, need) AS (VALUES {rows}), p(phrase, label) AS (VALUES {phrases}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, label, k FROM (SELECT doc_id, w, label, string_split(phrase, ' ') AS q, unnest(range(len(w))) AS k FROM d, p WHERE list_has_all(w, string_split(phrase, ' '))) WHERE w[k + 1 : k + len(q)] = q),
b AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list_distinct(list(label)) AS base FROM places GROUP BY 1),
blocks AS (SELECT doc_id, s, list_distinct(w[k + 1 : k + 2 * s]) AS x FROM (SELECT doc_id, w, s, unnest(range(0, len(w), s)) AS k FROM d, (SELECT DISTINCT s FROM t))),
m AS (SELECT doc_id, list_distinct(list(label)) AS more, max(len(list_intersect(x, words)) / CAST(len(words) AS DOUBLE)) AS containment FROM blocks JOIN t USING (s) WHERE len(list_intersect(x, words)) >= need GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(containment, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


SQL["op10_licenses"] = _license_sql()


@query
def op9_embeddings(spark, sf):
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


SQL["op9_embeddings"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON vec_id = a JOIN c ON vec_id = node
"""


@query
def op4_mixing(spark, sf):
    return mixing.choose(table(spark, sf, "documents")).drop("key")


SQL["op4_mixing"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS t, CAST('0x' || substr(md5('b' || doc_id), 1, 8) AS BIGINT) % (SELECT greatest(128, count(*) // 65536) FROM documents) AS block FROM documents WHERE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 0),
s AS (SELECT source, sum(t)::BIGINT AS t, sum(t) / CAST(sum(sum(t)) OVER () AS DOUBLE) AS p, CAST(sum(sum(t)) OVER () AS BIGINT) AS budget, count(*) OVER () AS n FROM d GROUP BY source),
g AS (SELECT 0.0::DOUBLE AS a, 1.0::DOUBLE AS w, 0 AS i UNION ALL
  SELECT CASE WHEN ok THEN a ELSE a + w / 2 END, w / 2, i + 1 FROM (SELECT a, w, i, (SELECT ln(sum(pow(p, a + w / 2))) - (a + w / 2) * sum(pow(p, a + w / 2) * ln(p)) / sum(pow(p, a + w / 2)) <= 0.95 * ln(max(n))
    AND pow(min(p), a + w / 2 - 1) / sum(pow(p, a + w / 2)) <= 4.0 FROM s) AS ok FROM g WHERE i < 20)),
x AS (SELECT a + w AS x FROM g WHERE i = 20),
q AS (SELECT source, t, CAST(floor(round(pow(p, x) / sum(pow(p, x)) OVER (), 12) * budget) AS BIGINT) AS b FROM s, x),
f AS (SELECT source, b // t AS passes, b % t AS rest FROM q),
k AS (SELECT source, block, sum(t)::BIGINT AS t FROM d GROUP BY ALL),
e AS (SELECT source, block, epoch, t, passes, rest, row_number() OVER o AS block_rank, sum(t) OVER o AS stop FROM (SELECT source, block, t, passes, rest, unnest(range(passes + 1)) AS epoch FROM k JOIN f USING (source))
  WINDOW o AS (PARTITION BY source, epoch ORDER BY md5('42:' || source || ':' || epoch || ':' || block), block)),
m AS (SELECT d.doc_id, d.source, epoch, block_rank, d.t AS tokens, CASE WHEN epoch = passes AND stop > rest THEN rest - stop + e.t END AS remain FROM d JOIN e USING (source, block)),
z AS (SELECT *, sum(tokens) OVER (PARTITION BY source, epoch, remain IS NULL ORDER BY md5('42:' || doc_id || ':' || epoch)) AS stop FROM m WHERE remain IS NULL OR remain > 0)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, CAST(block_rank AS INTEGER) AS block_rank, tokens FROM z WHERE remain IS NULL OR stop <= remain
"""


@query
def op5_suffix(spark, sf):
    return suffix.digests(table(spark, sf, "documents"))
