"""Queries over the given tables that apply each operator with production parameters, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlake.llm.align import token_alignment
from contentlake.llm.chat import conversation_digests, format_turns, worst_case
from contentlake.llm.decontaminate import decontaminate
from contentlake.llm.hard_negatives import hard_negatives
from contentlake.llm.language import language
from contentlake.llm.line_dedup import line_dedup
from contentlake.llm.mixing import mix
from contentlake.llm.ngram_join import ngram_join
from contentlake.llm.quality import quality
from contentlake.llm.sharding import shard
from contentlake.llm.substring_dedup import substring_dedup
from contentlake.llm.suffix_dedup import suffix_dedup
from contentlake.llm.toxicity import toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(table(spark, folder, "documents")).drop("print")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup(table(spark, folder, "documents"), length=400, keep_first=False)
    return out.withColumnRenamed("n", "n_bytes").drop("spans")


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard(table(spark, folder, "documents"), shards=16).drop("hash")


def op5_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents")).drop("kept_text")


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = format_turns(worst_case(table(spark, folder, "conversations")))
    return conversation_digests(turns).drop("n_tokens", "n_loss_tokens")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), weights=(5, 2, 1), most=3).drop("epochs", "key", "source")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup(table(spark, folder, "documents"), length=20)
    return out.withColumnRenamed("n", "n_words").drop("n_spans", "spans")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    return language(table(spark, folder, "documents"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    return hard_negatives(
        table(spark, folder, "embeddings"),
        vec_id,
        F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label),
        F.col("embedding"),
        anchor=vec_id % 100 == 0,
    )


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_toxicity,
        op3_suffix_dedup,
        op4_sharding,
        op5_line_templates,
        op6_chat_formatting,
        op7_mixing,
        op8_substring_dedup,
        op9_quality,
        op10_decontamination,
        op11_language,
        op12_hard_negatives,
        op13_token_alignment,
    )
}

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {}

ORACLE["op1_ngram_jaccard"] = rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({LOWER}, ''), '{SPACE}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
common AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (
  SELECT r AS a, r AS b FROM words
  UNION
  SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT reached.a AS r, min(doc_id) AS component_id FROM reached JOIN words ON words.r = reached.b GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM words JOIN least USING (r) LEFT JOIN sizes USING (r)
"""

ORACLE["op7_mixing"] = rf"""
WITH keyed AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACE}'))::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS key FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap
  FROM sizes),
levels AS (
  SELECT *, cap / weight AS reach,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM weighed),
aims AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT level FROM levels WHERE reach >= level
           ORDER BY reach, source NULLS LAST LIMIT 1)) AS target FROM levels),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM aims),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
           - size * count(*) OVER (PARTITION BY source, key) AS before,
         count(*) OVER (PARTITION BY source, key) AS copies FROM keyed)
SELECT doc_id, size, cut.source_size, target,
       (epochs * size + least(size, greatest(0, (floor(target)::BIGINT - epochs * cut.source_size - before) // copies)))::BIGINT AS taken
FROM placed JOIN cut ON placed.source IS NOT DISTINCT FROM cut.source
"""

ORACLE["op9_quality"] = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w FROM documents),
windows AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT r, count(DISTINCT i + d) AS n FROM twice, range(5) AS steps(d) GROUP BY r),
lines AS (
  SELECT r, source, line, array_to_string(regexp_extract_all({LOWER.replace('text', 'line')}, '{SPACE}'), ' ') AS norm,
         len(regexp_extract_all(line, '{SPACE}')) AS words
  FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM texts)),
full_lines AS (SELECT * FROM lines WHERE words > 0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY r),
hosts AS (SELECT source, count(*) AS n FROM texts GROUP BY source),
common AS (
  SELECT f.source, f.norm FROM full_lines f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
  GROUP BY f.source, f.norm, h.n HAVING count(DISTINCT f.r) > greatest(100, floor(h.n * 1 / 100))),
removed AS (
  SELECT r, sum(words) AS n FROM full_lines f JOIN common c ON f.norm = c.norm AND f.source IS NOT DISTINCT FROM c.source
  GROUP BY r),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.n, 0)::BIGINT AS n_line_words
  FROM texts LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r) LEFT JOIN removed USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND 100 * (n_words - n_line_words) >= 50 * n_words AS kept FROM counts
"""

NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE["op10_decontamination"] = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({LOWER}, ''), '{NORMAL}') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(coalesce({LOWER}, ''), '{NORMAL}') AS w FROM benchmark),
patterns AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM patterns),
windows AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM texts, sizes WHERE len(w) >= k)),
hits AS (SELECT r, i, w.k, item FROM windows w JOIN patterns p ON w.k = p.k AND w.s = p.s),
covered AS (
  SELECT r, count(DISTINCT i + d) AS n FROM (SELECT r, i, unnest(range(k)) AS d FROM hits) GROUP BY r),
met AS (
  SELECT r, count(item) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(met.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered USING (r) LEFT JOIN met USING (r)
"""

ORACLE["op8_substring_dedup"] = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w FROM documents),
windows AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 19], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM texts WHERE len(w) >= 20)),
later AS (
  SELECT r, i FROM (
    SELECT r, i, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, r, i) AS k FROM windows) WHERE k > 1),
gone AS (SELECT r, list(DISTINCT i + d) AS places FROM later, range(20) AS steps(d) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN places IS NULL THEN w
         ELSE [x[1] for x in list_zip(w, range(1, len(w) + 1)) if NOT list_contains(places, x[2])] END, ' ')) AS kept_sha256
FROM texts LEFT JOIN gone USING (r)
"""

ORACLE["op5_line_templates"] = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, k, line, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END
                      for x in regexp_extract_all(line, '{SPACE}')] AS w
  FROM (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM texts)),
full_lines AS (SELECT r, k, w, len(w) AS size, (len(w), w[:3]) AS leaf FROM lines WHERE len(w) > 0),
recurring AS (SELECT leaf FROM full_lines GROUP BY leaf HAVING count(DISTINCT r) >= 20),
counts AS (SELECT leaf, w, size, count(DISTINCT r) AS n FROM full_lines SEMI JOIN recurring USING (leaf) GROUP BY ALL),
own AS (SELECT leaf, w FROM counts WHERE n >= 20 AND 100 * len(list_filter(w, lambda x: x <> '<*>')) >= 50 * size),
long AS (SELECT leaf, w, size, n, len(list_filter(w[:3], lambda x: x <> '<*>')) AS lead FROM counts WHERE size > 6),
places AS (
  SELECT *, w[place] AS behind FROM (SELECT leaf, w, n, unnest(w) AS word, unnest(range(size)) AS place FROM long)
  WHERE place >= 3 AND word <> '<*>'),
votes AS (SELECT leaf, place, word, sum(n) AS votes FROM places GROUP BY ALL HAVING sum(n) >= 16),
pairs AS (SELECT leaf, place, word, behind, sum(n) AS votes FROM places GROUP BY ALL HAVING sum(n) >= 16),
tops AS (SELECT leaf, place, max((votes, word)) AS top FROM votes GROUP BY ALL),
nexts AS (SELECT leaf, place, behind, max((votes, word)) AS next FROM pairs GROUP BY ALL),
levels AS (
  SELECT DISTINCT leaf, CASE WHEN part = 0 THEN 16 ELSE greatest(16, total // part + 1) END AS least
  FROM (SELECT leaf, sum(n) AS total FROM long GROUP BY leaf), (VALUES (2), (8), (32), (0)) AS p(part)),
cells AS (
  SELECT leaf, w, least, place, coalesce(votes, 0) >= least AS mine,
         CASE WHEN coalesce(votes, 0) >= least THEN word WHEN next[1] >= least THEN next[2] ELSE top[2] END AS cell
  FROM places LEFT JOIN votes USING (leaf, place, word) JOIN tops USING (leaf, place)
  LEFT JOIN nexts USING (leaf, place, behind) JOIN levels USING (leaf) WHERE top[1] >= least),
kinds AS (
  SELECT leaf, w, least, string_agg(place || ':' || cell, ' ' ORDER BY place) AS template, count(*) AS fixed,
         count(CASE WHEN mine THEN 1 END) AS mine FROM cells GROUP BY ALL),
instances AS (
  SELECT DISTINCT leaf, w, template FROM kinds JOIN long USING (leaf, w)
  WHERE mine > 0 AND 100 * fixed >= 50 * (size - 3) AND 100 * (mine + lead) >= 80 * (fixed + lead)),
dropped AS (
  SELECT leaf, w FROM instances SEMI JOIN (
    SELECT leaf, template FROM full_lines JOIN instances USING (leaf, w) GROUP BY ALL HAVING count(DISTINCT r) >= 20) USING (leaf, template)
  UNION SELECT leaf, w FROM own),
left_over AS (
  SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS t
  FROM lines WHERE (len(w), w[:3], w) NOT IN (SELECT (leaf[1], leaf[2], w) FROM dropped) GROUP BY r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN left_over USING (r)
"""

ORACLE["op6_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS said(t, r)),
sizes AS (
  SELECT *, 20 + length(role) + length(text)
    + len(regexp_extract_all(role || chr(10) || text, '<\\*/?s>|\[\\*/?INST\]')) AS size FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM sizes GROUP BY conv_id
"""

ORACLE["op12_hard_negatives"] = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, b.r AS b,
         list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT a, anchor_id, id AS positive_id, score AS positive_score, b AS p FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, id NULLS LAST, b)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.a = p.a AND NOT s.same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.p ORDER BY score DESC, id NULLS LAST, b) <= 5
"""
