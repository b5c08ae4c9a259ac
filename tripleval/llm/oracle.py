"""DuckDB twins of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from . import chat, mixing

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_CONTROL = "|".join("".join("\\" + ch if not ch.isalnum() else ch for ch in c) for c in chat.CONTROL)

CHAT = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w IS DISTINCT FROM role AS starts,
         len(regexp_extract_all(text, '{_CONTROL}')) AS marks, len(regexp_extract_all(role, '{_CONTROL}')) AS role_marks
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(length(text) + marks + CASE WHEN starts THEN length('[TURN]') + length(role) + role_marks + length('[TEXT]')
                + length('[/TURN]') + 3 ELSE length('[NEXT]') + 1 END) AS BIGINT) AS formatted_chars
FROM numbered GROUP BY conv_id"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
      FROM s)
SELECT * FROM r WHERE rank <= 5"""

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w)
  WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w)
  WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
l AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(links, 0) AS n_links
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""

PHRASES = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(list_slice(w, i, i + s - 1), ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS s) WHERE len(w) >= s),
f AS (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY lang, s, phrase HAVING count(*) >= 30),
b AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
i AS (SELECT x.lang, array_to_string(list_slice(w, k, k + m - 1), ' ') AS phrase, max(f) AS longer
      FROM b x, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS k) WHERE m < s AND k + m - 1 <= s GROUP BY ALL),
c AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE s > 1 AND (longer IS NULL OR 100 * longer < 80 * f)),
x AS (
  SELECT c.lang, c.phrase, c.f AS a, k, y.f AS l, z.f AS r, CAST(CAST(c.f AS HUGEINT) * 2000000 // (y.f + z.f) AS BIGINT) AS score
  FROM c, (SELECT unnest([1, 2, 3]) AS k), f y, f z
  WHERE k < c.s AND y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, 1, k), ' ')
    AND z.lang = c.lang AND z.phrase = array_to_string(list_slice(w, k + 1, c.s), ' ')),
o AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN t USING (lang) QUALIFY rank <= 2000"""

LINES = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i, list_slice(l, i, i + 2) AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM l)),
k AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM w
  WHERE len(list_filter(w, lambda x: trim(x, ' ') <> '')) > 0),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM k WHERE k > 1),
one AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS kept, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS n_lines, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM l JOIN documents USING (doc_id) LEFT JOIN kept USING (doc_id)"""

REPEATS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, i, list_slice(w, i, i + 19) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k WHERE k > 1),
one AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
         md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         CAST(ceil((sum(size) + {mixing.ROW_WORDS} * count(*)) / {mixing.SHARD_WORDS}::DOUBLE) AS BIGINT) AS shards
  FROM d GROUP BY source),
l AS (
  SELECT *, source_size * 2 / weight AS most,
         ({mixing.SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(source_size * 2) OVER o, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0)) AS level
  FROM s WINDOW o AS (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(source_size * 2.0::DOUBLE, (SELECT max(level) FROM l WHERE level <= most) * weight) AS target FROM l),
q AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, target DESC, source NULLS LAST) AS rank
      FROM (SELECT source, target, unnest(range(1, CAST(target / {mixing.BLOCK} AS BIGINT) + 200)) AS k FROM t)),
b AS (SELECT source, count(*) AS blocks FROM q WHERE rank <= (SELECT round(sum(target) / {mixing.BLOCK}) FROM t) GROUP BY source),
p AS (
  SELECT d.*, source_size, target, coalesce(blocks, 0) AS blocks, CAST('0x' || substr(h, 1, 8) AS BIGINT) % shards AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
c AS (SELECT source, shard, any_value(blocks) AS blocks, sum(size) AS shard_size FROM p GROUP BY source, shard),
cq AS (
  SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * k - 1) DESC, shard_size DESC, shard) AS rank
  FROM (SELECT *, unnest(range(1, CAST(blocks AS BIGINT) + 1)) AS k FROM c) WHERE shard_size > 0),
cs AS (SELECT source, shard, count(*) AS seats FROM cq WHERE rank <= blocks GROUP BY source, shard),
x AS (
  SELECT p.*, shard_size, least(coalesce(seats, 0) * {mixing.BLOCK}, shard_size * 2) AS words,
         coalesce(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source AND p.shard = c.shard
  LEFT JOIN cs ON p.source IS NOT DISTINCT FROM cs.source AND p.shard = cs.shard)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN shard_size > 0 THEN (words // shard_size) * size + greatest(0, least(size, words % shard_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM x"""

SQL = {
    "op2_chat_format": CHAT,
    "op4_exact_top_k": TOP_K,
    "op6_minhash_near_dedup": NEAR,
    "op7_source_mix": MIX,
    "op9_line_dedup": LINES,
    "op10_substring_dedup": REPEATS,
    "op11_ngram_jaccard_join": JACCARD,
    "op12_phrase_collocations": PHRASES,
    "op13_hard_negatives": NEGATIVES,
}
