"""DuckDB's SQL for the registered queries that SQL can express, over whole tables.

Operators 3, 5 to 8 and 10 have none: SQL lacks their vectors, hashes, tokenizers, media and
files; operator 2 deals slots to shards in turn and reports CRC-32. The tests hold those
against brute force.
"""

from __future__ import annotations

from lamina.llm import mixing, packing, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE counted AS (
    SELECT doc_id, CAST(len({WORDS}) AS BIGINT) + 1 AS tokens FROM documents
), split AS (
    SELECT doc_id, tokens, unnest(range(0, (tokens - 1) // {packing.MAX_LENGTH} + 1)) AS chunk FROM counted
), seqs AS (
    SELECT doc_id, chunk, chunk * {packing.MAX_LENGTH} AS start, least({packing.MAX_LENGTH}, tokens - chunk * {packing.MAX_LENGTH}) AS length,
        md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', chunk)) AS key
    FROM split
), lengths AS (
    SELECT row_number() OVER (ORDER BY length) AS j, length AS size,
        CAST(sum(n) OVER (ORDER BY length) AS BIGINT) AS rows_to, CAST(sum(n * length) OVER (ORDER BY length) AS BIGINT) AS tokens_to
    FROM (SELECT length, count(*) AS n FROM seqs GROUP BY length) t
), edges AS (
    SELECT j, size, rows_to, tokens_to FROM lengths UNION ALL SELECT 0, 0, 0, 0
), best AS (
    SELECT 1 AS k, j, size * rows_to - tokens_to AS cost, CAST(0 AS BIGINT) AS i FROM edges
    UNION ALL
    SELECT any_value(b.k) + 1, hi.j,
        CASE WHEN hi.j = 0 THEN 0 ELSE min(b.cost + hi.size * (hi.rows_to - lo.rows_to) - (hi.tokens_to - lo.tokens_to)) END,
        CASE WHEN hi.j = 0 THEN 0 ELSE min_by(lo.j, (b.cost + hi.size * (hi.rows_to - lo.rows_to) - (hi.tokens_to - lo.tokens_to)) * 4096 + lo.j) END
    FROM best b JOIN edges lo ON lo.j = b.j JOIN edges hi ON hi.j > lo.j OR hi.j = 0 AND lo.j = 0
    WHERE b.k < least({packing.BUCKETS}, (SELECT max(j) FROM edges))
    GROUP BY hi.j
), path AS (
    SELECT k, j, i FROM best WHERE k = (SELECT max(k) FROM best) AND j = (SELECT max(j) FROM edges)
    UNION ALL
    SELECT best.k, best.j, best.i FROM path JOIN best ON best.k = path.k - 1 AND best.j = path.i WHERE path.i > 0
), bounds AS (
    SELECT size AS upper, row_number() OVER (ORDER BY size) - 1 AS bucket FROM edges WHERE j IN (SELECT j FROM path)
), placed AS (
    SELECT seqs.*, (SELECT count(*) FROM bounds WHERE upper < length) AS bucket FROM seqs
), dealt AS (
    SELECT placed.*, upper, greatest(1, {packing.TOKEN_BUDGET} // upper) AS cap,
        row_number() OVER (PARTITION BY placed.bucket ORDER BY key, doc_id, chunk) - 1 AS pos
    FROM placed JOIN bounds ON bounds.bucket = placed.bucket
)
SELECT doc_id, chunk, start, length, CAST(bucket AS INTEGER) AS bucket, upper AS bucket_length, pos // cap AS batch, pos % cap AS place, upper - length AS padding FROM dealt
"""

OP4 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS words,
        [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
    FROM documents
), windows AS (
    SELECT rid, pos, list_slice(words, pos, pos + {quality.WINDOW - 1}) AS win FROM (SELECT rid, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS pos FROM docs) t
), twice AS (
    SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) t WHERE n > 1
), repeated AS (
    SELECT rid, count(DISTINCT place) AS n_repeat_words FROM (SELECT rid, unnest(range(pos, pos + {quality.WINDOW})) AS place FROM twice) t GROUP BY rid
), top AS (
    SELECT rid, max(n) AS top_word FROM (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(words) AS word FROM docs) t GROUP BY rid, word) t GROUP BY rid
), counted AS (
    SELECT docs.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines, coalesce(top_word, 0) AS top_word,
        (length(text) - length(replace(text, '!!', ''))) // 2 + (length(text) - length(replace(text, '...', ''))) // 3 + length(text) - length(replace(text, '…', '')) AS n_marks,
        len([i FOR i IN range(1, len(words)) IF words[i] = words[i + 1]]) AS n_stutters
    FROM docs LEFT JOIN repeated ON repeated.rid = docs.rid LEFT JOIN top ON top.rid = docs.rid
), judged AS (
    SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND n_symbols <= 0.5 * n_words AND n_marks <= 0.5 * n_words AND top_word / greatest(1, n_words) <= {quality.MOST_TOP_WORD}
        AND n_stutters / greatest(1, n_words) <= 0.3 AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND n_dup_lines <= 0.5 * n_lines AS kept
FROM judged
"""

OP9 = f"""
WITH docs AS (
    SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(concat('{mixing.SEED}:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM documents
), sources AS (
    SELECT source, source_size, {mixing.MAX_EPOCHS} * source_size AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source) t
), weighed AS (
    SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][(rank - 1) % {len(mixing.WEIGHTS)} + 1] AS weight, cap / [{', '.join(map(str, mixing.WEIGHTS))}][(rank - 1) % {len(mixing.WEIGHTS)} + 1] AS ratio FROM sources
), filling AS (
    SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {mixing.BUDGET} - CAST(coalesce(sum(cap) OVER ahead, 0) AS DOUBLE)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0) AS DOUBLE) AS level
    FROM weighed WINDOW ahead AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
    SELECT source, source_size, CASE WHEN ratio <= level THEN CAST(cap AS DOUBLE) ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target FROM filling
), parts AS (
    SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS copies FROM filled
), dealt AS (
    SELECT doc_id, size, source_size, target, copies, CAST(round(target - CAST(copies * source_size AS DOUBLE)) AS BIGINT) AS rest,
        CAST(coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM docs JOIN parts ON parts.source IS NOT DISTINCT FROM docs.source
)
SELECT doc_id, size, source_size, target, size * copies + greatest(0, least(size, rest - start)) AS taken FROM dealt
"""

ORACLE_SQL: dict[str, str] = {"op1_packing": OP1, "op4_quality": OP4, "op9_mixing": OP9}
