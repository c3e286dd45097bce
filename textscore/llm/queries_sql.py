"""SQL of the queries that SQL can express."""

from __future__ import annotations

from textscore.llm.quality_rules import LEVELS, MAX_REPEAT_PERCENT, MIN_WORDS, RULES, Risk

NEAR_VECTORS = """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
        WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
    reach(vec_id, r) AS (
        SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.j FROM reach JOIN links ON links.i = reach.r),
    counts AS (SELECT i, count(*) AS n FROM links GROUP BY i)
    SELECT vec_id, any_value(coalesce(n, 0))::BIGINT AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
    FROM reach LEFT JOIN counts ON i = vec_id GROUP BY vec_id"""

_BLANK = "[\\x20\\x09-\\x0D]"
_WORD = "[^\\x20\\x09-\\x0D]"
_RISK = Risk()
_TESTS = " UNION ALL ".join(
    f"SELECT lang, quality, {n} AS level, {' OR '.join(f'{r} > {v[-n]}' for r, v in RULES.items())} AS over FROM holdout" for n in range(1, LEVELS + 1))
_FAILED = ", ".join(f"CASE WHEN {r} > [{', '.join(map(str, reversed(v)))}][level] THEN '{r}' END" for r, v in RULES.items())

QUALITY_RULES = f"""
    WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
    split AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{_WORD}+') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM texts),
    placed AS (SELECT doc_id, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM split),
    windows AS (SELECT doc_id, i, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lag(w1) OVER o AS w0
                FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3) AS n FROM windows WHERE w3 IS NOT NULL),
    repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, range(3) r(k) WHERE n > 1 GROUP BY doc_id),
    adjacent AS (SELECT doc_id, count(*) AS n FROM windows WHERE w0 = w1 GROUP BY doc_id),
    counts AS (
        SELECT s.doc_id, lang, t, len(w) AS n_words, length(regexp_replace(t, '{_BLANK}+', '', 'g')) AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaims,
               strlen(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS upper_bytes, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
               coalesce(r.n, 0) AS n_repeat_words, coalesce(a.n, 0) AS n_adjacent
        FROM split s LEFT JOIN repeated r USING (doc_id) LEFT JOIN adjacent a USING (doc_id)),
    shares AS (
        SELECT *, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(n_exclaims / nullif(n_words, 0), 0) AS exclaims_per_word,
               coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
               coalesce(n_adjacent / nullif(n_words, 0), 0) AS adjacent_share, coalesce(upper_bytes / nullif(word_chars, 0), 0) AS upper_share,
               n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed
        FROM counts),
    holdout AS (
        SELECT lang, t, max(quality) AS quality, {', '.join(f'any_value({r}) AS {r}' for r in RULES)}
        FROM shares JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1) GROUP BY lang, t),
    tested AS (
        SELECT lang, level, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 1 AND over) AS k,
               count(*) FILTER (quality = 0 AND over) AS bad FROM ({_TESTS}) GROUP BY lang, level),
    tails AS (
        SELECT lang, level, bad - {_RISK.cost} * any_value(k) AS gain, CASE WHEN any_value(k) >= any_value(good) THEN 1 ELSE
               sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln({_RISK.share}) + (good - i) * ln(1 - {_RISK.share}))) END AS p
        FROM tested, LATERAL (SELECT unnest(range(0, k + 1)) AS i) GROUP BY lang, level, bad),
    certified AS (
        SELECT lang, level, gain, min(CASE WHEN p <= {_RISK.delta} / (SELECT count(DISTINCT coalesce(lang, '')) FROM holdout) THEN 1 ELSE 0 END)
               OVER (PARTITION BY lang ORDER BY level) AS passed FROM tails),
    chosen AS (SELECT lang, level FROM certified WHERE passed = 1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY gain DESC, level) = 1),
    judged AS (SELECT s.*, list_filter([{_FAILED}], lambda x: x IS NOT NULL) AS failed FROM shares s LEFT JOIN chosen c ON c.lang IS NOT DISTINCT FROM s.lang)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept,
           array_to_string(failed, ',') AS failed_rules FROM judged"""

REPEATED_STRINGS = """
    WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    starts AS (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM texts WHERE n >= 100),
    strings AS (SELECT doc_id, i, b[i:i + 99] AS s FROM starts),
    repeats AS (SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
    marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS new FROM repeats),
    numbered AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
    spans AS (SELECT doc_id, k, min(i) AS low, max(i) + 100 AS high FROM numbered GROUP BY doc_id, k),
    cuts AS (
        SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 1) AS a, low AS z FROM spans
        UNION ALL
        SELECT t.doc_id, coalesce(max(high), 1), any_value(n) + 1 FROM texts t LEFT JOIN spans s ON s.doc_id = t.doc_id GROUP BY t.doc_id),
    kept AS (
        SELECT doc_id, list_reduce(list(CASE WHEN z > a THEN b[a:z - 1] ELSE ''::BLOB END ORDER BY a), lambda x, y: x || y) AS rest
        FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id),
    removed AS (SELECT doc_id, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
    SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(rest) AS kept_sha256
    FROM texts JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)"""

_ITEM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ITEM_WORD}')"

BENCHMARK_HITS = f"""
    WITH texts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS s, least(len(w), 10) AS n
                FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM windows),
    runs AS (SELECT doc_id, n, i, w[i:i + n - 1] AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, sizes)),
    places AS (SELECT DISTINCT doc_id, n, i, item_id FROM runs JOIN windows USING (n, s)),
    hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM places, range(10) r(k) WHERE k < n GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM places) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_AWAY = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_ROUND = """
    a{k} AS MATERIALIZED (
        SELECT vec_id, label, p, v, e, away FROM (SELECT vec_id, label, p, v, e, {away} AS away FROM parts JOIN b{k} USING (p))
        QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY away, e) = 1)"""
_MOVE = """
    b{n} AS MATERIALIZED (
        SELECT p, e, coalesce(m, c) AS c FROM b{k} LEFT JOIN (
            SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
                SELECT p, e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 9)) AS i) GROUP BY p, e, i)
            GROUP BY p, e) USING (p, e))"""

#: Vectors of 64 components, eight parts, six rounds.
PART_CODES = f"""
    WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE {_FINITE}),
    parts AS MATERIALIZED (SELECT vec_id, label, p, v[8 * p + 1:8 * p + 8] AS v FROM whole, (SELECT unnest(range(8)) AS p)),
    b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM parts
           WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT 16)),
    {", ".join(_ROUND.format(k=k, away=_AWAY) + "," + _MOVE.format(k=k, n=k + 1) for k in range(6))},
    {_ROUND.format(k=6, away=_AWAY)},
    books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS digest FROM b6),
    coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(away)::BIGINT AS error
              FROM a6 GROUP BY vec_id)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM coded, books"""

HARD_NEGATIVES = f"""
    WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
               FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
    scored AS MATERIALIZED (
        SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score
        FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
    positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5"""
