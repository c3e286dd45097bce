"""The derived views as SQL for the correctness check."""

from __future__ import annotations

from textscore.functions.text import ENTITY_TAGS
from textscore.plans.views import SCORE_RANGES


def h(expr: str, seed: str | int | None = None) -> str:
    """32-bit hash of a value and a seed."""
    text = f"({expr})::VARCHAR" + ("" if seed is None else f" || '-{seed}'")
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def key(expr: str, seed: str | int = 0) -> str:
    return f"md5(({expr})::VARCHAR || '-{seed}')"


WORD = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
TAGS = "|".join(ENTITY_TAGS)

_SCORE = " ".join(f"WHEN {s} THEN {lo} + {h('doc_id', 'score')} % {n}" for s, (lo, n) in SCORE_RANGES.items())


def number(col: str) -> str:
    """Text to BIGINT, NULL if unreadable or not whole."""
    t = f"trim({col})"
    v = f"CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast({t} AS DOUBLE) END"
    whole = f"CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN try_cast({t} AS BIGINT) END"
    return f"coalesce({whole}, CASE WHEN ({v}) = floor({v}) THEN try_cast({v} AS BIGINT) END)"


def null_token(col: str) -> str:
    return f"CASE WHEN {col} NOT IN ('', '<NA>') THEN {col} END"


def binned(value: str, edges: tuple) -> str:
    cases = " ".join(f"WHEN {value} > {a} AND {value} <= {b} THEN {i + 1}" for i, (a, b) in enumerate(zip(edges, edges[1:])))
    return f"(CASE {cases} END)"


def quartile_class(value: str, e: str) -> str:
    return (
        f"(CASE WHEN {value} >= {e}[1] AND {value} <= {e}[2] THEN 1 WHEN {value} > {e}[2] AND {value} <= {e}[3] THEN 2 "
        f"WHEN {value} > {e}[3] AND {value} <= {e}[4] THEN 3 WHEN {value} > {e}[4] AND {value} <= {e}[5] THEN 4 END)"
    )


VIEWS = {
    "v_reviews": f"""
        SELECT doc_id AS row_id, text AS reviewText, source AS type,
               CASE WHEN k < 1 THEN 1 WHEN k < 3 THEN 2 WHEN k < 6 THEN 3 WHEN k < 11 THEN 4 ELSE 5 END AS overall
        FROM (SELECT *, {h('doc_id', 'overall')} % 23 AS k FROM documents)""",
    "v_essays_raw": f"""
        SELECT doc_id::VARCHAR AS essay_id, essay_set::VARCHAR AS essay_set,
               '@CAPS' || (1 + doc_id % 3) || ' ' || text || ' @DRIVER' AS essay,
               CASE WHEN doc_id % 37 = 0 THEN '' WHEN doc_id % 41 = 0 THEN '<NA>' WHEN doc_id % 43 = 0 THEN 'x1'
                    ELSE (CASE essay_set {_SCORE} END)::VARCHAR END AS domain1_score,
               CASE WHEN essay_set = 2 THEN (1 + {h('doc_id', 'score2')} % 4)::VARCHAR WHEN doc_id % 53 = 0 THEN '9007199254740993'
                    WHEN doc_id % 59 = 0 THEN '3d' WHEN doc_id % 61 = 0 THEN '4.0' ELSE '' END AS domain2_score
        FROM (SELECT *, 1 + doc_id % 8 AS essay_set FROM documents)""",
    "v_essays_clean": f"""
        SELECT {number('essay_id')} AS essay_id, {number('essay_set')} AS essay_set,
               regexp_replace(essay, '({TAGS})', '\\1 ', 'g') AS essay,
               {number('domain1_score')} AS domain1_score, {number('domain2_score')} AS domain2_score
        FROM v_essays_raw WHERE {number('domain1_score')} IS NOT NULL AND essay NOT IN ('', '<NA>')""",
    "v_edges": """
        SELECT essay_set, quantile_cont(domain1_score::DOUBLE, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e
        FROM v_essays_clean WHERE essay_set IN (7, 8) GROUP BY essay_set""",
    "v_essays": f"""
        SELECT c.essay_id, c.essay_set, c.essay, c.domain2_score,
               (CASE WHEN c.essay_set = 1 THEN {binned('c.domain1_score', (1, 7, 8, 9, 12))}
                    WHEN c.essay_set = 2 THEN {binned('c.domain1_score', (0, 2, 3, 4, 6))}
                    WHEN c.essay_set IN (3, 4) THEN c.domain1_score + 1
                    WHEN c.essay_set IN (5, 6) THEN {binned('c.domain1_score', (-1, 1, 2, 3, 4))}
                    ELSE {quartile_class('c.domain1_score', 'q.e')} END)::BIGINT AS domain1_score
        FROM v_essays_clean c LEFT JOIN v_edges q ON c.essay_set = q.essay_set""",
    "v_predictions": f"""
        SELECT *, pos // 16 AS batch_id FROM (
            SELECT row_id, type, overall - 1 AS y_true,
                   greatest(0, least(4, overall - 1 + {h('row_id', 'err')} % 3 - 1)) AS y_pred,
                   row_number() OVER (ORDER BY row_id) - 1 AS pos
            FROM v_reviews)""",
    "v_predictions_no0": "SELECT * REPLACE (greatest(1, y_pred) AS y_pred) FROM v_predictions",
    "v_logits": f"""
        SELECT row_id, y_true, batch_id,
               [{', '.join(f"({h('row_id', j)} % 2001 - 1000) / 250.0::DOUBLE" for j in range(5))}] AS z
        FROM v_predictions""",
    "v_words": f"SELECT doc_id, text, regexp_extract_all(lower(text), '{WORD}') AS words FROM documents",
    "v_word_counts": """
        SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM v_words) WHERE length(word) > 1 GROUP BY word""",
    "v_tokens": f"""
        SELECT doc_id, pos, token, ({h('token')} % (SELECT count(*) FROM embeddings))::BIGINT AS id
        FROM (SELECT doc_id, unnest(words) AS token, generate_subscripts(words, 1) - 1 AS pos FROM v_words)""",
    "v_pieces": f"""
        SELECT doc_id, i, p, g, (sum(CASE WHEN g THEN 0 ELSE 1 END) OVER before - 1)::INT AS pos,
               (sum(length(p)) OVER before)::INT AS "end"
        FROM (SELECT doc_id, p, i, regexp_matches(p, '^\\s') AS g
              FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
                    FROM (SELECT doc_id, regexp_extract_all(text, '\\s+|{WORD}') AS ps FROM documents)))
        WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)""",
    "v_vec": "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings",
    "v_dims": "SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM v_vec",
    "v_class_weight": "SELECT id AS class, v AS w, 0.01::DOUBLE * id AS b FROM v_vec WHERE id < 5",
    "v_class_dims": "SELECT class, b, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS d FROM v_class_weight",
    "v_counts": "SELECT doc_id, id, count(*) AS n FROM v_tokens GROUP BY doc_id, id",
    "v_pooled": """
        SELECT doc_id, d, sum(n * x) / sum(n) AS m, sum(n) AS t
        FROM v_counts JOIN v_dims USING (id) GROUP BY doc_id, d""",
    "v_doc_logits": """
        SELECT doc_id, class, sum(w * tanh(m)) + any_value(b) AS logit, any_value(t) AS t
        FROM v_pooled JOIN v_class_dims USING (d) GROUP BY doc_id, class""",
    "v_doc_pred": """
        SELECT doc_id, class, logit FROM v_doc_logits
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY logit DESC, class) = 1""",
    "v_factors": """
        SELECT p.doc_id, p.d, c.w * (CASE WHEN p.m = 0 THEN 1 ELSE tanh(p.m) / p.m END) / p.t / 64 AS f
        FROM v_pooled p JOIN v_doc_pred y USING (doc_id) JOIN v_class_dims c ON c.class = y.class AND c.d = p.d""",
    "v_pair_scores": """
        SELECT doc_id, id, sum(x * f) AS score
        FROM v_counts JOIN v_dims USING (id) JOIN v_factors USING (doc_id, d) GROUP BY doc_id, id""",
    "v_scores": """
        SELECT t.doc_id, t.pos, t.id, t.token, s.score
        FROM v_tokens t JOIN v_pair_scores s ON t.doc_id = s.doc_id AND t.id = s.id""",
    "v_runs": """
        SELECT d.lang AS run, substr(p.type, 4, 9)::INT AS epoch,
               (floor(20 * avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END)) * 5)::DOUBLE AS accuracy
        FROM v_predictions p JOIN documents d ON d.doc_id = p.row_id GROUP BY 1, 2""",
    "v_cm": """
        SELECT t.k AS y_true, p.k AS y_pred, count(v.row_id) AS n
        FROM range(5) t(k) CROSS JOIN range(5) p(k)
        LEFT JOIN v_predictions v ON v.y_true = t.k AND v.y_pred = p.k GROUP BY 1, 2""",
    "v_cm_no0": """
        SELECT t.k AS y_true, p.k AS y_pred, count(v.row_id) AS n
        FROM range(5) t(k) CROSS JOIN range(5) p(k)
        LEFT JOIN v_predictions_no0 v ON v.y_true = t.k AND v.y_pred = p.k GROUP BY 1, 2""",
    "v_class_table": """
        SELECT y_true AS class, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END)::BIGINT AS correct,
               sum(n)::BIGINT AS total, any_value(a.all_rows)::BIGINT AS all_rows
        FROM v_cm, (SELECT sum(n) AS all_rows FROM v_cm) a GROUP BY y_true""",
}

_NEEDS = {
    name: [
        other for other in VIEWS
        if other != name and other in text.replace(",", " ").replace(")", " ").split()
    ]
    for name, text in VIEWS.items()
}


def with_views(body: str) -> str:
    """Put the views that a query names, and those they name, in front of it."""
    words = body.replace("(", " ").replace(")", " ").replace(",", " ").split()
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS[name]:
            if other not in ordered:
                add(other)
        if name not in ordered:
            ordered.append(name)

    for name in VIEWS:
        if name in words:
            add(name)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{ctes},\n{body.removeprefix(start)}"
    return f"WITH {ctes}\n{body}"
