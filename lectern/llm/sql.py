"""SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

# The scripts of the corpus: letters with their marks make words, signs of scripts without spaces stand alone.
_SIGN = "[\\x{0e01}-\\x{0e2e}\\x{0e30}-\\x{0e3a}\\x{0e40}-\\x{0e45}\\x{0e47}-\\x{0e4e}\\x{3041}-\\x{3096}\\x{30a1}-\\x{30fa}\\x{30fc}-\\x{30fe}\\x{309d}\\x{309e}\\x{3005}-\\x{3007}\\x{31f0}-\\x{31ff}\\x{3400}-\\x{9fff}\\x{f900}-\\x{fadf}\\x{ff66}-\\x{ff9f}\\x{20000}-\\x{3fffd}]"
_WORD = "(?:[\\p{Latin}\\p{Cyrillic}\\p{Greek}\\x{0904}-\\x{0939}\\x{0958}-\\x{0961}\\x{0971}-\\x{097f}\\x{093d}\\x{0950}][\\x{0300}-\\x{036f}\\x{0483}-\\x{0487}\\x{0900}-\\x{0903}\\x{093a}-\\x{093c}\\x{093e}-\\x{094f}\\x{0951}-\\x{0957}\\x{0962}\\x{0963}]*)+"


def _repeated(text: str) -> str:
    """``check_id, letters, repeated`` of a text of each check: the letters of all units, and of those in a wording (two
    words, or four signs) that stood earlier. Rows delivered twice stay two rows."""
    return f"""(WITH t AS (SELECT row_number() OVER () AS r, check_id, {text} AS text FROM checks),
        u AS (SELECT r, unnest(regexp_extract_all(lower(text), '{_SIGN}|{_WORD}')) AS u, generate_subscripts(regexp_extract_all(lower(text), '{_SIGN}|{_WORD}'), 1) AS i FROM t WHERE text IS NOT NULL),
        w AS (SELECT *, CASE WHEN regexp_matches(u, '^{_SIGN}') THEN 1 ELSE 2 END AS w FROM u),
        n AS (SELECT *, lead(u, 1) OVER o AS u1, lead(u, 2) OVER o AS u2, lead(u, 3) OVER o AS u3, w + lead(w, 1) OVER o AS w1, w + lead(w, 1) OVER o + lead(w, 2) OVER o AS w2, w + lead(w, 1) OVER o + lead(w, 2) OVER o + lead(w, 3) OVER o AS w3
            FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
        k AS (SELECT r, i, u, CASE WHEN w1 >= 4 THEN 2 WHEN w2 >= 4 THEN 3 WHEN w3 >= 4 THEN 4 END AS n,
            CASE WHEN w1 >= 4 THEN concat_ws(chr(1), u, u1) WHEN w2 >= 4 THEN concat_ws(chr(1), u, u1, u2) WHEN w3 >= 4 THEN concat_ws(chr(1), u, u1, u2, u3) END AS key FROM n),
        d AS (SELECT r, i, u, CASE WHEN key IS NOT NULL AND row_number() OVER (PARTITION BY r, key ORDER BY i) > 1 THEN i + n ELSE 0 END AS e FROM k),
        c AS (SELECT r, length(u) AS l, max(e) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) > i AS again FROM d),
        s AS (SELECT r, sum(l) AS letters, coalesce(sum(l) FILTER (WHERE again), 0) AS repeated FROM c GROUP BY r)
        SELECT t.r, check_id, coalesce(letters, 0) AS letters, coalesce(repeated, 0) AS repeated FROM t LEFT JOIN s ON s.r = t.r)"""


_REASONS = "array_to_string(list_filter(reasons, lambda x: x <> ''), chr(10))"
_SHARES = f"""(SELECT a.check_id, CASE WHEN a.letters > 0 THEN a.repeated / a.letters::DOUBLE ELSE 0 END AS transcript_share, CASE WHEN b.letters > 0 THEN b.repeated / b.letters::DOUBLE ELSE 0 END AS reasons_share,
        NOT (a.letters > 0 AND 3 * a.repeated >= a.letters OR b.letters > 0 AND 3 * b.repeated >= b.letters) AS retained
    FROM {_repeated("transcript")} a JOIN {_repeated(_REASONS)} b ON a.r = b.r)"""
_ITEMS = """(SELECT 'chunk' AS item_kind, text FROM chunks UNION ALL SELECT 'paragraph', unnest(paragraphs) FROM chapters)"""

ORACLE = {
    "p1_found": f"SELECT DISTINCT check_id FROM {_SHARES} WHERE NOT retained",
    "p1_shares": f"SELECT DISTINCT check_id, round(transcript_share, 6) AS transcript_share, round(reasons_share, 6) AS reasons_share, retained FROM {_SHARES}",
    "p2_check": f"""
        SELECT i.item_kind, count(*) AS items, sum(length(text))::BIGINT AS covered, count(*) FILTER (WHERE length(text) > max_chars) AS divided, true AS within, true AS in_order
        FROM {_ITEMS} i JOIN split_limits l ON l.item_kind = i.item_kind WHERE text <> '' GROUP BY i.item_kind""",
    "p6_check": """
        SELECT pack_name, count(*) AS documents, sum(octet_length(encode(text)) + 1)::BIGINT AS tokens, count(*) FILTER (WHERE octet_length(encode(text)) + 1 > capacity) AS divided, 0 AS overfull, true AS numbered
        FROM documents, pack_sizes WHERE text <> '' GROUP BY pack_name""",
    "p2_found": """
        SELECT 'chunk' AS item_kind, chunk_id AS item_id, CAST(-1 AS INTEGER) AS p_i
        FROM chunks, split_limits WHERE item_kind = 'chunk' AND length(text) > max_chars
        UNION ALL
        SELECT 'paragraph', chapter_id, CAST(p_i AS INTEGER)
        FROM (SELECT chapter_id, unnest(paragraphs) AS text, generate_subscripts(paragraphs, 1) - 1 AS p_i FROM chapters), split_limits
        WHERE item_kind = 'paragraph' AND length(text) > max_chars""",
    "p6_found": """
        SELECT pack_name, doc_id FROM documents, pack_sizes
        WHERE text <> '' AND octet_length(encode(text)) + 1 > capacity""",
}
