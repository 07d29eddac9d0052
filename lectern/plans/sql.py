"""SQL for the core's queries, over the same tables."""

from __future__ import annotations

from lectern.functions import arrays as A
from lectern.functions import text as T
from lectern.functions.narration import ABBREVIATIONS
from lectern.plans import literals, sources

CHARS_PER_HOUR = 15 * 3600


def _clean(text: str) -> str:
    bare = f"regexp_replace(replace({text}, chr(173), ''), '\\[\\s*\\d{{1,3}}\\s*\\]', '', 'g')"
    return f"trim(regexp_replace(replace({bare}, chr(10), ' '), '[ \\t\\x{{a0}}\\x{{2009}}\\x{{202f}}]+', ' ', 'g'), ' ')"


def _sentences(text: str) -> str:
    cut = f"string_split(regexp_replace(trim({text}, ' '), '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda x: trim(x, ' ')), lambda x: length(x) > 0)"


def _canon(text: str) -> str:
    bare = f"replace(regexp_replace(lower({text}), '[—–]', ' ', 'g'), '-', '')"
    return f"trim(regexp_replace(regexp_replace({bare}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def _stem(w: str) -> str:
    return f"substr({w}, 1, least(6, greatest(4, length({w}) - 3)))"


#: Characters that stand for those that two texts share, and those for all others of the one and of the other.
_CODES = "".join(chr(c) for c in (*range(1, 9), *range(14, 32), *range(33, 127)) if chr(c) not in "'\\")


def _distance(a: str, b: str) -> str:
    """The edit distance in characters; DuckDB's counts bytes. Only which characters are the same matters, so those that
    stand in both texts become one byte each, and all others of a text one byte that the other text has not."""
    shared = f"list_intersect(string_split({a}, ''), string_split({b}, ''))"
    coded = lambda text, rest: f"array_to_string(list_transform(string_split({text}, ''), lambda ch: CASE WHEN list_position({shared}, ch) > 0 THEN substr('{_CODES}', CAST(list_position({shared}, ch) AS INTEGER), 1) ELSE {rest} END), '')"
    plain = f"regexp_matches({a} || {b}, '^[ -~]*$')"
    return f"CASE WHEN {plain} THEN levenshtein({a}, {b}) ELSE levenshtein({coded(a, 'chr(127)')}, {coded(b, chr(39) + ' ' + chr(39))}) END"


def _coded(text: str, rest: str) -> str:
    """The same for a text beside a column ``shared`` of the characters that stand in both."""
    return f"array_to_string(list_transform(string_split({text}, ''), lambda ch: CASE WHEN strpos(shared, ch) > 0 THEN substr('{_CODES}', CAST(strpos(shared, ch) AS INTEGER), 1) ELSE {rest} END), '')"


def _close(a: str, b: str) -> str:
    apart = f"abs(length({a}) - length({b}))"
    return f"""CASE WHEN {a} = {b} THEN true WHEN length({a}) >= 5 AND length({b}) >= 4 AND {apart} <= 3 AND (starts_with({b}, {_stem(a)}) OR starts_with({a}, {_stem(b)})) THEN true
        WHEN {apart} > greatest(2, length({a}) // 3) THEN false ELSE {_distance(a, b)} <= greatest(1, length({a}) // 4) END"""


def _romanized(text: str) -> str:
    one = {c: r for c, r in T.ROMANIZE.items() if len(r) == 1}
    none = "".join(c for c, r in T.ROMANIZE.items() if not r)
    for c, r in T.ROMANIZE.items():
        if len(r) > 1:
            text = f"replace(replace({text}, '{c}', '{r}'), '{c.upper()}', '{r.capitalize()}')"
    low, high = "".join(one), "".join(one.values())
    return f"translate({text}, '{low}{low.upper()}{none}{none.upper()}', '{high}{high.upper()}')"


def _abbreviated(text: str, lang: str) -> str:
    import re

    flags, guard = ("(?i)", "[^\\p{L}]") if lang == "ru" else ("", "[^A-Za-z]")
    for short in sorted(ABBREVIATIONS[lang], key=len, reverse=True):
        text = f"regexp_replace({text}, '{flags}(^|{guard}){re.escape(short)}', '\\1{ABBREVIATIONS[lang][short]}', 'g')"
    return text


def _tags(text: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({text}, '{pattern}') THEN '{tag}'" for pattern, tag in T.TAG_RULES)
    return f"'{T.BASELINE_TAG}' || CASE {cases} ELSE '' END"


def _backend(lang: str) -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.BACKENDS.items())
    return f"CASE string_split(lower(coalesce({lang}, '')), '-')[1] {known} ELSE '{T.DEFAULT_BACKEND}' END"


_TITLES = ", ".join(f"'{t}'" for t in T.NON_CONTENT_TITLES)
_PARAGRAPHS = "(SELECT chapter_id, book_id, unnest(paragraphs) AS text, CAST(generate_subscripts(paragraphs, 1) - 1 AS INTEGER) AS p_i FROM chapters)"
_CHUNKS = "(SELECT *, concat_ws('/', book_id, chapter_index) AS chapter FROM chunks)"
_HEARD = """(SELECT c.*, k.text, k.lang FROM (
        SELECT check_id, arg_max(chunk_id, loaded_at) AS chunk_id, arg_max(attempt, loaded_at) AS attempt, arg_max(ok, loaded_at) AS ok,
            arg_max_null(cer, loaded_at) AS cer, arg_max_null(transcript, loaded_at) AS heard FROM checks GROUP BY check_id) c
    JOIN chunks k ON k.chunk_id = c.chunk_id)"""
_FIRST_VOWEL = "(^|[^\\p{L}\\p{N}_])([бвгджзйклмнпрстфхцчшщъьБВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ]*)([аеиоуыэюя])"
_EDGES = "^[.,!?;:—\\-«»\"''()\\[\\]…]+|[.,!?;:—\\-«»\"''()\\[\\]…]+$"
_CLITICS = ", ".join(f"'{w}'" for w in T.CLITICS)
_CLEAN_TITLE = f"regexp_replace({_clean('title')}, '^[ .—\\-–\\t]+|[ .—\\-–\\t]+$', '', 'g')"
_AUDIO = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_PEAK = "coalesce(list_max(list_transform(audio, lambda x: abs(x))), 0)"
_RMS = "sqrt(list_sum(list_transform(audio, lambda x: x * x)) / len(audio))"
_BAD = "(SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN (vec_id + i - 1) % 17 = 0 THEN 'nan'::DOUBLE WHEN (vec_id + i - 1) % 29 = 0 THEN 'infinity'::DOUBLE ELSE x::DOUBLE END) AS audio FROM embeddings)"
_LIMIT = A.db_to_lin(A.CEILING)
_KNEE = 0.7 * _LIMIT
_FLOOR = A.db_to_lin(A.SPEECH_FLOOR)
_EDITS = """(SELECT chunk_id, CASE chunk_id % 4 WHEN 0 THEN replace(text, '.', ' !') WHEN 1 THEN text || ' x' WHEN 2 THEN '' ELSE text END AS text,
        CASE chunk_id % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'short' END AS pause FROM chunks)"""
_BAKEOFF = f"(SELECT check_id, attempt, ok, cer, {_backend('lang')} AS backend, (check_id % 8) / 16.0::DOUBLE AS rtf, (check_id % 5 + 7) / 8.0::DOUBLE AS peak FROM {_HEARD})"


def _speech(audio: str) -> str:
    speech = f"list_filter({audio}, lambda x: abs(x) > {_FLOOR!r})"
    level = lambda x: f"sqrt(list_sum(list_transform({x}, lambda x: x * x)) / len({x}))"
    return f"20 * log10(greatest(CASE WHEN len({speech}) > 0 THEN {level(speech)} ELSE {level(audio)} END, 1e-12))"


def _letters(text: str) -> str:
    return f"regexp_replace(replace(lower(replace({text}, chr(769), '')), 'ё', 'е'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


ORACLE = {
    "inspect_by_lang": f"""
        SELECT lang, count(*) AS documents, coalesce(sum(length(clean)), 0)::BIGINT AS chars, coalesce(sum(len({_sentences('clean')})), 0)::BIGINT AS sentences,
            round(avg(length(clean)), 4) AS mean_chars, round(coalesce(sum(length(clean)), 0) / {CHARS_PER_HOUR}.0::DOUBLE, 6) AS hours
        FROM (SELECT lang, {_clean('text')} AS clean FROM documents) GROUP BY lang""",
    "inspect_books": f"""
        SELECT book_id, count(DISTINCT chapter_id) AS chapters, coalesce(sum(length(text)), 0)::BIGINT AS chars,
            round(coalesce(sum(length(text)), 0) / {CHARS_PER_HOUR}.0::DOUBLE, 6) AS hours
        FROM {_PARAGRAPHS} GROUP BY book_id""",
    "clean_paragraphs": f"SELECT chapter_id, p_i, {_clean('nfc_normalize(text)')} AS clean FROM {_PARAGRAPHS}",
    "chapter_titles": f"""
        SELECT chapter_id, clean, CASE WHEN len(parts) = 0 THEN '{T.UNTITLED}' WHEN len(parts) = 1 THEN parts[1]
            WHEN regexp_matches(parts[-1], '(?i)^[0-9IVXLCDM]+[.)]?$') THEN array_to_string(parts, ' — ')
            WHEN len(parts) > 2 THEN parts[1] || ' — ' || parts[-1] ELSE parts[-1] END AS flat,
            coalesce(lower(clean) IN ({_TITLES}), false) OR coalesce(lower(nav_path[-1]) IN ({_TITLES}), false) AS non_content
        FROM (SELECT chapter_id, {_CLEAN_TITLE} AS clean, nav_path, list_filter(coalesce(nav_path, []), lambda x: length(x) > 0) AS parts FROM chapters)""",
    "unlisted_text": """
        WITH d AS (SELECT *, concat_ws('/', coalesce(source, ''), coalesce(lang, ''), kind) AS file FROM documents)
        SELECT file, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM d
        WHERE file NOT IN (SELECT file FROM d WHERE book_id IS NOT NULL AND kind <> 'verse') GROUP BY file HAVING coalesce(sum(length(text)), 0) > 500""",
    "chapter_spec": """
        SELECT book_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([book_id % 3 + 1], range(book_id % 5 + 1, book_id % 5 + 4)), lambda x: x <= 6))), ',') AS chapters
        FROM books""",
    "book_chapters": f"""
        WITH toc AS (SELECT book_id, chapter_id, nav_path, src, list_filter(coalesce(nav_path, []), lambda x: length(x) > 0) AS parts, nav_path[-1] AS label FROM chapters),
        spine AS (SELECT book_id, src, min(chapter_index) AS position, list_filter(arg_min(paragraphs, chapter_id), lambda x: length(x) > 0) AS p FROM chapters GROUP BY book_id, src),
        made AS (SELECT toc.*, position, CASE WHEN coalesce(lower(p[1]) = lower(label), false) THEN p[2:] ELSE p END AS p FROM toc JOIN spine ON spine.book_id = toc.book_id AND spine.src = toc.src
            WHERE NOT (coalesce(lower(regexp_replace({_clean('label')}, '^[ .—\\-–\\t]+|[ .—\\-–\\t]+$', '', 'g')) IN ({_TITLES}), false) OR coalesce(lower(label) IN ({_TITLES}), false)))
        SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY position, chapter_id) AS INTEGER) AS chapter_index, CASE WHEN len(parts) = 0 THEN '{T.UNTITLED}' WHEN len(parts) = 1 THEN parts[1]
            WHEN regexp_matches(parts[-1], '(?i)^[0-9IVXLCDM]+[.)]?$') THEN array_to_string(parts, ' — ') WHEN len(parts) > 2 THEN parts[1] || ' — ' || parts[-1] ELSE parts[-1] END AS title, src, CAST(len(p) AS INTEGER) AS n_paragraphs
        FROM made WHERE len(p) > 0""",
    "slugs": """
        SELECT p_partkey, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
            p_name || ' / ' || p_type, '[^\\w\\s.\\-]', '', 'g'), '[\\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM part""",
    "latin_share_bands": """
        SELECT CAST(floor(share * 10) AS BIGINT) AS band, share >= 0.9 AS english, count(*) AS n
        FROM (SELECT CASE WHEN a + b = 0 THEN 0 ELSE a / (a + b)::DOUBLE END AS share FROM (
            SELECT len(regexp_extract_all(text, '[A-Za-z]')) AS a, len(regexp_extract_all(text, '[А-Яа-яЁё]')) AS b FROM chunks WHERE text IS NOT NULL))
        GROUP BY ALL""",
    "romanized_titles": f"SELECT chunk_id, {_romanized('text')} AS latin FROM chunks",
    "matched_case": """
        SELECT book_id, CASE WHEN length(o) = 0 THEN o WHEN length(title) > 1 AND title = upper(title) AND title <> lower(title) THEN upper(o)
            WHEN left(title, 1) = upper(left(title, 1)) AND left(title, 1) <> lower(left(title, 1)) THEN upper(left(o, 1)) || substr(o, 2) ELSE o END AS author
        FROM (SELECT book_id, title, lower(author) AS o FROM books)""",
    "plural_ru": """
        SELECT n, CASE WHEN n % 100 BETWEEN 11 AND 14 THEN 'лет' WHEN n % 10 = 1 THEN 'год' WHEN n % 10 BETWEEN 2 AND 4 THEN 'года' ELSE 'лет' END AS form, count(*) AS rows
        FROM (SELECT CAST(l_quantity AS INTEGER) AS n FROM lineitem) GROUP BY n""",
    "roman_numerals": "SELECT o_orderkey, CAST(o_orderkey % 3999 + 1 AS BIGINT) AS value FROM orders",
    "spelled_names": "SELECT s_suppkey, array_to_string(list_transform(string_split(s_name, ''), lambda c: CASE WHEN regexp_matches(c, '[A-Za-z]') THEN lower(c) ELSE c END), ' ') AS spelled FROM supplier",
    "abbreviations": f"""
        SELECT doc_id, lower(lang) AS lang, CASE WHEN lower(lang) = 'ru' THEN {_abbreviated('text', 'ru')} ELSE {_abbreviated('text', 'en')} END AS text
        FROM documents WHERE lower(lang) IN ('en', 'ru') AND text IS NOT NULL""",
    "sentences_crude": f"""
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest
        FROM (SELECT doc_id, {_sentences(_clean('text'))} AS s FROM documents WHERE text IS NOT NULL)""",
    "edit_batches": f"""
        SELECT chapter, batch, count(*) AS n, min(chunk_id) AS first
        FROM (SELECT chapter, chunk_id, CAST((row_number() OVER (PARTITION BY chapter ORDER BY chunk_id) - 1) // 20 AS BIGINT) AS batch FROM {_CHUNKS}) GROUP BY ALL""",
    "passages": f"""
        WITH timed AS (SELECT chapter, chunk_id, coalesce(is_paragraph_end, false) AS p, sum(0.55::DOUBLE + length(text) / 15.0::DOUBLE) OVER (PARTITION BY chapter ORDER BY chunk_id) AS t
            FROM {_CHUNKS} WHERE text IS NOT NULL),
        cut AS (SELECT chapter, min(chunk_id) AS last FROM timed WHERE p AND t >= 30 GROUP BY chapter)
        SELECT timed.chapter, chunk_id FROM timed LEFT JOIN cut ON cut.chapter = timed.chapter WHERE last IS NULL OR chunk_id <= last""",
    "acute_marks": """
        SELECT chunk_id, acute, regexp_replace(acute, '(?s)(.)' || chr(769), '+\\1', 'g') AS plus
        FROM (SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(text, '([аеёиоуыэюя])', '+\\1', 'g'), '\\+([ёЁ])', '\\1', 'g'), '(?s)\\+(.)', '\\1' || chr(769), 'g') AS acute
            FROM chunks WHERE text IS NOT NULL)""",
    "sparse_marks": f"""
        WITH m AS (SELECT chunk_id, text, regexp_replace(text, '{_FIRST_VOWEL}', '\\1\\2+\\3', 'g') AS marked FROM chunks WHERE text IS NOT NULL),
        t AS (SELECT chunk_id, unnest(string_split(marked, ' ')) AS token, generate_subscripts(string_split(marked, ' '), 1) AS i FROM m),
        b AS (SELECT *, replace(token, '+', '') AS bare, regexp_replace(regexp_replace(token, '\\+([ёЁ])', '\\1', 'g'), '(?s)\\+(.)', '\\1' || chr(769), 'g') AS acute FROM t),
        c AS (SELECT *, regexp_replace(lower(bare), '{_EDGES}', '', 'g') AS core FROM b),
        o AS (SELECT chunk_id, string_agg(CASE WHEN contains(core, 'ё') OR len(regexp_extract_all(core, '[аеёиоуыэюя]')) < 2 OR core IN ({_CLITICS}) THEN bare
            WHEN contains(acute, '-') AND contains(acute, chr(769)) THEN array_to_string(string_split(acute, chr(769))[1:-2], '') || chr(769) || string_split(acute, chr(769))[-1]
            ELSE acute END, ' ' ORDER BY i) AS text FROM c GROUP BY chunk_id),
        w AS (SELECT chunk_id, count(DISTINCT replace(word, '+', '')) FILTER (WHERE replace(word, '+', '') <> '') AS n
            FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(marked), '[+а-яё]+')) AS word FROM m) GROUP BY chunk_id)
        SELECT m.chunk_id, o.text, regexp_replace(m.text, '([\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}},»)]) [–—] ', '\\1... ', 'g') AS paused, CAST(coalesce(n, 0) AS INTEGER) AS words
        FROM m JOIN o ON o.chunk_id = m.chunk_id LEFT JOIN w ON w.chunk_id = m.chunk_id""",
    "stems": f"""
        SELECT {_stem('word')} AS stem, count(*) AS n, count(DISTINCT word) AS forms
        FROM (SELECT unnest(string_split({_canon('text')}, ' ')) AS word FROM chunks) WHERE word <> '' GROUP BY 1""",
    "close_words": f"""
        WITH w AS (SELECT list_filter(string_split({_canon('text')}, ' '), lambda x: x <> '') AS w FROM chunks),
        p AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))
        SELECT a, b, {_close('a', 'b')} AS close FROM p""",
    "cer_simple": f"""
        WITH c AS (SELECT check_id, {_canon("coalesce(text, '')")} AS a, {_canon("coalesce(heard, '')")} AS b FROM {_HEARD}),
        s AS (SELECT *, array_to_string(list_intersect(string_split(a, ''), string_split(b, '')), '') AS shared FROM c),
        d AS (SELECT *, {_coded('a', 'chr(127)')} AS x, {_coded('b', "' '")} AS y FROM s)
        SELECT check_id, round(CASE WHEN length(a) = 0 THEN CASE WHEN length(b) = 0 THEN 0 ELSE 1 END ELSE levenshtein(x, y) / length(a)::DOUBLE END, 6) AS cer FROM d""",
    "missing_words": f"""
        WITH h AS (SELECT check_id, list_filter(string_split({_canon("coalesce(text, '')")}, ' '), lambda w: length(w) >= 2) AS a,
            list_filter(string_split({_canon("coalesce(heard, '')")}, ' '), lambda w: length(w) > 0) AS b FROM {_HEARD}),
        w AS (SELECT check_id, b, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM h),
        p AS (SELECT DISTINCT w, unnest(b) AS x FROM w),
        n AS (SELECT w, x FROM p WHERE {_close('w', 'x')}),
        f AS (SELECT DISTINCT check_id, i FROM (SELECT check_id, i, w, unnest(b) AS x FROM w) SEMI JOIN n USING (w, x)),
        l AS (SELECT check_id, string_agg(w, ' ' ORDER BY i) AS missing FROM w ANTI JOIN f USING (check_id, i) WHERE NOT (length(w) >= 5 AND contains(array_to_string(b, ''), w)) GROUP BY check_id)
        SELECT check_id, coalesce(missing, '') AS missing FROM h LEFT JOIN l USING (check_id)""",
    "word_deficits": f"""
        SELECT check_id, written, said, coalesce((written - said >= 2 AND written >= 6) OR (written > said AND written >= 12 AND cer > 0.005), false) AS deficit
        FROM (SELECT check_id, cer, CAST(len(list_filter(string_split({_canon("coalesce(text, '')")}, ' '), lambda w: w <> '')) AS INTEGER) AS written,
            CAST(len(list_filter(string_split({_canon("coalesce(heard, '')")}, ' '), lambda w: w <> '')) AS INTEGER) AS said FROM {_HEARD})""",
    "attempt_outcomes": f"""
        SELECT chunk_id, count(*) AS n, CASE WHEN coalesce(bool_or(ok), false) THEN 'ok' WHEN count(cer) >= 2 AND max(cer) - min(cer) < 0.06 THEN 'unverifiable_text' ELSE 'synthesis_failure' END AS outcome
        FROM {_HEARD} GROUP BY chunk_id""",
    "kept_attempts": f"""
        SELECT chunk_id, coalesce(min(attempt) FILTER (WHERE ok), max(attempt)) AS attempt, count(*) FILTER (WHERE ok) > 0 AS ok
        FROM {_HEARD} WHERE attempt <= 3 GROUP BY chunk_id""",
    "rate_calibration": f"""
        WITH r AS (SELECT *, count(*) FILTER (WHERE chars >= 40) OVER (PARTITION BY chapter ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM (
            SELECT chapter, chunk_id, length(text) AS chars, (chunk_id % 97 + 40) / 16.0::DOUBLE AS seconds FROM {_CHUNKS} WHERE text IS NOT NULL))
        SELECT chunk_id, round(CASE WHEN n >= 12 THEN (SELECT quantile_cont(q.chars / q.seconds, 0.5) FROM r q WHERE q.chapter = r.chapter AND q.chars >= 40 AND q.n BETWEEN r.n - 400 AND r.n - 1) ELSE 15.0 END, 6) AS rate FROM r""",
    "signal_levels": f"""
        SELECT vec_id, round({_PEAK}, 6) AS peak, round({_RMS}, 6) AS rms, round(20 * log10(greatest({_RMS}, 1e-12)), 4) AS dbfs,
            round(-20.0::DOUBLE - 20 * log10(greatest(CASE WHEN len(speech) > 0 THEN sqrt(list_sum(list_transform(speech, lambda x: x * x)) / len(speech)) ELSE {_RMS} END, 1e-12)), 4) AS gain
        FROM (SELECT vec_id, audio, list_filter(audio, lambda x: abs(x) > {_FLOOR!r}) AS speech FROM (SELECT vec_id, {_AUDIO} AS audio FROM embeddings))""",
    "normalised": f"""
        WITH a AS (SELECT vec_id, {_AUDIO} AS audio FROM embeddings), b AS (SELECT vec_id, audio, {_speech('audio')} AS before FROM a),
        c AS (SELECT *, -20.0::DOUBLE - before AS gain, list_transform(audio, lambda x: x * pow(10, (-20.0::DOUBLE - before) / 20)) AS y FROM b),
        d AS (SELECT *, CASE WHEN list_max(list_transform(y, lambda x: abs(x))) <= {_LIMIT!r} THEN y ELSE list_transform(y, lambda x: greatest(-{_LIMIT!r}, least({_LIMIT!r},
            CASE WHEN abs(x) > {_KNEE!r} THEN sign(x) * ({_KNEE!r} + {_LIMIT - _KNEE!r} * tanh((abs(x) - {_KNEE!r}) / {_LIMIT - _KNEE!r})) ELSE x END))) END AS z FROM c)
        SELECT vec_id, round(before, 4) AS rms_before, round(gain, 4) AS gain, round({_speech('z')}, 4) AS rms_after, round(20 * log10(greatest(list_max(list_transform(z, lambda x: abs(x))), 1e-12)), 4) AS peak_after,
            round(-60.0::DOUBLE + gain, 4) AS noise_floor, round(list_max(list_transform(z, lambda x: abs(x))), 6) AS peak FROM d""",
    "phoneme_tokens": """
        SELECT chunk_id, array_to_string(list_transform(regexp_extract_all(text, '(?i)(\\+?[а-яё][+а-яё]*(?:-[+а-яё]+)*|\\.\\.\\.|[—–]|-\\s|[,.!?;:…])'),
            lambda t: CASE WHEN t = '...' THEN '…' WHEN t = '–' OR t LIKE '-%' THEN '—' ELSE t END), ' ') AS tokens FROM chunks WHERE text IS NOT NULL""",
    "assembled": f"""
        WITH v AS (SELECT vec_id // 10 AS part, vec_id, vec_id % 5 * 10 AS pause, {_AUDIO} AS audio FROM embeddings WHERE vec_id % 7 <> 3),
        h AS (SELECT *, {_PEAK} AS top FROM v),
        s AS (SELECT *, list_transform(audio, lambda x: CASE WHEN top > {_LIMIT!r} THEN x * ({_LIMIT!r} / top) ELSE x END) AS x FROM h),
        l AS (SELECT *, list_filter(range(1, len(x) + 1), lambda i: abs(x[i]) > {A.db_to_lin(A.TRIM_FLOOR)!r}) AS loud FROM s),
        t AS (SELECT *, CASE WHEN len(loud) > 0 THEN x[greatest(loud[1] - 40, 1):least(loud[-1] + 40, len(x))] ELSE [] END AS piece FROM l),
        j AS (SELECT part, flatten(list(list_concat(piece, CASE WHEN len(piece) > 0 THEN list_transform(range(pause), lambda i: 0.0::DOUBLE) ELSE [] END) ORDER BY vec_id)) AS y FROM t GROUP BY part),
        g AS (SELECT a.part, list_concat(list_transform(range(700), lambda i: 0.0::DOUBLE), coalesce(y, []), list_transform(range(900), lambda i: 0.0::DOUBLE)) AS w FROM (SELECT DISTINCT vec_id // 10 AS part FROM embeddings) a LEFT JOIN j ON j.part = a.part),
        n AS (SELECT part, w, -20.0::DOUBLE - {_speech('w')} AS gain FROM g),
        o AS (SELECT *, list_transform(w, lambda x: x * pow(10, gain / 20)) AS y FROM n),
        z AS (SELECT *, CASE WHEN list_max(list_transform(y, lambda x: abs(x))) <= {_LIMIT!r} THEN y ELSE list_transform(y, lambda x: greatest(-{_LIMIT!r}, least({_LIMIT!r},
            CASE WHEN abs(x) > {_KNEE!r} THEN sign(x) * ({_KNEE!r} + {_LIMIT - _KNEE!r} * tanh((abs(x) - {_KNEE!r}) / {_LIMIT - _KNEE!r})) ELSE x END))) END AS z FROM o)
        SELECT part, round(len(w) / 1000.0::DOUBLE, 6) AS seconds, CAST(0 AS BIGINT) AS clamped, round({_speech('z')}, 4) AS rms_after, round(gain, 4) AS gain FROM z""",
    "usable_arrays": f"""
        SELECT vec_id, len(audio) / (vec_id % 30 + 1)::DOUBLE BETWEEN 1 AND 20 AND len(list_filter(audio, lambda x: NOT isfinite(x))) = 0 AS usable, len(audio) / (vec_id % 30 + 1)::DOUBLE BETWEEN 1 AND 20 AS clean FROM {_BAD}""",
    "sanitised": f"""
        SELECT vec_id, CAST(len(list_filter(audio, lambda x: NOT isfinite(x))) AS BIGINT) AS bad,
            round(list_max(list_transform(audio, lambda x: CASE WHEN isfinite(x) THEN abs(x) ELSE 0 END)), 6) AS peak FROM {_BAD}""",
    "limited": f"""
        SELECT vec_id, round(CASE WHEN p <= {_LIMIT!r} THEN list_sum(audio) ELSE list_sum(list_transform(audio, lambda x: greatest(-{_LIMIT!r}, least({_LIMIT!r},
                CASE WHEN abs(x) > {_KNEE!r} THEN sign(x) * ({_KNEE!r} + {_LIMIT - _KNEE!r} * tanh((abs(x) - {_KNEE!r}) / {_LIMIT - _KNEE!r})) ELSE x END)))) END, 5) AS soft,
            round(list_sum(list_transform(audio, lambda x: x * CASE WHEN p > {_LIMIT!r} THEN {_LIMIT!r} / p ELSE 1.0 END)), 5) AS scaled, CAST(40 AS BIGINT) AS silence
        FROM (SELECT vec_id, audio, {_PEAK} AS p FROM (SELECT vec_id, list_transform({_AUDIO}, lambda x: x * 4) AS audio FROM embeddings))""",
    "signal_reasons": f"""
        SELECT vec_id, CASE WHEN len(audio) = 0 THEN 1 ELSE CAST({_PEAK} < 0.02 AS BIGINT) + CAST({_PEAK} >= 1 AS BIGINT) + CAST({_RMS} < 0.005 AS BIGINT)
            + CAST(len(audio) / 16.0::DOUBLE > e * s AS BIGINT) + CAST(len(audio) / 16.0::DOUBLE < e / s AS BIGINT) END AS n
        FROM (SELECT vec_id, audio, 0.55::DOUBLE + c / 15.0::DOUBLE AS e, 2.2::DOUBLE * CASE WHEN c < 25 THEN 1.6 WHEN c < 60 THEN 1.25 ELSE 1.0 END AS s
            FROM (SELECT vec_id, list_transform({_AUDIO}, lambda x: x * (vec_id % 5)) AS audio, 6 * (vec_id % 20 + 1) AS c FROM embeddings))""",
    "duration_guards": """
        SELECT chunk_id, s BETWEEN n / 40.0::DOUBLE AND greatest(4.0, n / 7.0::DOUBLE) AS fits, round(CASE WHEN s = 0 THEN 'infinity'::DOUBLE ELSE 0.5 / s END, 6) AS rtf
        FROM (SELECT chunk_id, length(text) AS n, (chunk_id % 40) / 4.0::DOUBLE AS s FROM chunks WHERE text IS NOT NULL)""",
    "longest_quiet_runs": """
        WITH e AS (SELECT user_id, coalesce(value < 50, false) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT user_id, f, n - row_number() OVER (PARTITION BY user_id, f ORDER BY n) AS i FROM e),
        s AS (SELECT user_id, f, count(*) AS c FROM r GROUP BY user_id, f, i)
        SELECT user_id, coalesce(max(c) FILTER (WHERE f), 0) AS longest FROM s GROUP BY user_id""",
    "applied_edits": f"""
        SELECT c.chunk_id, coalesce(e.text, c.text) AS text, CASE WHEN e.pause = 'long' THEN pause_ms + 600 WHEN e.pause = 'short' THEN greatest(150, pause_ms // 2) ELSE pause_ms END AS pause_ms
        FROM chunks c LEFT JOIN {_EDITS} e ON e.chunk_id = c.chunk_id""",
    "judged_edits": f"""
        SELECT e.chunk_id, CASE WHEN c.text IS NULL THEN 'unknown' WHEN coalesce(length(trim(e.text, ' ')), 0) = 0 THEN 'blank' WHEN {_letters('e.text')} <> {_letters('c.text')} THEN 'rejected'
            WHEN e.text = c.text AND pause IS NULL THEN 'unchanged' ELSE 'accepted' END AS outcome
        FROM {_EDITS} e LEFT JOIN chunks c ON e.chunk_id = c.chunk_id""",
    "delivery_tags": f"SELECT {_tags('text')} AS tags, count(*) AS n, min(chunk_id) AS first FROM chunks WHERE text IS NOT NULL GROUP BY 1",
    "content_digests": f"SELECT chapter, substr(sha1(string_agg(coalesce(text, ''), chr(10) ORDER BY chunk_id)), 1, 16) AS digest FROM {_CHUNKS} GROUP BY chapter",
    "chunk_keys": "SELECT chunk_id, substr(sha1('voice=a' || chr(0) || text), 1, 12) AS key FROM chunks WHERE text IS NOT NULL",
    "default_backends": f"SELECT book_id, {_backend('language')} AS backend FROM books",
    "backend_summary": f"""
        SELECT backend, round(median(cer), 6) AS median_cer, round(max(cer), 6) AS max_cer, round(median(nullif(rtf, 0)), 6) AS median_rtf, count(*) FILTER (WHERE peak >= 1) AS clipped,
            count(*) FILTER (WHERE NOT ok) AS failed, round(median(nullif(rtf, 0)) * 10, 6) AS hours
        FROM {_BAKEOFF} GROUP BY backend""",
    "backend_pivot": f"""
        SELECT attempt, {', '.join(f"coalesce(arg_min(status, check_id) FILTER (WHERE backend = '{b}'), '-') AS {b}" for b in ('silero', 'kokoro', 'chatterbox'))}
        FROM (SELECT attempt, check_id, backend, CASE WHEN NOT coalesce(ok, false) THEN 'bad' WHEN cer > 0.10 THEN 'warn' ELSE 'good' END AS status FROM {_BAKEOFF}) GROUP BY attempt""",
    "first_sources": "SELECT source, min(doc_id) AS first FROM documents GROUP BY source",
    "strided_windows": """
        SELECT user_id, unnest(range(b + 60, e - 30 - 3600, 86400)) AS window_start
        FROM (SELECT user_id, CAST(min(floor(epoch(ts))) AS BIGINT) AS b, CAST(max(floor(epoch(ts))) AS BIGINT) AS e FROM events GROUP BY user_id)""",
    "band_topk": "SELECT event_id, user_id, value FROM events WHERE value BETWEEN 10 AND 90 AND user_id >= 2 ORDER BY value DESC, event_id LIMIT 25",
    "best_voices": """
        WITH v AS (SELECT doc_id, len(regexp_extract_all(text, ',')) / length(text)::DOUBLE AS quiet, CAST(len(string_split(text, ' ')) AS INTEGER) AS words,
            coalesce(regexp_matches(right(trim(text, ' '), 3), '[.!?…]'), false) AS complete FROM documents WHERE length(text) > 0),
        a AS (SELECT * FROM (SELECT * FROM v ORDER BY quiet, doc_id LIMIT 60) WHERE words >= 8 ORDER BY quiet, doc_id LIMIT 40)
        SELECT * FROM a ORDER BY complete DESC, quiet, words DESC, doc_id LIMIT 20""",
    "nonfinite_scan": f"""
        SELECT vec_id AS file, count(*) FILTER (WHERE NOT isfinite(s)) AS bad, count(*) AS total, min(i) FILTER (WHERE NOT isfinite(s)) / 16.0::DOUBLE AS first_seconds
        FROM (SELECT vec_id, unnest(audio) AS s, generate_subscripts(audio, 1) - 1 AS i FROM {_BAD}) GROUP BY vec_id HAVING count(*) FILTER (WHERE NOT isfinite(s)) > 0""",
    "bitrate_ladder": f"""
        SELECT b.book_id, CAST(coalesce(list_max(list_filter([32, 40, 48, 56, 64], lambda r: r <= floor((8.0::DOUBLE - 0.4 - CASE WHEN length(cover_path) > 0 THEN 0.25 ELSE 0.0 END) * 1048576 * 8 / (chars / 16.0::DOUBLE) / 1000 * 0.97))), 32) AS BIGINT) AS kbps
        FROM books b JOIN (SELECT book_id, sum(length(text)) AS chars FROM {_PARAGRAPHS} GROUP BY book_id) h ON h.book_id = b.book_id""",
    "chapter_markers": """
        SELECT chapter_id, coalesce(lag(end_ms) OVER (PARTITION BY book_id ORDER BY chapter_id), 0) AS start_ms, end_ms
        FROM (SELECT book_id, chapter_id, CAST(round_even(sum(seconds) OVER (PARTITION BY book_id ORDER BY chapter_id) * 1000, 0) AS BIGINT) AS end_ms
            FROM (SELECT book_id, chapter_id, coalesce(list_sum(list_transform(paragraphs, lambda p: coalesce(length(p), 0))), 0) / 16.0::DOUBLE AS seconds FROM chapters WHERE paragraphs IS NOT NULL))""",
    "chapter_metadata": """
        WITH m AS (SELECT book_id, chapter_id, title, CAST(round_even(sum(len(paragraphs) / 4.0::DOUBLE) OVER (PARTITION BY book_id ORDER BY chapter_id) * 1000, 0) AS BIGINT) AS e FROM chapters WHERE paragraphs IS NOT NULL),
        s AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY book_id ORDER BY chapter_id), 0) AS b FROM m)
        SELECT book_id, ';FFMETADATA1' || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || b || chr(10) || 'END=' || e || chr(10) || 'title='
            || replace(regexp_replace(coalesce(title, ''), '([=;#\\\\])', '\\\\\\1', 'g'), chr(10), ' '), chr(10) ORDER BY chapter_id) || chr(10) AS metadata FROM s GROUP BY book_id""",
    "missing_chapters": "SELECT chunk_id, book_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM checks k WHERE k.chunk_id = c.chunk_id AND k.ok)",
    "chapter_report": f"""
        WITH a AS (SELECT vec_id, len(audio) AS n, list_sum(list_transform(audio, lambda x: x * x)) AS q, {_PEAK} AS p FROM (SELECT vec_id, {_AUDIO} AS audio FROM embeddings))
        SELECT book_id, chapter_index, count(*) AS chunks, coalesce(sum(greatest(k.n - 1, 0)), 0)::BIGINT AS retries, count(*) FILTER (WHERE NOT passed) AS flagged,
            CASE WHEN sum(a.n) > 0 THEN round(20 * log10(greatest(sqrt(sum(q) / sum(a.n)), 1e-12)), 5) END AS rms, CASE WHEN sum(a.n) > 0 THEN round(20 * log10(greatest(max(p), 1e-12)), 5) END AS peak
        FROM chunks LEFT JOIN (SELECT chunk_id, count(DISTINCT check_id) AS n, bool_or(ok) AS passed FROM checks GROUP BY chunk_id) k ON k.chunk_id = chunks.chunk_id LEFT JOIN a ON vec_id = chunks.chunk_id GROUP BY book_id, chapter_index""",
    "container_problems": """
        SELECT book_id, array_to_string(list_filter([CASE WHEN book_id % 3 <> 0 THEN 'media_type is not 2' END, CASE WHEN book_id % 4 = 0 THEN 'no chapters' END,
            CASE book_id % 5 WHEN 0 THEN 'no audio stream' WHEN 1 THEN 'audio codec is mp3, expected aac' END, CASE WHEN coalesce(length(title), 0) = 0 THEN 'no title tag' END,
            CASE WHEN coalesce(length(cover_path), 0) = 0 THEN 'no cover art' END], lambda x: x IS NOT NULL), '; ') AS problems FROM books""",
    "corpus_split": """
        SELECT doc_id, lang, CASE WHEN row_number() OVER (ORDER BY md5('7/' || doc_id), doc_id) <= 100 THEN 'val' ELSE 'train' END AS part FROM documents WHERE text IS NOT NULL""",
    "corpus_hours": """
        SELECT book_id, count(*) FILTER (WHERE s BETWEEN 1 AND 20) AS kept, count(*) FILTER (WHERE NOT s BETWEEN 1 AND 20) AS dropped, round(sum(s) FILTER (WHERE s BETWEEN 1 AND 20) / 3600, 6) AS hours
        FROM (SELECT book_id, length(text) / 16.0::DOUBLE AS s FROM chunks WHERE text IS NOT NULL) GROUP BY book_id""",
    "kept_lines": """
        SELECT file, CAST(i - 1 AS BIGINT) AS ordinal, CAST(length(t) AS BIGINT) AS chars
        FROM (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL) WHERE length(trim(t, ' ')) > 0""",
    "hourly_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}

ORACLE |= sources.ORACLE | literals.ORACLE
