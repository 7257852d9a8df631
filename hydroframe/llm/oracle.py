"""SQL (DuckDB) for the queries that SQL can say in full."""

from __future__ import annotations

from hydroframe.llm import chat, decontamination, periodic, quality
from hydroframe.llm.settings import MARKED, MIX_SEED, WEIGHTS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UNIT = "(('0x' || substr(md5({}), 1, 12))::BIGINT / 281474976710656.0)"
_ID = "coalesce(doc_id::VARCHAR, '')"


def _mixture() -> str:
    named = ", ".join(f"('{k}', {w})" for k, w in WEIGHTS.items())
    rest = 1 - sum(WEIGHTS.values())
    u = _UNIT.format(f"'{MIX_SEED}:count:' || {_ID} || ':' || md5(coalesce(text, ''))")
    o = _UNIT.format(f"'{MIX_SEED}:order:' || {_ID} || ':' || md5(coalesce(text, '')) || ':' || k")
    return f"""
    WITH w(source, weight) AS (VALUES {named}),
    d AS (SELECT documents.*, w.source AS b, coalesce(weight, {rest!r}) AS weight, {u} AS u FROM documents LEFT JOIN w USING (source)),
    sizes AS (SELECT b, any_value(weight) * (SELECT sum(length(coalesce(text, '')) + 1) FROM d) / sum(length(coalesce(text, '')) + 1) AS mean FROM d GROUP BY b),
    cdf AS (SELECT b, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY b ORDER BY k) AS p FROM sizes, range(200) r(k)),
    counted AS (SELECT d.*, (SELECT count(*) FROM cdf WHERE cdf.b IS NOT DISTINCT FROM d.b AND cdf.p <= d.u) AS n FROM d),
    copies AS (SELECT *, unnest(range(1, n + 1)) AS k FROM counted)
    SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS mix_copy, {o} AS mix_order FROM copies
    """


def _quality() -> str:
    q = quality
    chars = {k: rf"[{c}]" for k, c in q.CLASSES.items()}
    found = ", ".join(f"length(regexp_replace(t, '[^{c[1:-1].replace(chr(39), chr(39) * 2)}]+', '', 'g')) AS {k}" for k, c in chars.items())
    names = ", ".join([*q.CLASSES, "other"])
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    t AS (SELECT id, lang, len(w) AS n, array_to_string(w, '') AS t FROM d),
    c0 AS (SELECT id, lang, n, length(t) AS len, {found} FROM t),
    c AS (SELECT *, len - {' - '.join(q.CLASSES)} AS other FROM c0),
    lang_chars AS (UNPIVOT (SELECT lang, sum(n) AS total, {', '.join(f'sum({k}) AS {k}' for k in [*q.CLASSES, 'other'])} FROM c GROUP BY lang HAVING sum(n) >= {q.MIN_REFERENCE_WORDS}) ON {names} INTO NAME k VALUE v),
    doc_chars AS (UNPIVOT (SELECT id, lang, len, {names} FROM c WHERE n >= {q.MIN_WORDS}) ON {names} INTO NAME k VALUE v),
    ref_chars AS (SELECT lang, k, v / sum(v) OVER (PARTITION BY lang) AS q FROM lang_chars),
    char_distance AS (SELECT id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS x
        FROM (SELECT id, q, v / len AS p FROM doc_chars JOIN ref_chars USING (lang, k)) GROUP BY id),
    word AS (SELECT id, lang, unnest(w) AS word FROM d),
    totals AS (SELECT lang, max(total) AS total FROM lang_chars GROUP BY lang),
    common AS (SELECT lang, word, count(*) AS n FROM word GROUP BY lang, word HAVING count(*) >= {q.COMMON_SHARE} * (SELECT total FROM totals WHERE totals.lang = word.lang)),
    ref_words AS (SELECT lang, word, n / total AS q FROM common JOIN totals USING (lang)
        UNION ALL SELECT lang, NULL, (total - coalesce((SELECT sum(n) FROM common WHERE common.lang = totals.lang), 0)) / total FROM totals),
    hits AS (SELECT id, lang, word, count(*) AS n FROM word SEMI JOIN common USING (lang, word) GROUP BY id, lang, word),
    doc_words AS (SELECT id, lang, word, n FROM hits UNION ALL SELECT id, lang, NULL, len(w) - coalesce((SELECT sum(n) FROM hits WHERE hits.id = d.id), 0) FROM d),
    word_distance AS (SELECT id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS x
        FROM (SELECT d.id, r.q, coalesce(h.n, 0) / len(d.w) AS p FROM d JOIN ref_words r USING (lang) LEFT JOIN doc_words h ON h.id = d.id AND h.word IS NOT DISTINCT FROM r.word WHERE len(d.w) >= {q.MIN_WORDS}) GROUP BY id),
    lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d),
    dup AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
    gram AS (SELECT id, i, w[i:i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM gram) WHERE n > 1),
    rep AS (SELECT id, count(DISTINCT j) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY id),
    base AS (SELECT d.id, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup ON dup.id = d.id LEFT JOIN rep ON rep.id = d.id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(c.x > {q.MAX_CHAR_DISTANCE}, false) AND NOT coalesce(v.x > {q.MAX_WORD_DISTANCE}, false) AS kept
    FROM base LEFT JOIN char_distance c ON c.id = base.id LEFT JOIN word_distance v ON v.id = base.id
    """


def _contamination() -> str:
    span = decontamination.SPAN
    found = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
    WITH items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {found} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item, least(len(w), {span}) AS size, array_to_string(w[i:i + {span - 1}], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {span - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
    d AS (SELECT row_number() OVER () AS id, doc_id, {found} AS w FROM documents),
    sizes AS (SELECT DISTINCT size FROM windows),
    grams AS (SELECT id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
    hit AS (SELECT id, i, size, item FROM grams JOIN windows USING (size, g)),
    places AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT id, i, size FROM hit)) GROUP BY id),
    found AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hit) GROUP BY id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places ON places.id = d.id LEFT JOIN found ON found.id = d.id
    """


def _jaccard() -> str:
    found = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return rf"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {found} AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id
    FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id
    """


def _chat() -> str:
    escaped = lambda c: rf"regexp_replace({c}, '<(\\*)\|', '<\\\1|', 'g')"
    marks = len(chat.START) + len(chat.SEP) + len(chat.END) + 1
    return rf"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{MARKED}' UNION ALL SELECT -1, 1, '{chat.TRAINED}', '{MARKED}'),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
        {marks} + length({escaped('role')}) + length({escaped('text')}) AS chars FROM c),
    s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM n)
    SELECT conv_id, max(n)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
        length(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{chat.TRAINED}'), ''))::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = '{chat.TRAINED}'), '')) AS loss_sha256,
        (sum(so_far) FILTER (role = '{chat.TRAINED}' OR i = n))::BIGINT AS formatted_chars
    FROM s GROUP BY conv_id
    """


def _periodic() -> str:
    """Runs as stretches of pairs of like five words with one lag: a run has five matches in a row at least. A stretch of a
    multiple of its period is the period's own stretch, so of stretches alike the least lag counts."""
    return rf"""
    WITH RECURSIVE crc_table(b, k, v) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
        UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc_table WHERE k < 8),
    crc(s, i, v) AS (SELECT DISTINCT doc_id::VARCHAR, 1, 4294967295 FROM documents WHERE doc_id IS NOT NULL
        UNION ALL SELECT s, i + 1, xor(crc.v >> 8, t.v) FROM crc JOIN crc_table t ON t.k = 8 AND t.b = xor(crc.v, ascii(substr(s, i, 1))) & 255 WHERE i <= length(s)),
    hashed AS (SELECT s, xor(v, 4294967295) AS h FROM crc WHERE i = length(s) + 1),
    plain AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS w FROM documents),
    params AS (SELECT id, doc_id, w, h % 10 = 0 AND len(w) > 0 AS change, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a, 3 + h // 10 % 8 AS parts FROM plain LEFT JOIN hashed ON s = doc_id::VARCHAR),
    d AS MATERIALIZED (SELECT id, doc_id, CASE WHEN coalesce(change, false) THEN w[:a] || list_transform(range(a, len(w)), lambda i: w[a + (i - a) % (1 + (len(w) - a) // parts) + 1]) ELSE w END AS w FROM params),
    grams AS MATERIALIZED (SELECT id, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM (SELECT id, w, unnest(range(0, len(w) - 4)) AS i FROM d WHERE len(w) >= 6)),
    often AS (SELECT id, g FROM grams GROUP BY id, g HAVING count(*) > 1),
    again AS MATERIALIZED (SELECT id, i, g FROM grams JOIN often USING (id, g)),
    pairs AS (SELECT x.id, x.i, x.i - y.i AS lag FROM again x JOIN again y ON x.id = y.id AND x.g = y.g AND x.i > y.i),
    islands AS (SELECT id, lag, min(i) - lag AS start, count(*) + 4 + lag AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY id, lag ORDER BY i) AS island FROM pairs) GROUP BY id, lag, island),
    runs AS MATERIALIZED (SELECT id, start, length, min(lag) AS period FROM islands WHERE length >= greatest({periodic.LEAST_WORDS}, {periodic.LEAST_PERIODS} * lag) GROUP BY id, start, length),
    dropped AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM runs),
    words AS (SELECT id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d WHERE id IN (SELECT id FROM runs)),
    collapsed AS (SELECT id, string_agg(word, ' ' ORDER BY words.i) AS t FROM words ANTI JOIN dropped USING (id, i) GROUP BY id),
    named AS (SELECT id, count(*) AS n, max(struct_pack(length := length, before := -start, shorter := -period)) AS best, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_runs, (-best.before)::BIGINT AS start, best.length::BIGINT AS length, (-best.shorter)::BIGINT AS period,
        (1000 * best.length // -best.shorter)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, array_to_string(w, ' '))) AS collapsed_sha256
    FROM d LEFT JOIN named ON named.id = d.id LEFT JOIN collapsed ON collapsed.id = d.id
    """


ORACLE: dict[str, str] = {
    "op1_source_mixture": _mixture(),
    "op6_quality_rules": _quality(),
    "op7_decontamination": _contamination(),
    "op8_ngram_jaccard": _jaccard(),
    "op9_chat_examples": _chat(),
    "op13_periodic_runs": _periodic(),
}
