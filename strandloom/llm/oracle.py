"""The SQL for the queries that SQL can express, for DuckDB."""

from __future__ import annotations


def _halved(levels: int) -> str:
    """The tree's levels as one common table expression each."""
    parts = []
    for k in range(levels):
        key = f"md5(concat_ws('|', source, block, pass::VARCHAR, '{k}', 'mix'))"
        parts.append(f"""n{k + 1} AS (
            SELECT source, block, pass, is_last, left_over, block_size,
                   shard * 2 + CASE WHEN 2 * row_number() OVER (PARTITION BY shard ORDER BY {key}, source NULLS LAST, block, pass)
                                         > count(*) OVER (PARTITION BY shard) + 1 THEN 1 ELSE 0 END AS shard
            FROM n{k})""")
    return ", ".join(parts)


_MIXING_SQL = rf"""
    WITH rows AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
               md5(concat_ws('|', doc_id::VARCHAR, 'mix')) AS key
        FROM documents),
    placed AS (SELECT *, key[1:2] AS block FROM rows),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
        FROM placed GROUP BY source),
    weighed AS (
        SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
               source_size * 3.0::DOUBLE AS most, sum(source_size) OVER ()::DOUBLE AS total FROM sources),
    leveled AS (
        SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
    goals AS (
        SELECT source, source_size, CASE WHEN level * weight > most THEN most
               ELSE weight * max(CASE WHEN level * weight <= most THEN level END) OVER () END AS target FROM leveled),
    blocks AS (SELECT source, block, sum(size)::BIGINT AS block_size FROM placed GROUP BY ALL),
    aims AS (
        SELECT *, least(floor(target / source_size), 3)::INT AS passes FROM goals WHERE source_size > 0),
    ordered AS (
        SELECT b.*, a.passes, a.target - a.passes * a.source_size
               - (sum(block_size) OVER (PARTITION BY b.source ORDER BY md5(concat_ws('|', b.source, block, 'mix')), block) - block_size) AS left_over
        FROM blocks b JOIN aims a ON b.source IS NOT DISTINCT FROM a.source),
    n0 AS (
        SELECT source, block, block_size, left_over, p.pass, p.pass = passes AS is_last, 0 AS shard
        FROM ordered, (SELECT unnest(range(0, 4)) AS pass) p
        WHERE p.pass < passes OR p.pass = passes AND left_over > 0),
    {_halved(4)},
    taken AS (
        SELECT source, block, any_value(block_size) AS block_size, max(CASE WHEN is_last THEN left_over END) AS left_over,
               max(CASE WHEN is_last THEN shard END) AS last_shard,
               coalesce(list(shard) FILTER (NOT is_last), []) AS whole
        FROM n4 GROUP BY source, block),
    each AS (
        SELECT p.*, t.left_over, t.last_shard, coalesce(t.whole, []) AS whole,
               t.last_shard IS NOT NULL AND (t.left_over >= t.block_size
                   OR sum(p.size) OVER (PARTITION BY p.source, p.block ORDER BY p.key, p.doc_id, p.size ROWS UNBOUNDED PRECEDING) - p.size / 2 <= t.left_over) AS within
        FROM placed p LEFT JOIN taken t ON p.source IS NOT DISTINCT FROM t.source AND p.block = t.block),
    sent AS (SELECT *, list_sort(CASE WHEN within THEN list_append(whole, last_shard) ELSE whole END) AS into FROM each)
    SELECT s.doc_id, s.size, g.source_size, g.target, s.size * len(s.into) AS taken, len(s.into) AS copies,
           array_to_string(s.into, ',') AS shards
    FROM sent s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
"""

_QUALITY_SQL = r"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    rows AS (
        SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
               list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines,
               length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
               (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))::BIGINT AS n_capitals
        FROM texts),
    windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM rows)),
    again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
    covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) t(k) GROUP BY doc_id),
    ledger AS (
        SELECT doc_id, len(words)::BIGINT AS n_words, word_chars, n_symbols, n_capitals, len(lines) AS n_lines,
               (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
        FROM rows LEFT JOIN covered USING (doc_id)),
    bits AS (
        SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
                   + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars > 25 * n_words)::INT + 32 * (100 * n_capitals > 60 * word_chars)::INT)::INT AS failed
        FROM ledger)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM bits
"""

_LINES_SQL = r"""
    WITH plain AS (
        SELECT page_id, lower(coalesce(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')) AS host,
               regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
                   '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
                   '(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
                   '<[^>]*>', '', 'g') AS text
        FROM pages),
    unescaped AS (
        SELECT page_id, host, replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS text
        FROM plain),
    rows AS (
        SELECT page_id, host, list_filter(list_transform(string_split(text, chr(10)),
                   lambda line: regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda line: line <> '') AS lines
        FROM unescaped),
    hosts AS (SELECT host, count(*) AS host_pages FROM rows GROUP BY host),
    lines AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM rows) GROUP BY ALL),
    common AS (SELECT host, list(line) AS common FROM lines JOIN hosts USING (host) WHERE n >= 2 AND n > 0.3::DOUBLE * host_pages GROUP BY host),
    cleaned AS (
        SELECT page_id, host, lines, CASE WHEN common IS NULL THEN lines ELSE list_filter(lines, lambda line: NOT list_contains(common, line)) END AS stay
        FROM rows LEFT JOIN common USING (host))
    SELECT page_id, host, host_pages, len(lines) AS n_lines, len(stay) AS n_kept, sha256(array_to_string(stay, chr(10))) AS text_sha256
    FROM cleaned JOIN hosts USING (host)
"""

_REPAIR_SQL = r"""
    WITH RECURSIVE polynomial AS (
        SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
    named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    fates AS (
        SELECT * EXCLUDE (name), xor(list_reduce(list_transform(range(1, len(name) + 1), lambda i: ascii(name[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS fate
        FROM named, polynomial),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
               CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM fates, range(1, 3) c(copy) WHERE fate <> 0 AND (copy = 1 OR fate = 3)),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM damaged),
    flagged AS (
        SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again THEN 2
                       WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
               row_number() OVER o AS pos, left(role, 1) AS initial, coalesce(lag(left(role, 1)) OVER o || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS odd
        FROM seen WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank,
               count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n
        FROM flagged GROUP BY conv_id),
    rules AS (
        SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) r(before, emits, after)),
    paths AS (
        SELECT conv_id, pos, state, way FROM (
            SELECT conv_id, 0::BIGINT AS pos, unnest([0, 2, 3]) AS state,
                   unnest([{'cost': 0::BIGINT, 'audit': '', 'text': ''}, {'cost': 3, 'audit': 'I', 'text': 'user:' || chr(10)}, {'cost': 6, 'audit': 'II', 'text': 'user:' || chr(10) || 'assistant:' || chr(10)}]) AS way
            FROM (SELECT DISTINCT conv_id FROM flagged))
        UNION ALL
        (WITH moved AS (
            SELECT p.conv_id, f.pos, p.state, {'cost': p.way.cost + 4, 'audit': p.way.audit || 'D', 'text': p.way.text} AS way
            FROM paths p JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1
            UNION ALL
            SELECT p.conv_id, f.pos, r.after, {
                'cost': p.way.cost + CASE WHEN f.fault = 3 THEN 3 ELSE 0 END + CASE WHEN f.initial = r.emits THEN 0 ELSE 3 END,
                'audit': p.way.audit || CASE WHEN f.initial = r.emits THEN 'K' ELSE 'R' END,
                'text': p.way.text || CASE WHEN f.initial = r.emits THEN f.role WHEN r.emits = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text || chr(10)} AS way
            FROM paths p JOIN flagged f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.pos = p.pos + 1
            JOIN rules r ON r.before = p.state AND (r.emits <> 's' OR f.initial = 's') WHERE f.fault NOT IN (1, 2)),
        once AS (
            SELECT * FROM moved UNION ALL
            SELECT conv_id, pos, after, {'cost': way.cost + 3, 'audit': way.audit || 'I', 'text': way.text || CASE emits WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10)}
            FROM moved JOIN rules ON before = state AND emits <> 's'),
        twice AS (
            SELECT * FROM once UNION ALL
            SELECT conv_id, pos, after, {'cost': way.cost + 3, 'audit': way.audit || 'I', 'text': way.text || CASE emits WHEN 'u' THEN 'user:' ELSE 'assistant:' END || chr(10)}
            FROM once JOIN rules ON before = state AND emits <> 's')
        SELECT conv_id, pos, state, min(way) FROM twice GROUP BY conv_id, pos, state)),
    best AS (
        SELECT p.conv_id, min(way) AS way FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.pos WHERE state IN (0, 3) GROUP BY p.conv_id)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(left(way.text, -1), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE_SQL = {
    "op1_line_dedup": _LINES_SQL,
    "op4_quality_rules": _QUALITY_SQL,
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_mixing": _MIXING_SQL,
    "op12_conversation_repair": _REPAIR_SQL,
}
