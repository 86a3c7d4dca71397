"""DuckDB SQL for the training-data queries that SQL can express. The others are tested against brute force."""

_OP3 = r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""

_OP7 = """WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1),
    r AS (SELECT c.conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = last THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM conversations c LEFT JOIN l ON c.conv_id = l.conv_id),
    a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    b AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM r WHERE conv_id IS NOT NULL),
    j AS (SELECT coalesce(a.conv_id, b.conv_id) AS pair_id, coalesce(a.place, b.place) AS place, a.role AS ar, a.text AS a_text, b.role AS br, b.text AS b_text FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.place = b.place),
    s AS (SELECT *, bool_and(ar IS NOT DISTINCT FROM br AND a_text IS NOT DISTINCT FROM b_text) OVER (PARTITION BY pair_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS shared FROM j),
    p AS (SELECT pair_id, CASE WHEN shared THEN 'prompt' ELSE 'chosen' END AS part, place, ar AS role, a_text AS text FROM s WHERE ar IS NOT NULL UNION ALL SELECT pair_id, 'rejected', place, br, b_text FROM s WHERE br IS NOT NULL AND NOT shared),
    g AS (SELECT pair_id, part, place, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment, role = 'assistant' AND part <> 'prompt' AS in_loss FROM p),
    u AS (SELECT pair_id, bool_or(part = 'chosen' AND in_loss) AND bool_or(part = 'rejected' AND in_loss) AS usable FROM g GROUP BY 1),
    e AS (SELECT *, sum(length(segment)) OVER (PARTITION BY pair_id, part ORDER BY place ROWS UNBOUNDED PRECEDING)::BIGINT AS "end" FROM g)
    SELECT e.pair_id, part, place, role, segment, in_loss, "end" - length(segment) AS start, "end", usable FROM e JOIN u ON e.pair_id = u.pair_id"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT DISTINCT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item, least(13, len(w)) AS span, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(k) WHERE len(w) > 0),
    dw AS (SELECT doc_id, k, span, array_to_string(w[k : k + span - 1], ' ') AS g FROM d, (SELECT DISTINCT span FROM iw) s, unnest(range(1, len(w) - span + 2)) AS u(k)),
    h AS (SELECT doc_id, k, dw.span, item FROM dw JOIN iw ON dw.g = iw.g AND dw.span = iw.span),
    n AS (SELECT doc_id, count(DISTINCT k + x) AS n_hit FROM h, unnest(range(span)) AS u(x) GROUP BY 1), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

_STRIPPED = "trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_OP11 = f"""WITH l AS (SELECT doc_id, generate_subscripts(v, 1) AS place, unnest(v) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS v FROM documents)),
    k AS (SELECT doc_id, place, line, {_STRIPPED} AS key FROM l), g AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM g GROUP BY 1"""

_OP12 = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d),
    c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM m LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1, 2),
    f AS (SELECT substr('ABCDE', i, 1) AS letter, (1 << (i - 1))::INT AS bit FROM range(1, 6) AS r(i)),
    p AS (SELECT '' AS prefix, 0 AS applied, 0 AS step, '' AS letter, 0 AS bit UNION ALL SELECT prefix || f.letter, applied + f.bit, step + 1, f.letter, f.bit FROM p JOIN f ON applied & f.bit = 0),
    s AS (SELECT part, prefix, step, letter, coalesce(sum(n) FILTER (mask & applied = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & (applied - bit) = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & bit > 0 AND mask & (applied - bit) > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & bit > 0 AND mask & (applied - bit) = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & (applied - bit) = 0), 0)::BIGINT AS toxic_lost
        FROM p JOIN c ON step > 0 GROUP BY 1, 2, 3, 4),
    o AS (SELECT part, o.prefix AS filter_order, s.step, s.letter, kept, removed, redundant, unique_fails, good_lost, toxic_lost FROM (SELECT prefix FROM p WHERE step = 5) o JOIN s ON starts_with(o.prefix, s.prefix))
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM o"""

#: A byte of a string, then eight steps of the polynomial.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"


def _new(state: str, cost: str, edit: str, line: str) -> str:
    """The state's sequence with one more edit and line; null if there is none or it isn't allowed."""
    return f"CASE WHEN {state}.c IS NOT NULL AND {cost} IS NOT NULL THEN {{'c': {state}.c + ({cost}), 'a': {state}.a || '{edit}', 't': {state}.t || {line}}} END"


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_KEEP = lambda initial: f"CASE WHEN NOT gone AND left(role, 1) = '{initial}' THEN more END"
_ROLE = "CASE WHEN NOT gone THEN 3 + more END"
_LINE = "chr(10) || role || ':' || text"
_OP13 = f"""WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
    y AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS again FROM x WHERE k > 0),
    z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM y),
    q AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad FROM z),
    h AS (SELECT conv_id, i, role, text, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM q),
    w AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s1, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s2, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS s3 FROM (SELECT DISTINCT conv_id FROM h)
        UNION ALL
        SELECT conv_id, i, {_new('s0', '4', 'D', "''")}, {_least(_new('s1', '4', 'D', "''"), _new('s0', _KEEP('s'), 'K', _LINE))},
            {_least(_new('u2', '4', 'D', "''"), *[_new(s, _KEEP('u'), 'K', _LINE) for s in ('s0', 's1', 'u3')], *[_new(s, _ROLE, 'R', f"{_USER} || text") for s in ('s0', 's1', 'u3')])},
            {_least(_new('u3', '4', 'D', "''"), _new('u2', _KEEP('a'), 'K', _LINE), _new('u2', _ROLE, 'R', f"{_ASSISTANT} || text"))}
        FROM (SELECT *, {_least('s3', _new('u2', '3', 'I', _ASSISTANT))} AS u3 FROM (SELECT h.*, s0, s1, s3, {_least('s2', *[_new(s, '3', 'I', _USER) for s in ('s0', 's1', 's3')])} AS u2 FROM w JOIN h ON w.conv_id IS NOT DISTINCT FROM h.conv_id AND h.i = w.i + 1))),
    e AS (SELECT conv_id, {_least('s0', 's3', _new('s2', '3', 'I', _ASSISTANT), _new('s1', '6', 'II', f"{_USER} || {_ASSISTANT}"))} AS b FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS last FROM w) WHERE i = last),
    n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM q GROUP BY 1)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON o.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""

SQL: dict[str, str] = {"op3_exact_dedup": _OP3, "op7_preference_format": _OP7, "op10_decontamination": _OP10, "op11_line_dedup": _OP11, "op12_filter_audit": _OP12, "op13_chat_repair": _OP13}
