"""SQL counterparts of the text operators' queries, where SQL can express them."""

# CRC-32 of the reversed polynomial 0xEDB88320, byte by byte with a table of 256 remainders. SQL names: ``crcs`` has
# the table as a list; CRC turns a list of bytes into the unsigned sum.
CRC_TABLE = """
        bits(b, k, c) AS (
            SELECT i, 0, i FROM range(256) r(i)
            UNION ALL
            SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
        crcs AS (SELECT list(c ORDER BY b) AS remainders FROM bits WHERE k = 8)"""
CRC = """xor(4294967295, list_reduce({bytes}, lambda acc, b:
            xor(acc >> 8, remainders[(xor(acc, b) & 255) + 1]), 4294967295))"""


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_DIGITS = "list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)"

# UTF-8 of letters up to U+00FF.
_UTF8 = """flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT]
            ELSE [192 + (ord(x) >> 6)::BIGINT, 128 + (ord(x) & 63)::BIGINT] END))"""
# kind, order, pattern, group that counts, its least length.
_PATTERNS = (
    ("assign", "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
     "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24),
    ("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", 0, 1), ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 25), ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 1),
)
# DuckDB takes a pattern as a constant only: one query for each rule.
_PER_RULE = " UNION ALL ".join(f"""
            SELECT doc_id, '{kind}' AS kind, {order} AS ord, {least} AS least, regexp_extract_all(t, '{pattern}') AS hits,
                   regexp_extract_all(t, '{pattern}', {part}) AS parts, string_split_regex(t, '{pattern}') AS gaps
            FROM docs WHERE regexp_matches(t, '{pattern}')""" for order, (kind, pattern, part, least) in enumerate(_PATTERNS, 1))

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                       'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        WINDOW same AS (PARTITION BY t)""",
    "op3_warc": """
        SELECT page_id, strlen(p) AS payload_bytes, sha256(p) AS payload_digest,
               CASE WHEN strlen(p) >= 100 AND row_number() OVER same > 1 THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN strlen(p) >= 100 AND row_number() OVER same > 1 THEN first_value(page_id) OVER same END
                   AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS p FROM pages)
        WINDOW same AS (PARTITION BY p ORDER BY page_id NULLS LAST)""",
    # Levels of all languages at once, then of their roots; siblings by position.
    "op11_merkle": f"""
        WITH RECURSIVE {CRC_TABLE},
        leaves AS (
            SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
                   CASE WHEN {CRC.format(bytes=_DIGITS)} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS tampered,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place
            FROM documents, crcs),
        levels(lang, level, place, node) AS (
            SELECT lang, 0, place, leaf FROM leaves
            UNION ALL
            SELECT lang, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place))
            FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM levels)
            WHERE n > 1 GROUP BY lang, level, place // 2),
        tops AS (SELECT lang, max(level) AS height FROM levels GROUP BY lang),
        ordered AS (
            SELECT t.lang, node AS subroot, height, row_number() OVER (ORDER BY t.lang NULLS FIRST) - 1 AS part
            FROM levels l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang AND level = height),
        upper_levels(level, place, node) AS (
            SELECT 0, part, subroot FROM ordered
            UNION ALL
            SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place))
            FROM (SELECT *, count(*) OVER () AS n FROM upper_levels) WHERE n > 1 GROUP BY level, place // 2),
        top AS (SELECT node AS root, level AS height FROM upper_levels ORDER BY level DESC LIMIT 1),
        steps AS (
            SELECT doc_id, s.level, s.place % 2 AS odd, coalesce(node, '') AS sibling
            FROM (SELECT doc_id, l.lang, k.level, l.place // (1 << k.level) AS place FROM leaves l
                  JOIN ordered o ON l.lang IS NOT DISTINCT FROM o.lang, range(o.height) k(level)) s
            LEFT JOIN levels n ON n.lang IS NOT DISTINCT FROM s.lang AND n.level = s.level AND n.place = xor(s.place, 1)
            UNION ALL
            SELECT doc_id, s.level + 1000, s.place % 2, coalesce(node, '')
            FROM (SELECT doc_id, k.level, o.part // (1 << k.level) AS place FROM leaves l
                  JOIN ordered o ON l.lang IS NOT DISTINCT FROM o.lang, top, range(top.height) k(level)) s
            LEFT JOIN upper_levels n ON n.level = s.level AND n.place = xor(s.place, 1)),
        proofs AS (
            SELECT doc_id, string_agg(sibling, '' ORDER BY level) AS siblings,
                   list([odd::VARCHAR, sibling] ORDER BY level) AS path
            FROM steps GROUP BY doc_id),
        folded AS (
            SELECT l.doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
                   list_reduce(coalesce(path, []), lambda acc, s: [CASE WHEN s[1] = '1'
                       THEN sha256(s[2] || acc[1]) ELSE sha256(acc[1] || s[2]) END],
                       [coalesce(tampered, leaf)])[1] AS folded_root
            FROM leaves l JOIN ordered o ON l.lang IS NOT DISTINCT FROM o.lang, top
            LEFT JOIN proofs p ON p.doc_id = l.doc_id)
        SELECT *, folded_root = root AS verified FROM folded""",
    # Words one edit apart share what is left when one letter of the longer, or the same letter of both, is taken out.
    "op12_spelling": f"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        counted AS (
            SELECT doc_id, run, count(*) AS k, coalesce(doc_id::VARCHAR, '') || ':' || run AS named FROM runs GROUP BY ALL),
        summed AS (SELECT run, k, {CRC.format(bytes=_UTF8.format(text="named"))} AS h FROM counted, crcs),
        damaged AS (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
                        ELSE run END AS word, k FROM summed),
        words AS (
            SELECT word, sum(k)::BIGINT AS n FROM damaged GROUP BY word HAVING length(word) >= 6 AND sum(k) >= 5),
        cuts AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        pairs AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
            UNION
            SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON b.word = a.rest
            UNION
            SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON b.word = a.rest),
        best AS (
            SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n
            FROM pairs GROUP BY word),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
                   CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
            FROM words w LEFT JOIN best USING (word)),
        chains(word, last) AS (
            SELECT word, word FROM forms
            UNION ALL
            SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word
        JOIN forms e ON e.word = c.last WHERE e.form IS NULL""",
    # The text is split at the matches; lengths up to a match give its place.
    "op13_secrets": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        cut AS ({_PER_RULE}),
        matches AS (
            SELECT doc_id, kind, ord, least, unnest(range(1, len(hits) + 1)) AS i, hits, parts, gaps FROM cut),
        placed AS (
            SELECT doc_id, kind, ord, least, length(parts[i]) AS counted, length(hits[i]) AS size,
                   sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
            FROM matches),
        spans AS (
            SELECT doc_id, kind, ord, (stop - size)::BIGINT AS start, kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span
            FROM placed WHERE counted >= least),
        joined AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, ord) AS spans,
                   string_agg(span, ',' ORDER BY start, ord) FILTER (ord <= 3) AS base
            FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN joined USING (doc_id)""",
}
