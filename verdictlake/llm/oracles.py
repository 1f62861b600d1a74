"""SQL of the corpus operators that DuckDB can express over whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id"""

OP3 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT *, list_reduce(list_transform(string_split(sha1(h), ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), lambda x, y: x || y) AS bits, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, list_reduce(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT, 1)), lambda x, y: x || y) AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b"""

# Articles of these pages hold only h1, p, b and br, and of character references the five of XML.
OP5 = """WITH a AS (SELECT page_id, url, string_split_regex(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g'), '</?p>|</?h1>') AS parts FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM a)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""


def _spans(kind: str, pattern: str, keep: str) -> tuple[str, str]:
    """SQL for a pattern's matches with their places, from what lies between them; and the condition that they have to hold."""
    return f"""SELECT doc_id, '{kind}' AS k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'v': m[i]}})) AS x
FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS m FROM documents WHERE regexp_matches(text, '{pattern}')) WHERE TRUE""", keep


_ASSIGN = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+"
_VALUE = "^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$"
_ALLOWED = "(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9/_=+-]+|[a-z]+(?:[-_/=+][a-z]+)*[-_/=+]*|.*example.*|[=_/+-]+)$"
_PARTS = [_spans("assign", _ASSIGN, f"length(regexp_extract(v, '{_VALUE}', 1)) >= 6"), _spans("access", "AKIA[A-Z0-9]+", "length(v) >= 20"), _spans("hex", "[0-9a-f]{24,}", "length(v) >= 24"), _spans("entropy", "[A-Za-z0-9+/_=-]{20,}", f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{_ALLOWED}')")]

OP4 = f"""WITH found AS ({' UNION ALL '.join(f"SELECT doc_id, k, x.s AS s, x.s + length(x.v) AS e, x.v AS v, {o} AS o FROM ({sql})" for o, (sql, _) in enumerate(_PARTS))}),
base AS (SELECT * FROM found WHERE {' OR '.join(f"(o = {o} AND {keep})" for o, (_, keep) in enumerate(_PARTS[:3]))}),
cand AS (SELECT c.* FROM found c WHERE o = 3 AND {_PARTS[3][1]} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
extra AS (SELECT * FROM cand WHERE list_max(list_transform(range(1, length(v) - 18), lambda i: list_aggregate(string_split(substring(v, i, 20), ''), 'entropy'))) >= CASE WHEN regexp_matches(v, '^[0-9a-fA-F]+$') THEN 3.0 WHEN regexp_matches(v, '^[A-Za-z0-9]+$') THEN 3.7 ELSE 3.9 END),
b AS (SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access, count(*) FILTER (WHERE o = 2) AS n_hex, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS t FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, o) AS t FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.t, '')) AS base_sha256, coalesce(a.t, '') AS spans FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN a ON a.doc_id = d.doc_id"""

SQL = {"op2_ngram_components": OP2, "op3_warc_normalise": OP3, "op4_secret_entropy": OP4, "op5_site_template": OP5}
