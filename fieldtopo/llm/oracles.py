"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from . import line_dedup as L
from .pii import BASE_KINDS, BASE_SCORE, CONTEXT, CONTEXT_BONUS, IBAN_ENDS, KINDS, THRESHOLD, WINDOW
from .warc import DATE, ENTITIES, NUMERIC, SPACE_RULES, tag_rules

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The published patterns as they stand; RE2 needs no other form of them.
_PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": r"[A-Za-z0-9+/_-]{20,}",
}
_DIGITS = "translate(m, ' +().-', '')"
_PII_CHECKS = {
    "email": "true",
    "ip": "list_bool_and([len(ltrim(p, '0')) <= 3 AND (CASE WHEN ltrim(p, '0') = '' THEN 0 ELSE CAST(left(ltrim(p, '0'), 4) AS INT) END) <= 255 FOR p IN string_split(m, '.')])",
    "card": f"len({_DIGITS}) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (len({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INT) WHEN CAST({_DIGITS}[i] AS INT) > 4 THEN 2 * CAST({_DIGITS}[i] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[i] AS INT) END FOR i IN range(1, len({_DIGITS}) + 1)]) % 10 = 0",
    "phone": f"len({_DIGITS}) BETWEEN 9 AND 15",
    "ssn": "true",
    "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '[/_-]{3}')",
}
_IBAN = "len(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce([CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT) FOR c IN list_concat([CAST(0 AS VARCHAR)], string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], ''))], lambda a, b: (CASE WHEN b < 10 THEN a * 10 + b ELSE a * 100 + b END) % 97) = 1"
_PII_PARTS = "\n  UNION ALL ".join(
    f"""SELECT rid, {i} AS rank, '{k}' AS kind, {BASE_SCORE[k]} AS base, '{CONTEXT[k]}' AS context, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(list_slice(string_split_regex(t, '{p}'), 1, len(regexp_extract_all(t, '{p}')))) AS gap, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d"""
    for i, (k, p) in enumerate(_PII_PATTERNS.items())
)
_PII_VALID = " ".join(f"WHEN kind = '{k}' THEN {v}" for k, v in _PII_CHECKS.items())
_TRIES = ["m" if not end else f"regexp_replace(m, '{end}', '')" for end in IBAN_ENDS]
_PII_FOUND = "CASE WHEN kind <> 'iban' THEN m " + " ".join(f"WHEN {_IBAN.replace('(m, ', f'({t}, ')} THEN {t}" for t in _TRIES) + " END"
_BASE = ", ".join(f"'{k}'" for k in BASE_KINDS)
OP2 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({_PII_PARTS}),
whole AS (SELECT *, CAST(sum(len(gap) + len(m)) OVER w AS BIGINT) - len(m) AS start FROM raw WINDOW w AS (PARTITION BY rid, kind ORDER BY i ROWS UNBOUNDED PRECEDING)),
placed AS (SELECT * REPLACE (found AS m), start + len(found) AS stop FROM (SELECT *, {_PII_FOUND} AS found FROM whole) WHERE found IS NOT NULL),
ok AS (SELECT p.rid, kind, rank, start, stop, base + CASE WHEN regexp_matches(substring(d.t, greatest(start - {WINDOW} + 1, 1), least(start, {WINDOW})), context) THEN {CONTEXT_BONUS} ELSE 0 END AS score
  FROM placed p JOIN d USING (rid) WHERE CASE {_PII_VALID} ELSE true END),
kept AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM ok WHERE kind IN ({_BASE}) OR score >= {THRESHOLD}),
agg AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)}, coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (kind IN ({_BASE})), '') AS base_spans, string_agg(span, ',' ORDER BY start, rank) AS spans, count(*) AS n_spans FROM kept GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN agg USING (rid)"""
assert tuple(_PII_PATTERNS) == KINDS

_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
dw AS (SELECT rid, l, i, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
h AS (SELECT rid, l, i, item_id FROM dw JOIN win USING (l, win)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)"""

_TOKENS = r"[x FOR x IN string_split_regex(" + _LOWER.format("coalesce(text, '')") + r", '[\x20\x09-\x0D]+') IF x <> '']"
OP4 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM d),
e AS (SELECT rid, len(g) AS n, unnest(g) AS g FROM s),
pairs AS (SELECT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
reach(a, b) AS (SELECT rid, rid FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id FROM s JOIN (SELECT r.a, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.rid = r.b GROUP BY r.a) c ON c.a = s.rid"""

OP5 = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(expr: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        expr = f"regexp_replace({expr}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    return expr


_BARE = _replaced("payload", tag_rules(r"""(?:[^'">]|"[^"]*"|'[^']*')*"""))
_NUMBER = "CASE WHEN lower(r[3]) = 'x' THEN CAST('0x' || r[4:len(r) - 1] AS BIGINT) ELSE CAST(r[3:len(r) - 1] AS BIGINT) END"
_CHAR = f"CASE WHEN {_NUMBER} = 160 THEN ' ' WHEN {_NUMBER} BETWEEN 1 AND 1114111 AND NOT {_NUMBER} BETWEEN 55296 AND 57343 THEN chr(CAST({_NUMBER} AS INT)) ELSE chr(65533) END"
_RESOLVED = f"array_to_string([g || coalesce(c, '') FOR (g, c) IN list_zip(string_split_regex(bare, '{NUMERIC}'), [{_CHAR} FOR r IN regexp_extract_all(bare, '{NUMERIC}')])], '')"
_RESOLVED = _RESOLVED.replace("[g || coalesce(c, '') FOR (g, c) IN list_zip(", "list_transform(list_zip(").replace(")], '')", "), lambda z: z[1] || coalesce(z[2], '')), '')")
_NAMED = "resolved"
for _name, _by in ENTITIES.items():
    _NAMED = f"replace({_NAMED}, '&{_name};', {_quoted(_by)})"
_TEXT = _replaced(_NAMED, SPACE_RULES)
_CRLF = "(chr(13) || chr(10))"


def _uuid(expr: str) -> str:
    return f"('<urn:uuid:' || substring(md5({expr}), 1, 8) || '-' || substring(md5({expr}), 9, 4) || '-' || substring(md5({expr}), 13, 4) || '-' || substring(md5({expr}), 17, 4) || '-' || substring(md5({expr}), 21, 12) || '>')"


_TITLE = r"trim(regexp_extract(payload, '(?is)<title[^>]*>([^<]*)</title>', 1))"
OP7 = f"""WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS uri, coalesce(html, '') AS payload, 'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || {_CRLF} || {_CRLF} AS http FROM pages),
s AS (SELECT *, {_uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || uri || '|sha1:' || sha1(http || payload)")} AS refers_to, 'sha1:' || sha1(payload) AS payload_digest, 'sha1:' || sha1(http || payload) AS source_digest, {_BARE} AS bare FROM p),
t AS (SELECT *, {_RESOLVED} AS resolved FROM s),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS mime, 'source-block-digest: ' || source_digest || {_CRLF} || 'source-payload-digest: ' || payload_digest || {_CRLF} || 'source-content-length: ' || octet_length(encode(http || payload)) || {_CRLF} || array_to_string(['source-http: ' || x FOR x IN string_split(rtrim(http, {_CRLF}), {_CRLF})], {_CRLF}) || {_CRLF} || 'title: ' || regexp_replace({_TITLE}, '[\\r\\n]+', ' ', 'g') || {_CRLF} AS block FROM t
  UNION ALL SELECT *, 'conversion', 'text/plain', {_TEXT} FROM t),
r AS (SELECT *, {_uuid("record_type || '|' || refers_to")} AS record_id, 'sha1:' || sha1(block) AS block_digest FROM b)
SELECT page_id, record_type, record_id, refers_to, uri, block_digest, CAST(octet_length(encode(block)) AS BIGINT) AS n_bytes,
  sha256('WARC/1.0' || {_CRLF} || 'WARC-Type: ' || record_type || {_CRLF} || 'WARC-Record-ID: ' || record_id || {_CRLF} || 'WARC-Refers-To: ' || refers_to || {_CRLF} || 'WARC-Target-URI: ' || uri || {_CRLF} || 'WARC-Date: {DATE}' || {_CRLF} || 'WARC-Block-Digest: ' || block_digest || {_CRLF} || 'Content-Type: ' || mime || {_CRLF} || 'Content-Length: ' || octet_length(encode(block)) || {_CRLF} || {_CRLF} || block || {_CRLF} || {_CRLF}) AS record_sha256 FROM r"""

_RARE = f"CASE WHEN n >= {L.LONG} THEN 2 ELSE {L.MIN_DOCS} END"
_SHORT = " ".join(f"WHEN n = {n} THEN {most}" for n, most in L.SHORT_DOCS.items())
_AT = "PARTITION BY rid ORDER BY"
OP10 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, {L.NO_ID}) AS did, text FROM documents),
raw AS (SELECT rid, did, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM d WHERE text IS NOT NULL),
cut AS (SELECT rid, did, line_no, string_split_regex(regexp_replace(regexp_replace(line, '[^ \\t\\r\\f\\x0B]*[0-9][^ \\t\\r\\f\\x0B]*', '<*>', 'g'), '^[ \\t\\r\\f\\x0B]+|[ \\t\\r\\f\\x0B]+$', '', 'g'), '[ \\t\\r\\f\\x0B]+') AS w FROM raw),
l AS (SELECT *, len(w) AS n, w[1:{L.DEPTH}] AS lead FROM cut WHERE w[1] <> ''),
c AS (SELECT n, lead, w, count(DISTINCT did) AS n_docs, min(did) AS first FROM l GROUP BY ALL),
same_line AS (SELECT n, lead, w, first FROM c WHERE n_docs >= CASE WHEN n >= {L.MIN_TOKENS} THEN {_RARE} {_SHORT} END AND (n >= {L.MIN_TOKENS} OR len([t FOR t IN w IF t <> '<*>']) > 0)),
leaves AS (SELECT n, lead FROM c WHERE n >= {L.MIN_TOKENS} GROUP BY ALL HAVING count(*) > 1 AND sum(n_docs) > 1),
peers AS (SELECT c.*, len([t FOR t IN lead IF t <> '<*>']) AS fixed_lead FROM c JOIN leaves USING (n, lead)),
cells AS (SELECT * FROM (SELECT *, unnest(range(n)) AS pos, unnest(w) AS token FROM peers) WHERE pos >= {L.DEPTH}),
votes AS (SELECT n, lead, pos, token, sum(n_docs) AS weight FROM cells GROUP BY ALL),
modal AS (SELECT n, lead, pos, token AS modal FROM votes WHERE n >= {L.GENERAL} QUALIFY row_number() OVER (PARTITION BY n, lead, pos ORDER BY weight DESC, token DESC) = 1),
agree AS (SELECT n, lead, w FROM cells JOIN modal USING (n, lead, pos) GROUP BY ALL HAVING sum(CASE WHEN token = modal THEN 1 ELSE 0 END) >= {L.SIMILAR} * count(*)),
held AS (SELECT n, lead, count(DISTINCT did) AS n_docs, min(did) AS first FROM l JOIN agree USING (n, lead, w) GROUP BY ALL),
own AS (SELECT n, lead, w, fixed_lead, n_docs, first, list({{'p': pos, 't': token}} ORDER BY pos) AS sig FROM cells JOIN votes USING (n, lead, pos, token) WHERE weight >= {_RARE} GROUP BY ALL),
sigs AS (SELECT * FROM own
  UNION ALL SELECT n, lead, w, fixed_lead, n_docs, first, list_filter(sig, lambda x: x.p <> gap) FROM (SELECT *, unnest([x.p FOR x IN sig]) AS gap FROM own)
  UNION ALL SELECT n, lead, w, fixed_lead, n_docs, first, [] FROM peers WHERE n < {L.GENERAL} AND NOT EXISTS (SELECT 1 FROM own WHERE own.n = peers.n AND own.w = peers.w)),
sized AS (SELECT *, len(sig) AS same, len([x FOR x IN sig IF x.t <> '<*>']) + fixed_lead AS words FROM sigs),
signed AS (SELECT *, CASE WHEN n >= {L.GENERAL} THEN {_RARE} ELSE greatest({L.MIN_DOCS}, {L.MIN_DOCS + L.FEW_WORDS} - words) END AS need FROM sized WHERE CASE WHEN n >= {L.GENERAL} THEN same >= {L.SIMILAR} * (n - {L.DEPTH}) ELSE words >= {L.SIMILAR} * n END),
kinds AS (SELECT n, lead, sig, max(need) AS need, min(first) AS first FROM signed GROUP BY ALL HAVING count(*) > 1),
docs_of AS (SELECT s.n, s.lead, s.sig, count(DISTINCT l.did) AS n_docs FROM signed s JOIN l ON l.n = s.n AND l.w = s.w GROUP BY ALL),
fields AS (SELECT s.n, s.lead, s.w, k.first FROM signed s JOIN kinds k ON k.n = s.n AND k.lead = s.lead AND k.sig = s.sig JOIN docs_of q ON q.n = s.n AND q.lead = s.lead AND q.sig = s.sig WHERE q.n_docs >= k.need),
rec AS (SELECT n, lead, w, min(first) AS first FROM (SELECT * FROM same_line UNION ALL SELECT n, lead, w, first FROM agree JOIN held USING (n, lead) WHERE n_docs >= {_RARE} UNION ALL SELECT * FROM fields) GROUP BY ALL),
line AS (SELECT *, CAST(sum(n) OVER ({_AT} line_no) AS BIGINT) AS stop, CAST(sum(n) OVER ({_AT} line_no) AS BIGINT) - n AS start FROM l),
runs AS (SELECT rid, did, list(w) OVER a AS passage, sum(n) OVER a AS size, min(line_no) OVER a AS low, max(line_no) OVER a AS high FROM line WINDOW a AS ({_AT} start RANGE BETWEEN CURRENT ROW AND {L.LONG - 1} FOLLOWING)
  UNION ALL SELECT rid, did, list(w) OVER b, sum(n) OVER b, min(line_no) OVER b, max(line_no) OVER b FROM line WINDOW b AS ({_AT} stop RANGE BETWEEN {L.LONG - 1} PRECEDING AND CURRENT ROW)),
shared AS (SELECT passage, min(did) AS first FROM runs WHERE size >= {L.LONG} GROUP BY ALL HAVING min(did) <> max(did)),
gone AS (SELECT l.rid, line_no FROM l JOIN rec USING (n, lead, w) WHERE l.did > rec.first
  UNION SELECT rid, unnest(range(low, high + 1)) AS line_no FROM runs JOIN shared USING (passage) WHERE size >= {L.LONG} AND did > first),
kept AS (SELECT r.rid, string_agg(line, chr(10) ORDER BY r.line_no) AS text FROM raw r LEFT JOIN gone g ON g.rid = r.rid AND g.line_no = r.line_no WHERE g.rid IS NULL GROUP BY r.rid),
n AS (SELECT r.rid, count(*) AS n_lines, count(g.rid) AS n_dropped FROM raw r LEFT JOIN gone g ON g.rid = r.rid AND g.line_no = r.line_no GROUP BY r.rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)"""

ORACLES: dict[str, str] = {"op2_pii_spans": OP2, "op3_decontaminate": OP3, "op4_jaccard_join": OP4, "op5_top_k": OP5, "op7_warc_derivatives": OP7, "op10_line_dedup": OP10}
