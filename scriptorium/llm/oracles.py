"""SQL that computes the same rows as the queries which SQL can express.

Left out: fingerprints by XXH64 or XXH3 (1, 6), merges of a tokenizer (2, 5) and a trained model (10). The tests hold
those against brute force, the public libraries or held-out pages.
"""

from __future__ import annotations

from scriptorium.llm.pii import CHARS_AFTER, CHARS_BEFORE, CONTEXT_GAIN, IBAN, KEY, KINDS, THRESHOLD
from scriptorium.llm.quality_rules import BOILERPLATE
from scriptorium.llm.url_filter import AD_HOSTS, HOST_PARTS, HOST_WORDS, PAGE_WORDS

_FITS = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))"

URL_FILTER = f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
j AS (SELECT *, CASE WHEN {_FITS.format('www.example.com', '/en/')} THEN 'www.example.com/en/' WHEN {_FITS.format('example.com', '/en/')} THEN 'example.com/en/'
  WHEN {_FITS.format('net', '/es/')} THEN 'net/es/' WHEN {_FITS.format('net', '/fr/')} THEN 'net/fr/' WHEN {_FITS.format('com', '/')} THEN 'com/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host, '(^|[^a-z0-9])({'|'.join(HOST_WORDS)})([^a-z0-9]|$)') OR regexp_matches(host, '{'|'.join(HOST_PARTS)}') OR regexp_matches(host, '(^|\\.)({'|'.join(AD_HOSTS)})\\.')
    OR regexp_matches(path, '(?i)/({'|'.join(PAGE_WORDS)}|wp-admin)([/.]|$)') THEN 'block' ELSE 'allow' END AS verdict FROM j"""

_WS = r"[\x20\x09-\x0D]"
QUALITY_RULES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '{_WS}+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rid, i, concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
t AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM t, range(5) AS s(k) GROUP BY 1),
l AS (SELECT rid, line, list_filter(string_split_regex(line, '{_WS}+'), lambda x: x <> '') AS lw FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
f AS (SELECT rid, line, len(lw) AS n, (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) AS sym, len(regexp_extract_all(line, '!!')) AS shout,
  len(regexp_extract_all(line, '[|»›•·]')) AS sep, regexp_matches(line, '(?i){'|'.join(BOILERPLATE)}') AS boiler,
  regexp_matches(line, '[.!?…。！？:;]["'')\\]”’»]*{_WS}*$') AS closed FROM l),
k AS (SELECT rid, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
  coalesce(sum(n) FILTER (n = 0 OR NOT ((n >= 3 AND sym > n * 0.3) OR (n >= 3 AND shout > n * 0.3) OR (sep >= 3 AND sep > n * 0.25) OR (n <= 20 AND boiler) OR (n < 3 AND NOT closed))), 0) AS stay FROM f GROUP BY 1),
m AS (SELECT w.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, stay
  FROM w JOIN k USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - stay <= n_words * 0.5 AS kept FROM b"""

CHAT_FORMATTING = """WITH t AS (SELECT DISTINCT conv_id, turn, role, text, concat('<|im_start|>', coalesce(role, 'unknown'), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)) AS line FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(line ORDER BY turn, role, text) AS l FROM t GROUP BY 1),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
s AS (SELECT min(conv_id) AS conv_id, len(l) AS n_turns, count(*) AS n_copies, array_to_string(l, '') AS chat FROM c WHERE l NOT IN (SELECT l FROM p) GROUP BY l)
SELECT conv_id, n_turns, n_copies, chat FROM s"""

MIXING = """WITH n AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS aim FROM documents GROUP BY 1),
r AS (SELECT source, aim * ((SELECT sum(n) FROM n) / (SELECT sum(aim) FROM n)) / n AS rate FROM n),
k AS (SELECT source, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS step FROM (SELECT *, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 24) AS BIGINT) + 1)) AS k FROM r)),
u AS (SELECT *, (list_reduce(list_transform(string_split(substr(md5(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13), ''), lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: a * 16 + b) + 0.5) / 4503599627370496 AS draw FROM documents),
c AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(step) AS copies FROM u JOIN k ON u.source IS NOT DISTINCT FROM k.source AND step < draw GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy_no FROM c"""


#: The patterns as the contract writes them; the operator's own are possessive and look behind.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": IBAN,
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "secret": "[A-Za-z0-9+/_-]{32,}",
    "key": KEY,
    "private_key": r"-----BEGIN (?:[A-Z0-9]+ )?PRIVATE KEY-----[A-Za-z0-9+/=:,\s]*-----END (?:[A-Z0-9]+ )?PRIVATE KEY-----",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"(SELECT sum(CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN d WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END) FROM (SELECT unnest(range(1, length({_DIGITS}) + 1)) AS i, CAST(unnest(string_split({_DIGITS}, '')) AS INTEGER) AS d)) % 10 = 0"
_TURNED = "concat(substr(replace(v, ' ', ''), 5), substr(replace(v, ' ', ''), 1, 4))"
_MOD97 = f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({_TURNED}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: CASE WHEN c < 65 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"
_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(v, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 WHEN ltrim(p, '0') = '' THEN 0 ELSE CAST(ltrim(p, '0') AS INTEGER) END)) <= 255",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": _MOD97,
    "ssn": "NOT regexp_matches(v, '^(?:000|666|9[0-9]{2})|-00-|-0000$')",
    "secret": "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')",
    "key": "true",
    "private_key": "true",
}


def _kind_sql(order: int, name: str) -> str:
    kind = next(k for k in KINDS if k.name == name)
    quote = lambda pattern: pattern.replace("'", "''")
    side = lambda start, end: f"substr(text, CAST({start} AS BIGINT) + 1, CAST({end} AS BIGINT) - CAST({start} AS BIGINT))"
    any_of = lambda tests: " OR ".join(f"regexp_matches({text}, '{quote(p)}')" for text, p in tests if p) or "false"
    before, after = side(f"greatest(s - {CHARS_BEFORE}, 0)", "s"), side("s + length(v)", f"s + length(v) + {CHARS_AFTER}")
    gain = f"CASE WHEN {{}} THEN {CONTEXT_GAIN}::DOUBLE ELSE 0 END"
    score = f"{kind.score}::DOUBLE + {gain.format(any_of([(before, kind.before), (after, kind.after)]))} - {gain.format(any_of([(before, kind.against), (after, kind.against)]))}"
    told = "true" if kind.base else f"{score} >= {THRESHOLD}"
    free = f"NOT ({any_of([(side('greatest(s - 1, 0)', 's'), kind.edge), (side('s + length(v)', 's + length(v) + 1'), kind.edge)])})"
    return f"""SELECT rid, {order} AS o, '{name}' AS kind, CAST(s AS BIGINT) AS s, CAST(s + length(v) AS BIGINT) AS e FROM (
  SELECT rid, text, v, sum(length(g)) OVER (PARTITION BY rid ORDER BY n) + coalesce(sum(length(v)) OVER (PARTITION BY rid ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (
    SELECT rid, text, generate_subscripts(m, 1) AS n, unnest(m) AS v, unnest(p[1:len(m)]) AS g FROM (
      SELECT rid, text, regexp_extract_all(text, '{quote(_PATTERNS[name])}') AS m, string_split_regex(text, '{quote(_PATTERNS[name])}') AS p FROM d WHERE regexp_matches(text, '{quote(_PATTERNS[name])}')))) WHERE {_VALID[name]} AND {free} AND {told}"""


PII = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), x AS ({' UNION ALL '.join(_kind_sql(i, n) for i, n in enumerate(_PATTERNS))}),
a AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('email', 'ip', 'card', 'phone'))},
  string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, o) FILTER (o < 4) AS base, string_agg(concat_ws(':', kind, s, e), ',' ORDER BY s, o) AS spans FROM x GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_pii": PII,
        "op4_url_filter": URL_FILTER,
        "op7_quality_rules": QUALITY_RULES,
        "op8_chat_formatting": CHAT_FORMATTING,
        "op9_mixing": MIXING,
    }
