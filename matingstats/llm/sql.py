"""DuckDB SQL of the queries ``opN_<name>`` that SQL can express.

Left out: op3 and op12 (learnt models), op5 (XXH64 and components), op8 and op9 (merges of a tokenizer); these
are tested against brute force, a round trip and held-out labels.
"""

from __future__ import annotations

from matingstats.llm import host_reputation, secret_scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({_lower(f'coalesce({text}, {chr(39) * 2})')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_OP1 = f"""
WITH b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(part) AS n, array_to_string(part, ' ') AS key
       FROM (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w]
             ELSE list_transform(range(len(w) - 12), lambda i: w[i + 1:i + 13]) END) AS part FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
win AS (SELECT doc_id, n, unnest(range(greatest(len(w) - n + 1, 0))) AS p, w FROM d, sizes),
dw AS (SELECT doc_id, n, p, array_to_string(w[p + 1:p + n], ' ') AS key FROM win),
hit AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, key)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

_OP2 = """
WITH n AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(b) AS n FROM documents),
w AS (SELECT doc_id, p, md5(array_slice(b, p + 1, p + 200)) AS k FROM (SELECT doc_id, b, unnest(range(greatest(n - 199, 0))) AS p FROM n)),
often AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, p FROM w SEMI JOIN often USING (k)),
g AS (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS run
      FROM (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 200, true) AS fresh FROM r)),
s AS (SELECT doc_id, run, min(p) AS s, max(p) + 200 AS e FROM g GROUP BY ALL),
gaps AS (SELECT doc_id, s AS upto, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS begin FROM s
         UNION ALL SELECT doc_id, n AS upto, coalesce((SELECT max(e) FROM s WHERE s.doc_id = n.doc_id), 0) AS begin FROM n),
kept AS (SELECT doc_id, string_agg(hex(array_slice(b, begin + 1, upto)), '' ORDER BY begin) AS k FROM gaps JOIN n USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM s GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)"""


def _op4() -> str:
    rules = secret_scan.RULES
    each = []
    for k, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        each.append(f"""SELECT doc_id, {k} AS rule, '{r.kind}' AS kind, {str(r.base).lower()} AS base, len(m) AS n, len(g) AS gn,
            sum(len(b) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS "end"
            FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {r.group})) AS g,
                         unnest(list_slice(string_split_regex(t, '{p}'), 1, len(regexp_extract_all(t, '{p}')))) AS b,
                         unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM d WHERE regexp_matches(t, '{p}'))
            QUALIFY len(g) >= {r.least}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    own = "concat(kind, ':', \"end\" - n, ':', \"end\")"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(each)}),
a AS (SELECT doc_id, {counts}, string_agg({own}, ',' ORDER BY "end" - n, rule) AS spans,
             string_agg({own}, ',' ORDER BY "end" - n, rule) FILTER (base) AS based FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')"


_OP6 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(20 + length({_escaped('role')}) + length({_escaped('text')})) AS n FROM t GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(n AS BIGINT) AS formatted_chars FROM a"""

_OP7 = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_lower("coalesce(text, '')")} AS t FROM documents) WINDOW g AS (PARTITION BY t)"""


def _shrunk(level: str, prior: str) -> str:
    """The posterior of a level (columns n, bad) around the column ``prior`` of a joined parent."""
    return f"""(SELECT *, s * m + bad AS a, s * (1 - m) + n - bad AS b FROM (SELECT *, least(greatest({prior}, 1e-6), 1 - 1e-6) AS m FROM {level}),
        (SELECT CASE WHEN over IS NULL OR base <= 0 OR over <= 0 THEN 50.0 ELSE least(50.0, greatest(1.0, base / over - 1)) END AS s FROM
          (SELECT sum(n * (pow(bad / n - m, 2) - m * (1 - m) / n)) AS over, sum(n * m * (1 - m) * (1 - 1 / n)) AS base
           FROM (SELECT *, least(greatest({prior}, 1e-6), 1 - 1e-6) AS m FROM {level}) WHERE n > 0)))"""


def _beta_below(x: float) -> str:
    """I_x(a, b) of columns a, b: the continued fraction from its end, by whichever side converges."""
    def side(x, a, b):
        term = (f"CASE WHEN k % 2 = 1 THEN -({a} + (k - 1) / 2) * ({a} + {b} + (k - 1) / 2) ELSE (k / 2) * ({b} - k / 2) END "
                f"* {x} / (({a} + k - 1) * ({a} + k))")
        return (f"exp({a} * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a} / "
                f"list_reduce(list_concat([1.0::DOUBLE], list_transform(range(CAST(60 + 4 * sqrt({a} + {b}) AS BIGINT), 0, -1), lambda k: k::DOUBLE)), "
                f"lambda t, k: 1 + {term} / t)")
    return f"CASE WHEN {x} < (a + 1) / (a + b + 2) THEN {side(x, 'a', 'b')} ELSE 1 - {side(1 - x, 'b', 'a')} END"


_BARE = r"regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.+$', '')"
_LABELS = f"CASE WHEN regexp_full_match({_BARE}, '(?:.*\\.)?(?:{'|'.join(host_reputation.SECOND_LEVEL)})\\.[a-z][a-z]') THEN 2 ELSE 1 END"

_OP10 = rf"""
WITH p AS (SELECT page_id, {_lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id AS page_id, max(CAST(1 - quality AS DOUBLE)) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
hb AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, coalesce(sum(bad), 0) AS bad, {_BARE} AS bare, {_LABELS} AS k FROM p LEFT JOIN l USING (page_id) GROUP BY host),
h AS (SELECT host, n, bad, CASE WHEN address THEN bare ELSE array_to_string(list_slice(string_split(bare, '.'), -k - 1, -1), '.') END AS domain,
             CASE WHEN address THEN '(address)' ELSE array_to_string(list_slice(string_split(bare, '.'), -k, -1), '.') END AS suffix
      FROM (SELECT *, regexp_full_match(bare, '[0-9]+([.][0-9]+){{3}}|\[.*\]') AS address FROM hb)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT coalesce((sum(bad) + 1) / (sum(n) + 2), 0.5) FROM d) AS whole FROM d GROUP BY 1),
xm AS (SELECT suffix, a / (a + b) AS sm FROM {_shrunk('x', 'whole')}),
dj AS (SELECT * FROM d JOIN xm USING (suffix)),
dm AS (SELECT domain, a / (a + b) AS dm FROM {_shrunk('dj', 'sm')}),
hj AS (SELECT * FROM h JOIN dm USING (domain)),
hp AS (SELECT host, a / (a + b) > 0.5 AND {_beta_below(0.5)} < 0.05 AS sure FROM {_shrunk('hj', 'dm')}),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS r(v, rh, rp)),
f AS (SELECT DISTINCT page_id, host, path, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(v, len(rh || rp)) AS v
      FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN sure THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN hp USING (host) LEFT JOIN f USING (page_id, host, path)"""

# CRC-32 of the decimal id by bits; pairs of equal strings of 8 words one period apart, joined to islands, are the runs
_OP11 = r"""
WITH h AS (SELECT doc_id, text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(8 * len(s)),
             lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substring(s, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT) ELSE CAST(0 AS BIGINT) END)),
             lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295) AS h
           FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
o AS (SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM h),
a AS (SELECT *, g % len(w) AS a, 1 + (len(w) - g % len(w)) // (3 + g % 8) AS p FROM o),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS BIGINT) + 1])
      ELSE w END AS w FROM a),
e AS (SELECT doc_id, unnest(range(greatest(len(w) - 7, 0))) AS i, w FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 8], ' ') AS k FROM e),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
isles AS (SELECT doc_id, q, min(i) AS s, count(*) + q + 7 AS n FROM
          (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs) GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, s, n, min(q) AS q FROM isles WHERE n >= 24 AND n >= 3 * q GROUP BY doc_id, s, n),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed, list({'s': s + q, 'e': s + n}) AS gone FROM runs GROUP BY doc_id),
best AS (SELECT r.* FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs t WHERE t.doc_id = r.doc_id
         AND (t.n * r.q > r.n * t.q OR t.n * r.q = r.n * t.q AND (t.s < r.s OR t.s = r.s AND t.q < r.q))))
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(n AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * n // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(len(w)),
              lambda i: len(list_filter(gone, lambda r: i >= r.s AND i < r.e)) = 0), lambda i: w[i + 1]), ' ') END) AS collapsed_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id)"""

_OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(greatest(CAST(len(w) AS BIGINT) - m + 1, 0)), lambda i: array_to_string(w[i + 1:i + m], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3]) AS m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS v, f AS a FROM f WHERE m > 1 AND f >= 10),
cuts AS (SELECT c.*, k, array_to_string(v[:k], ' ') AS x, array_to_string(v[k + 1:], ' ') AS y FROM c, (SELECT unnest([1, 2]) AS k) WHERE k < m),
scored AS (SELECT cuts.*, fx.f AS l, fy.f AS r, CAST(1000000 AS HUGEINT) * a * a // (CAST(fx.f AS HUGEINT) * fy.f) AS score
           FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
one AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(v[1:2], ' '), array_to_string(v[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY ALL),
kept AS (SELECT one.* FROM one LEFT JOIN longer ON longer.lang = one.lang AND longer.phrase = one.phrase AND m = 2 WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

SQL: dict[str, str] = {
    "op1_decontaminate": _OP1,
    "op2_suffix_dedup": _OP2,
    "op4_secrets": _op4(),
    "op6_chat": _OP6,
    "op7_exact_dedup": _OP7,
    "op10_url_filter": _OP10,
    "op11_periodic_runs": _OP11,
    "op13_collocations": _OP13,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
