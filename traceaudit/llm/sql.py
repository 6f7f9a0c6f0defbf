"""DuckDB SQL of those operators that it can express, over whole tables."""

from __future__ import annotations

import string

from traceaudit.llm import hosts, infill, jaccard, minmax, substrings, vectorcodes, warc

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

HOST_RULES = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS x, {_WORDS} AS t FROM documents),
l AS (SELECT doc_id, [v FOR v IN string_split(x, chr(10)) IF regexp_matches(v, '[^\x20\x09-\x0D]')] AS lines FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(t[i:i + {hosts.WINDOW - 1}], ' ')) AS n
  FROM (SELECT doc_id, t, unnest(range(1, len(t) - {hosts.WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {hosts.WINDOW})) AS p FROM g WHERE n > 1) GROUP BY 1),
c AS (SELECT doc_id, source AS host, len(t)::BIGINT AS n_words, coalesce(list_sum([length(v) FOR v IN t]), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {hosts.LEAST_WORDS} OR 100 * n_repeat_words > {hosts.MOST_REPEATED} * n_words AS base_failed,
  word_chars > {hosts.LONGEST_WORD} * n_words OR word_chars < {hosts.SHORTEST_WORD} * n_words AS length_failed, 100 * n_symbols > {hosts.MOST_SYMBOLS} * n_words AS symbols_failed,
  100 * n_dup_lines > {hosts.MOST_EQUAL_LINES} * n_lines AS lines_failed FROM c),
h AS (SELECT host, rule, count(*) AS n, count(*) FILTER (failed) AS f FROM (SELECT host, unnest(['host_rate', 'length_rate', 'symbols_rate', 'lines_rate']) AS rule,
  unnest([base_failed, length_failed, symbols_failed, lines_failed]) AS failed FROM b WHERE host IS NOT NULL) GROUP BY 1, 2),
m AS (SELECT rule, least(greatest(avg(f / n), 1e-6), 1 - 1e-6) AS mean, coalesce(var_samp(f / n), 0.0) AS variance, avg(1.0 / n) AS inverse FROM h GROUP BY 1),
s AS (SELECT rule, mean, greatest(mean * (1 - mean) / greatest(variance - mean * (1 - mean) * inverse, 1e-6) - 1, 1e-3) AS strength FROM m),
v AS (SELECT host, rule, (f + mean * strength) / (n + strength) AS rate FROM h JOIN s USING (rule)),
o AS (SELECT host, max(rate) AS worst, {", ".join(f"any_value(rate) FILTER (rule = '{rate}') AS {rate}" for rate in hosts.RULES.values())} FROM v GROUP BY 1)
SELECT doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, length_failed, symbols_failed, lines_failed,
  {", ".join(f"round({rate}, 9) AS {rate}" for rate in hosts.RULES.values())}, NOT base_failed AND coalesce(worst, 0.0) <= {hosts.HOST_LIMIT} AS kept FROM b LEFT JOIN o USING (host)
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS t FROM documents),
g AS (SELECT doc_id, i, array_to_string(t[i:i + {substrings.WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, t, unnest(range(1, len(t) - {substrings.WINDOW - 2})) AS i FROM w)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substrings.WINDOW})) AS p FROM f),
a AS (SELECT doc_id, unnest(t) AS v, unnest(range(1, len(t) + 1)) AS p FROM w),
k AS (SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY p) AS kept FROM a ANTI JOIN r USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(t)::BIGINT AS n_words, (len(t) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
o AS (SELECT page_id, x, strlen(x) >= {warc.LEAST_REVISIT_BYTES} AND page_id <> max(page_id) OVER (PARTITION BY x) AS again, max(page_id) OVER (PARTITION BY x) AS origin FROM p)
SELECT page_id, strlen(x)::BIGINT AS payload_bytes, sha1(x) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN origin END AS refers_to, true AS verified FROM o
"""

def _links(width: int, percent: int) -> str:
    """Sets ``s`` (doc_id, s) and reachable pairs ``r`` (d, c) of documents that share ``percent`` of their n-grams."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) >= {width} THEN list_distinct([array_to_string(t[i:i + {width - 1}], ' ') FOR i IN range(1, len(t) - {width - 2})])
  WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)"""


JACCARD = f"""{_links(jaccard.WIDTH, jaccard.PERCENT)}
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM s JOIN (SELECT d, min(c) AS c FROM r GROUP BY 1) ON d = doc_id
"""

MIN_MAX = f"""{_links(minmax.WIDTH, minmax.PERCENT)}
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM s JOIN (SELECT d, min(c) AS c FROM r GROUP BY 1) ON d = doc_id
"""

INFILL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('{infill.SEED}:' || doc_id) AS d FROM documents),
h AS (SELECT doc_id, x, t, len(t) AS n, [('0x' || substr(d, 8 * i + 1, 8))::UBIGINT::BIGINT FOR i IN range(4)] AS h FROM w),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '{infill.PREFIX}') OR contains(x, '{infill.SUFFIX}') OR contains(x, '{infill.MIDDLE}') OR h[3] % 100 >= {infill.CUT_PERCENT} THEN 'plain'
  WHEN h[4] % 100 < {infill.SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '{infill.PREFIX}' || p || '{infill.SUFFIX}' || s || '{infill.MIDDLE}' || m
  ELSE '{infill.SUFFIX}' || s || '{infill.PREFIX}' || p || '{infill.MIDDLE}' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256 FROM p
"""


def _vector_codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Rounds one after the other: ``a{k}`` assigns every part to codebook ``b{k}``, ``b{k + 1}`` holds the new entries."""
    steps = [
        f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, [floor({scale} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM v, range({parts}) AS r(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, p, x, min(struct_pack(d, e)) AS best FROM
  (SELECT vec_id, x.p, x, e, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT AS d FROM x JOIN b{k} b ON b.p = x.p) GROUP BY 1, 2, 3)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, best.e AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM a{k}) GROUP BY 1, 2, 3),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY 1, 2),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c::BIGINT[], b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))""")
    last = f"a{rounds}"
    steps.append(f"""o AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM {last} GROUP BY 1),
l AS (SELECT label, sum(error)::BIGINT AS label_error FROM o JOIN v USING (vec_id) GROUP BY 1),
k AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM b{rounds})
SELECT o.vec_id, code, error, label_error, k.h AS codebooks_sha256 FROM o JOIN v USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM v.label, k""")
    return ",\n".join(steps)


VECTOR_CODES = _vector_codes(vectorcodes.PARTS, vectorcodes.ENTRIES, vectorcodes.ROUNDS, vectorcodes.SCALE)
