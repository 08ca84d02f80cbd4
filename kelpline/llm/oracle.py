"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import re

from kelpline.llm import centroids, quality, secret_scan

_WORD = r"[^\x20\x09-\x0D]+"

_FAILS = rf"""(
    (n < {quality.SHORT_LINE} AND NOT regexp_matches(line, '{quality.TERMINAL.replace("'", "''")}'))
    OR (n >= {quality.SHORT_LINE} AND NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}'))
    OR ((strlen(line) - strlen(replace(line, '!', ''))) * 100 > n * {quality.MOST_SHOUTS})
    OR (len(regexp_extract_all(line, '{quality.SYMBOLS}')) * 100 > n * {quality.MOST_SYMBOLS})
    OR (n <= {quality.BOILERPLATE_LINE} AND regexp_matches(line, '{quality.BOILERPLATE}')))"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, text, regexp_extract_all(text, '{_WORD}') AS w FROM d),
win AS (SELECT id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, unnest(range(1, greatest(len(w) - 1, 1))) AS u(i)),
rep AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT id, count(DISTINCT i + k) AS n FROM rep, range(3) AS r(k) GROUP BY id),
l AS (SELECT id, line, len(regexp_extract_all(line, '{_WORD}')) AS n FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d)),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN {_FAILS} THEN n ELSE 0 END) AS lost FROM l WHERE n > 0 GROUP BY id),
q AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN cov USING (id) LEFT JOIN lines USING (id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words)
    AND 100 * lost <= {quality.MOST_LOST} * n_words AS kept
FROM q
"""

#: All pairs that share a shingle, their overlap, and what links reach.
OP1 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS MATERIALIZED (SELECT rid, count(*) AS n FROM s GROUP BY rid),
i AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM i JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT x, x FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT reach.x AS rid, min(d.doc_id) AS component_id FROM reach JOIN d ON d.rid = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN least USING (rid)
"""



def _plain(pattern: str) -> str:
    """An expression for an engine whose letters in either case, and white space, are others: both spelled out."""
    either = lambda m: re.sub("[a-zA-Z]", lambda x: f"[{x[0].lower()}{x[0].upper()}]", m[1])
    pattern = re.sub(r"\(\?i:([^()]*)\)", lambda m: f"(?:{either(m)})", pattern)
    # Without backtracking a possessive repeat is a plain one.
    return pattern.replace("*+", "*").replace("++", "+").replace(r"[^\s", r"[^ \t\n\r\f\x0b").replace(r"\s", r"[ \t\n\r\f\x0b]").replace("'", "''")


def _found(nth: int, rule: secret_scan.Rule) -> str:
    """A rule's matches beside what stands between them, from which their places follow.  A run of a class that has no
    group may ask for its length at once: it is whole or no match."""
    p = _plain(re.sub(r"^(AKIA)?(\[[^]]*\])\+$", lambda m: f"{m[1] or ''}{m[2]}{{{rule.least - len(m[1] or '')},}}", rule.pattern) if not rule.group else rule.pattern)
    # The only group that counts is the last one; the others are made to stand for nothing.
    group = p.count("(") - p.count("(?") if rule.group else 0
    return f"SELECT id, {nth} AS nth, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(text, '{p}') AS parts, regexp_extract_all(text, '{p}', 0) AS full_, regexp_extract_all(text, '{p}', {group}) AS grp FROM d WHERE regexp_matches(text, '{p}')"


OP9 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found(i, r) for i, r in enumerate(secret_scan.RULES))}),
e AS (SELECT *, unnest(range(1, len(full_) + 1)) AS i FROM f),
place AS (SELECT id, nth, kind, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(full_[1:i - 1], lambda x: length(x))), 0) AS start, length(full_[i]) AS n FROM e WHERE length(grp[i]) >= least),
s AS (SELECT id, count(*) FILTER (WHERE nth = 0) AS n_assign, count(*) FILTER (WHERE nth = 1) AS n_access, count(*) FILTER (WHERE nth = 2) AS n_hex,
  string_agg(concat(kind, ':', start::BIGINT, ':', (start + n)::BIGINT), ',' ORDER BY start, nth) FILTER (WHERE nth < 3) AS base, string_agg(concat(kind, ':', start::BIGINT, ':', (start + n)::BIGINT), ',' ORDER BY start, nth) AS spans FROM place GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (id)
"""


def _rounds(n: int) -> str:
    """Rounds of assignment by plain squared differences: m0 holds the first centroids, a_i the vectors' clusters, m_i the centroids after round i."""
    steps = []
    for i in range(n + 1):
        steps.append(f"""f{i} AS MATERIALIZED (SELECT x.rid, m.cluster, sum((x.x - m.x) * (x.x - m.x)) AS far FROM x JOIN m{i} m USING (place) GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT rid, arg_min(cluster, (far, cluster)) AS cluster, min(far) AS far FROM f{i} GROUP BY rid)""")
        if i < n:
            steps.append(f"""s{i} AS (SELECT cluster, place, sum(x.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i} JOIN x USING (rid) GROUP BY ALL),
m{i + 1} AS MATERIALIZED (SELECT m.cluster, m.place, CASE WHEN n IS NULL THEN m.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM m{i} m LEFT JOIN s{i} USING (cluster, place))""")
    return ",\n".join(steps)


OP13 = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(greatest(least(e::DOUBLE * 1024, {centroids.LARGEST}), -{centroids.LARGEST}))::BIGINT) AS xs
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
x AS MATERIALIZED (SELECT rid, place, xs[place] AS x FROM v, unnest(range(1, 65)) AS u(place)),
c AS (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), xs) - 1 AS cluster, xs FROM v),
m0 AS MATERIALIZED (SELECT cluster, place, xs[place] AS x FROM c, unnest(range(1, 65)) AS u(place) WHERE cluster < 8),
{_rounds(10)},
sha AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM m10 GROUP BY cluster)
SELECT vec_id, cluster::INTEGER AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a10 JOIN v USING (rid) JOIN sha USING (cluster)
"""

#: Prefixes as texts of their turns' ids.  DuckDB has no crc32, so it is folded bit by bit over the decimal's bytes.
OP11 = rf"""
WITH t AS (SELECT conv_id, turn, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(words ORDER BY turn NULLS FIRST, id) AS words FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x::BIGINT) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295::BIGINT), 4294967295) % 4 AS h FROM c),
r AS MATERIALIZED (SELECT h.conv_id, coalesce(b.ids[1:h], []) || h.ids[h + 1:] AS ids, coalesce(b.words[1:h], []) || h.words[h + 1:] AS words FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, array_to_string(ids[1:d], '') AS p, coalesce(words[d], 0) AS w FROM r, unnest(range(0, len(ids) + 1)) AS u(d)),
node AS MATERIALIZED (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w FROM p GROUP BY p, d),
kids AS (SELECT p[1:32 * (d - 1)] AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1),
own AS (SELECT node.*, coalesce(kids, 0) AS kids, (coalesce(kids, 0) = 0)::INTEGER AS leaf, (n - 1) * w AS saved FROM node LEFT JOIN kids USING (p)),
below AS (SELECT p[1:32 * a] AS p, sum(leaf) AS n_leaves, sum(saved) AS saved FROM own, unnest(range(0, d + 1)) AS u(a) GROUP BY 1),
ends AS (SELECT array_to_string(ids, '') AS p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM r GROUP BY 1)
SELECT own.conv_id, own.d::BIGINT AS depth, up.conv_id AS parent_conv_id, own.n::BIGINT AS n_convs, kids::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM own JOIN below USING (p) LEFT JOIN ends USING (p) LEFT JOIN node up ON own.d > 0 AND up.p = own.p[1:32 * (own.d - 1)]
"""

ORACLE: dict[str, str] = {"op1_near_dup": OP1, "op5_quality": OP5, "op9_secrets": OP9, "op11_prefix_trie": OP11, "op13_clusters": OP13}
