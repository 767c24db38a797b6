"""DuckDB SQL for the queries of this subpackage that SQL can express, and what queries and SQL share."""

from __future__ import annotations

#: Name, steps and excluded kind of the funnels.
FUNNELS = (
    ("A", ("view", "click", "view", "purchase"), "error"),
    ("B", ("signup", "view", "click", "purchase"), "error"),
    ("C", ("click", "click", "purchase", "view"), "signup"),
)
#: Verdict, host and path of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _funnel(name: str, steps: tuple[str, ...], exclude: str) -> str:
    """n and times of each client; a step's row is the first later one, found by an as-of join."""
    out = [f"""a1 AS (SELECT client_id, t AS t1, t AS p, NULL AS d1, row_number() OVER () AS i FROM r WHERE kind = '{steps[0]}')"""]
    for k, s in enumerate(steps[1:], 2):
        out.append(f"""b{k} AS (SELECT a.*, n.t AS nt FROM a{k - 1} a ASOF JOIN (SELECT client_id, t FROM r WHERE kind = '{s}') n ON a.client_id = n.client_id AND a.p < n.t),
a{k} AS (SELECT client_id, t1, nt AS p, nt - p AS d{k}, i FROM b{k} b WHERE nt - t1 <= 1800000000
  AND NOT EXISTS (SELECT 1 FROM r WHERE r.client_id = b.client_id AND r.kind = '{exclude}' AND r.t > b.p AND r.t <= b.nt))""")
    steps_of = " UNION ALL ".join(f"SELECT client_id, {k} AS step, {f'd{k}' if k > 1 else 'NULL::BIGINT'} AS d FROM a{k}" for k in range(1, len(steps) + 1))
    n = ", ".join(f"count(*) FILTER (step = {k}) AS n{k}" for k in range(1, len(steps) + 1))
    q = ", ".join(f"list_sort(list(d) FILTER (step = {k}))[(90 * count(*) FILTER (step = {k}) + 99) // 100] AS t{k}" for k in range(2, len(steps) + 1))
    return f"(WITH {', '.join(out)} SELECT '{name}' AS funnel, client_id, {n}, CAST(max(step) AS INTEGER) AS deepest, {q} FROM ({steps_of}) GROUP BY client_id)"


#: CRC-32 of decimal c, bit by bit over its ASCII codes.
_CRC = """xor(4294967295, list_reduce(list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(c AS VARCHAR), k, 1)) AS BIGINT)),
  lambda a, b: list_reduce(range(0, 8), lambda z, k: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END, xor(a, b)), 4294967295))"""
_TRIE = f"""o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS l, {_CRC} % 9 AS h FROM o GROUP BY c),
rb AS (SELECT a.c, list_concat(coalesce(b.l, [])[1:a.h], a.l[a.h + 1:]) AS t FROM l a LEFT JOIN l b ON b.c = a.c - a.c % 5),
m AS (SELECT c, d, len(t) AS n, t[1:d] AS p, min(c) OVER (PARTITION BY d, t[1:d]) AS rep FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM rb)),
nd AS (SELECT rep, d, count(*) AS n, any_value(CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].text) END) AS bytes, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends FROM m GROUP BY rep, d),
pr AS (SELECT nd.*, m.rep AS parent FROM nd LEFT JOIN m ON m.c = nd.rep AND m.d = nd.d - 1),
ch AS (SELECT parent AS rep, d - 1 AS d, count(*) AS k FROM pr WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT pr.*, coalesce(k, 0) AS k FROM pr LEFT JOIN ch USING (rep, d)),
sub AS (SELECT m.rep, m.d, count(*) FILTER (u.k = 0) AS n_leaves, sum((u.n - 1) * u.bytes) AS saved FROM full_ u JOIN m ON m.c = u.rep AND m.d <= u.d GROUP BY ALL)"""
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES)

ORACLE = {
    "op11_trie": f"""WITH {_TRIE} SELECT rep AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, k AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
sha256(coalesce(ends, '')) AS ends_sha256 FROM full_ JOIN sub USING (rep, d)""",
    "op12_funnel": f"""WITH r AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
f AS ({' UNION ALL '.join(_funnel(*f) for f in FUNNELS)})
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM f""",
    "op13_urlfilter": f"""WITH u AS (SELECT page_id, row_number() OVER () AS i, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, i, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES {_RULES}) t(h, s, v)),
m AS (SELECT i, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (i)""",
}
