"""The personal-data and secrets queries in DuckDB's SQL.

A pattern's places come from the texts between its matches and the matches
themselves, laid end to end, as in the plans; the rest follows the definitions.
"""

from __future__ import annotations

from symloom.llm import pii, secrets


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind: str, pattern: str, source: str = "d", text: str = "t") -> str:
    """SELECT rid, kind, s, e, v of the matches of a pattern."""
    p = _quoted(pattern)
    return f"""SELECT rid, '{kind}' AS kind, s, s + length(v) AS e, v FROM (
  SELECT rid, v, CAST(sum(length(b)) OVER w + coalesce(sum(length(v)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM (SELECT rid, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS v, unnest(b[1:len(m)]) AS b
        FROM (SELECT rid, regexp_extract_all({text}, {p}, 0) AS m, string_split_regex({text}, {p}) AS b FROM {source} WHERE regexp_matches({text}, {p})))
  WINDOW w AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _joined(source: str, name: str, first: str, second: str) -> str:
    return f"{name} AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY {first}, {second}) AS {name} FROM {source} GROUP BY rid)"


def _place(kinds: list[str]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(kinds)) + " END"


def _count(kinds: list[str]) -> str:
    return ", ".join(f"CAST(coalesce((SELECT count(*) FROM base b WHERE b.rid = d.rid AND b.kind = '{k}'), 0) AS BIGINT) AS n_{k}" for k in kinds)


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
ips AS ({_found("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")}),
cards AS ({_found("card", "[0-9](?:[ -]?[0-9])+")}),
sums AS (SELECT rid, s, sum(CASE WHEN j % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END) AS luhn
         FROM (SELECT rid, s, j, CAST(substr(r, j, 1) AS INTEGER) AS x FROM (SELECT rid, s, r, unnest(range(1, length(r) + 1)) AS j FROM (SELECT rid, s, reverse({_DIGITS}) AS r FROM cards WHERE length({_DIGITS}) BETWEEN 13 AND 19)))
         GROUP BY rid, s),
base AS ({_found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")}
  UNION ALL SELECT * FROM ips WHERE len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0
  UNION ALL SELECT c.* FROM cards c JOIN sums USING (rid, s) WHERE luhn % 10 = 0
  UNION ALL SELECT * FROM ({_found("phone", r"\+[0-9][ ().0-9-]+[0-9]")}) WHERE length({_DIGITS}) BETWEEN 9 AND 15),
ent AS (SELECT DISTINCT rid, kind || ':' || lower(v) AS entity FROM base),
words AS ({_found("term", r"\p{L}{3,}", "(SELECT * FROM d WHERE rid IN (SELECT rid FROM base))")}),
free AS (SELECT rid, lower(v) AS term, s, e FROM words w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = w.rid AND b.s < w.e AND w.s < b.e)),
both_ AS (SELECT entity, term, count(*) AS nb FROM (SELECT DISTINCT rid, entity, term FROM ent JOIN free USING (rid)) JOIN d USING (rid) GROUP BY ALL HAVING count(DISTINCT t) >= {pii.LEAST_TEXTS}),
ne AS (SELECT entity, count(*) AS n FROM ent GROUP BY entity),
nt AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '\\p{{L}}+', 0))) AS term FROM d) GROUP BY term),
tot AS (SELECT count(*) AS n FROM d),
tell AS (SELECT entity, term FROM both_ JOIN ne USING (entity) JOIN nt USING (term), tot
         WHERE tot.n > ne.n AND log2(CAST(nb AS DOUBLE) * tot.n / (CAST(ne.n AS DOUBLE) * nt.n)) >= {pii.DISCLOSURE} * log2(CAST(tot.n AS DOUBLE) / ne.n)),
alls AS (SELECT rid, kind, s, e FROM base UNION ALL SELECT DISTINCT rid, 'term', s, e FROM free JOIN ent USING (rid) JOIN tell USING (entity, term)),
{_joined("base", "bs", _place(pii.KINDS), "s")},
{_joined("alls", "sp", _place(pii.KINDS), "s")}
SELECT doc_id, {_count(pii.BASE_KINDS)}, sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN bs USING (rid) LEFT JOIN sp USING (rid)
"""

_KEY = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
_CLASS = " ".join(f"WHEN regexp_matches(v, {_quoted(pattern)}) THEN {bits}" for _, pattern, bits in secrets.CLASSES)
_ALLOWED = " ".join(f"AND NOT regexp_matches(v, {_quoted(p)})" for p in secrets.ALLOWED)

OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT * FROM ({_found("assign", _KEY + "[A-Za-z0-9+/_.=-]+")}) WHERE length(regexp_extract(v, {_quoted("^" + _KEY + "([A-Za-z0-9+/_.=-]+)")}, 1)) >= 12
  UNION ALL SELECT * FROM ({_found("access", "AKIA[A-Z0-9]+")}) WHERE length(v) >= 18
  UNION ALL {_found("hex", "[0-9a-f]{16,}")}),
cand AS (SELECT row_number() OVER () AS c, x.*, CASE {_CLASS} END AS least FROM ({_found("entropy", "[A-Za-z0-9+/_=-]{20,}")}) x
         WHERE regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') {_ALLOWED}
           AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = x.rid AND b.s < x.e AND x.s < b.e)),
wins AS (SELECT c, least, v, unnest(range(1, length(v) - {secrets.WINDOW} + 2)) AS p FROM cand),
chars AS (SELECT c, least, p, substr(v, CAST(p + q AS BIGINT), 1) AS ch FROM wins, (SELECT unnest(range(0, {secrets.WINDOW})) AS q)),
ent AS (SELECT c, least, p, log2({secrets.WINDOW}.0) - sum(n * log2(n)) / {secrets.WINDOW} AS h FROM (SELECT c, least, p, ch, CAST(count(*) AS DOUBLE) AS n FROM chars GROUP BY ALL) GROUP BY c, least, p),
hit AS (SELECT DISTINCT c FROM ent WHERE h >= least),
alls AS (SELECT rid, kind, s, e FROM base UNION ALL SELECT rid, kind, s, e FROM cand JOIN hit USING (c)),
{_joined("base", "bs", "s", _place(secrets.KINDS))},
{_joined("alls", "sp", "s", _place(secrets.KINDS))}
SELECT doc_id, {_count(secrets.BASE_KINDS)}, sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans
FROM d LEFT JOIN bs USING (rid) LEFT JOIN sp USING (rid)
"""
