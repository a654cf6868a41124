"""The registered queries in DuckDB's SQL, from the definitions rather than from the rewritten plans."""

from __future__ import annotations

from symloom.plans import pages

_GRAPH = """
WITH RECURSIVE
const AS (SELECT (SELECT count(*) FROM supplier) AS s, (SELECT count(*) FROM part) AS p, greatest(1, (SELECT count(*) FROM part) // 3) AS n),
files AS (SELECT s_suppkey, 'src/m' || s_nationkey || '/s' || s_suppkey || '.rs' AS path, 'crate::m' || s_nationkey AS module_path, sha256(s_name) AS content_hash FROM supplier),
parts AS (SELECT part.*, f.path, f.module_path, 'sym_' || (p_partkey % n) AS name FROM part, const JOIN files f ON f.s_suppkey = p_partkey % s),
symbols AS (SELECT name, CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'trait' ELSE 'impl' END AS kind, path,
            CAST(p_size AS INTEGER) AS start_line, 1 AS start_col, module_path FROM parts),
made AS (SELECT 'sym_' || (l_partkey % n) AS name, f.path, CAST(l_orderkey % 2147483647 AS INTEGER) AS start_line, CAST(l_linenumber AS INTEGER) AS start_col,
         CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'method' ELSE 'type' END AS kind, c.module_path || '::' || c.name AS container, l_partkey
         FROM lineitem, const JOIN files f ON f.s_suppkey = l_suppkey JOIN parts c ON c.p_partkey = l_orderkey % p),
refs AS (SELECT name, path, start_line, start_col, kind, container FROM made),
imports AS (SELECT f.path, 'crate::m' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '::sym_' || (c_custkey % n) END AS module_path,
            CASE WHEN c_custkey % 5 = 0 THEN 'sym_' || (c_custkey % n) END AS alias
            FROM customer, const JOIN files f ON f.s_suppkey = c_custkey % s),
impls AS (SELECT p_brand AS type_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS trait_name, path, CAST(p_size AS INTEGER) AS start_line, 1 AS start_col
          FROM parts)
"""


def _matches(import_path: str, module: str) -> str:
    return f"({import_path} = {module} OR split_part({import_path}, '/', -1) = {module} OR split_part({import_path}, '::', -1) = {module})"


_PREFIX = "regexp_extract(i.module_path, '^(.*)::', 1)"
_ITEM = f"(split_part(i.module_path, '::', -1) = c.name AND {_matches(_PREFIX, 'c.module_path')})"
_REACHES = f"(coalesce(i.alias, c.name) = c.name AND (i.module_path = c.module_path || '::' || c.name OR {_matches('i.module_path', 'c.module_path')} OR {_ITEM}))"


def _resolved(keys: str) -> str:
    return f"""{_GRAPH},
keys AS ({keys}),
cands AS (SELECT k.from_place, s.* FROM keys k JOIN symbols s USING (name)),
reached AS (SELECT DISTINCT c.from_place, c.name, c.module_path FROM cands c JOIN imports i ON i.path = c.from_place WHERE {_REACHES}),
local AS (SELECT DISTINCT path AS from_place, module_path FROM symbols),
tiered AS (SELECT c.*, CASE WHEN r.name IS NOT NULL THEN 1
                            WHEN c.module_path = c.from_place OR ((contains(c.from_place, '/') OR contains(c.from_place, '.')) AND l.module_path IS NOT NULL) THEN 2 ELSE 3 END AS tier
           FROM cands c LEFT JOIN reached r ON r.from_place = c.from_place AND r.name = c.name AND r.module_path = c.module_path
           LEFT JOIN local l ON l.from_place = c.from_place AND l.module_path = c.module_path),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY name, from_place ORDER BY tier, string_split(path, '/'), start_line, start_col, path, module_path, kind) AS INTEGER) AS rank,
                  count(*) OVER (PARTITION BY name, from_place) AS n_candidates FROM tiered),
top AS (SELECT * FROM ranked WHERE rank = 1),
good AS (SELECT * FROM top WHERE n_candidates = 1 OR tier <= 2)
"""


_KEYS = "SELECT DISTINCT name, path AS from_place FROM refs"
_R = _resolved(_KEYS)
_MEANT = f"{_R}, meant AS (SELECT g.module_path AS target_module, g.tier, r.* FROM refs r JOIN good g ON g.name = r.name AND g.from_place = r.path)"
_TARGETS = f"""{_GRAPH},
targets AS (SELECT path AS target FROM files UNION SELECT module_path FROM symbols UNION SELECT name FROM symbols),
ways AS (SELECT DISTINCT target, path, 1 AS way FROM targets JOIN files ON path = target
         UNION SELECT target, path, 2 FROM targets JOIN symbols ON module_path = target
         UNION SELECT target, path, 3 FROM targets JOIN symbols ON name = target),
tf AS (SELECT * FROM ways w WHERE way = (SELECT min(way) FROM ways v WHERE v.target = w.target))
"""
_DEP_PARTS = """
mods AS (SELECT module_path, min(path) AS first_file FROM symbols GROUP BY module_path),
pref AS (SELECT DISTINCT i.module_path AS import_path, m.module_path AS dep_module, m.first_file
         FROM (SELECT DISTINCT module_path FROM imports) i JOIN mods m ON i.module_path = m.module_path OR starts_with(i.module_path, m.module_path || '::')),
longest AS (SELECT import_path, arg_max(dep_module, length(dep_module)) AS dep_module, arg_max(first_file, length(dep_module)) AS first_file FROM pref GROUP BY import_path),
normal AS (SELECT DISTINCT i.module_path AS import_path, coalesce(l.dep_module, i.module_path) AS dep_module, l.first_file AS dep_file
           FROM imports i LEFT JOIN longest l ON l.import_path = i.module_path)
"""


def _dependencies(target_files: str) -> str:
    return f"""{_R}, {_DEP_PARTS},
tf AS ({target_files}),
steps AS (SELECT t.target, t.path, 1 AS phase, '' AS name, n.dep_module, n.dep_file FROM tf t JOIN imports i ON i.path = t.path JOIN normal n ON n.import_path = i.module_path
          UNION ALL SELECT t.target, t.path, 2, g.name, g.module_path, g.path FROM tf t JOIN good g ON g.from_place = t.path WHERE g.path <> t.path AND g.module_path <> ''),
firsts AS (SELECT *, row_number() OVER (PARTITION BY target, dep_module ORDER BY path, phase, name) AS rn FROM steps)
SELECT target, dep_module AS module_path, dep_file AS file FROM firsts WHERE rn = 1"""


_EDGES = f"""{_R},
edges AS (SELECT DISTINCT e.callee_id, r.container FROM refs r JOIN good g ON g.name = r.name AND g.from_place = r.path,
          LATERAL (SELECT unnest([CASE WHEN g.module_path = '' THEN g.name ELSE g.module_path || '::' || g.name END, g.name]) AS callee_id) e WHERE r.container <> '')
"""
_CLOSURE = f"""{_EDGES},
seeds AS (SELECT DISTINCT name AS seed, CASE WHEN module_path = '' THEN name ELSE module_path || '::' || name END AS id FROM symbols),
walk AS (SELECT seed, id FROM seeds UNION SELECT w.seed, e.container FROM walk w JOIN edges e ON e.callee_id = w.id),
hit AS (SELECT seed, id AS container FROM walk EXCEPT SELECT seed, id FROM seeds)
"""


def _reference_envelope(as_callers: bool) -> str:
    many = "No unique definition module; callers fall back to name matching. Pass module or a qualified name." if as_callers else "Multiple definitions share this name; references fall back to name matching. Pass module or a qualified name to narrow."
    other = 3 if as_callers else 2
    return f"""{_MEANT},
d AS (SELECT name, count(*) AS nd, CASE WHEN min(module_path) = max(module_path) THEN min(module_path) END AS module FROM symbols GROUP BY name),
u AS (SELECT name, count(*) AS nr FROM refs GROUP BY name),
m AS (SELECT name, target_module, count(*) AS nm FROM meant GROUP BY name, target_module),
e AS (SELECT coalesce(d.name, u.name) AS name, coalesce(nd, 0) AS nd, module, CASE WHEN module IS NOT NULL THEN coalesce(nm, 0) ELSE coalesce(nr, 0) END AS n_results
      FROM d FULL JOIN u ON d.name = u.name LEFT JOIN m ON m.name = d.name AND m.target_module = d.module),
t AS (SELECT *, CASE WHEN module IS NOT NULL AND nd <= 1 THEN 1 WHEN nd > 1 THEN 3 ELSE {other} END AS tier FROM e)
SELECT name, n_results, CASE WHEN n_results > 0 AND tier = 3 THEN 'low' ELSE 'high' END AS confidence,
       CASE WHEN n_results = 0 THEN '0' ELSE CAST(tier AS VARCHAR) END AS resolution_tier,
       CASE WHEN nd > 1 THEN '{many}' WHEN n_results = 0 THEN 'No matching symbols found.'
            WHEN tier = 3 THEN 'Resolution used name-only fallback; results may include unrelated same-named symbols.' ELSE '' END AS notes FROM t"""


_DIFF = f"""{_GRAPH},
scan AS (SELECT * FROM files WHERE s_suppkey % 11 <> 0),
old AS (SELECT s_suppkey, path, CASE WHEN s_suppkey % 7 = 0 THEN sha256(content_hash || 'x') ELSE content_hash END AS content_hash FROM files WHERE s_suppkey % 10 <> 0),
diff AS (SELECT coalesce(n.path, o.path) AS path, coalesce(n.content_hash, o.content_hash) AS content_hash,
                CASE WHEN n.path IS NULL THEN 'removed' WHEN n.content_hash = o.content_hash THEN 'skipped' WHEN n.s_suppkey % 13 = 0 THEN 'failed' ELSE 'changed' END AS outcome
         FROM scan n FULL JOIN old o ON n.path = o.path)
"""


def _rank(table: str, by: str, order: str) -> str:
    return f"{_GRAPH} SELECT *, CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS INTEGER) AS rank FROM {table}"


ORACLES: dict[str, str] = pages.ORACLES | {
    "definition": _rank("symbols", "name", "path, start_line, start_col, module_path, kind"),
    "definition_qualified": _rank("(SELECT module_path || '::' || name AS qualified_name, kind, path, start_line, start_col FROM symbols)", "qualified_name", "path, start_line, start_col, kind"),
    "references": _rank("refs", "name", "path, start_line, start_col, kind, container"),
    "implementations": _rank("(SELECT * FROM impls WHERE trait_name IS NOT NULL)", "trait_name", "path, start_line, start_col, type_name"),
    "inherent_impls": f"{_GRAPH} SELECT type_name, path, count(*) AS n_impls FROM impls WHERE trait_name IS NULL GROUP BY ALL",
    "imports_of_file": _rank("imports", "path", "module_path, alias NULLS FIRST"),
    "modules_of_file": f"{_GRAPH} SELECT DISTINCT path, module_path FROM symbols",
    "files_of_module": _rank("(SELECT DISTINCT module_path, path FROM symbols)", "module_path", "path"),
    "first_file_of_module": f"{_GRAPH} SELECT module_path, min(path) AS first_file FROM symbols GROUP BY module_path",
    "ref_names_of_file": f"{_GRAPH} SELECT DISTINCT path, name FROM refs",
    "existing_hashes": f"{_GRAPH} SELECT path, content_hash FROM files",
    "import_keys": f"""{_GRAPH},
ways AS (SELECT path, alias, module_path AS p, split_part(module_path, '::', -1) AS last, regexp_extract(module_path, '^(.*)::', 1) AS pre FROM imports)
SELECT DISTINCT path, unnest([p, split_part(p, '/', -1), last]) AS module_key, alias AS name_key FROM ways
UNION SELECT DISTINCT path, unnest([pre, split_part(pre, '/', -1), split_part(pre, '::', -1)]), last FROM ways WHERE alias IS NULL OR alias = last""",
    "resolve_ranked": f"{_R} SELECT from_place, rank, CAST(tier AS INTEGER) AS tier, name, kind, path, start_line, start_col, module_path FROM ranked",
    "resolve_from_module": f"{_resolved('SELECT DISTINCT name, module_path AS from_place FROM symbols')} SELECT name, from_place, CAST(tier AS INTEGER) AS tier, path, start_line, start_col, module_path FROM top",
    "top_match": f"{_R} SELECT name, from_place, CAST(tier AS INTEGER) AS tier, n_candidates, path, start_line, start_col, module_path FROM top",
    "acceptable_top": f"{_R} SELECT name, from_place, CAST(tier AS INTEGER) AS tier, path, start_line, module_path FROM good",
    "callers": f"{_MEANT} SELECT name, target_module, CAST(tier AS INTEGER) AS tier, count(*) AS n_refs FROM meant GROUP BY ALL",
    "callers_precise": f"{_MEANT} SELECT target_module, name, path, start_line, start_col, kind, container FROM meant",
    "target_normalize": f"{_TARGETS} SELECT target, path, CAST(way AS INTEGER) AS way FROM tf",
    "preferred_module": f"""{_TARGETS}
SELECT t.target, min_by(s.module_path, (length(s.module_path), s.module_path)) AS preferred_module FROM tf t JOIN symbols s ON s.path = t.path WHERE way = 1 GROUP BY t.target
UNION ALL SELECT DISTINCT target, target FROM tf WHERE way = 2
UNION ALL SELECT t.target, min(s.module_path) FROM (SELECT DISTINCT target FROM tf WHERE way = 3) t JOIN symbols s ON s.name = t.target GROUP BY t.target HAVING min(s.module_path) = max(s.module_path)""",
    "dependencies_all": _dependencies("SELECT DISTINCT module_path AS target, path FROM symbols"),
    "dependencies_of_symbols": _dependencies("SELECT DISTINCT name AS target, path FROM symbols"),
    "import_longest_prefix": f"{_GRAPH}, {_DEP_PARTS} SELECT import_path, dep_module, dep_file FROM normal",
    "call_edges": f"{_EDGES} SELECT callee_id, container FROM edges",
    "impact_closure": f"{_CLOSURE} SELECT seed, container FROM hit",
    "impact_symbols": f"""{_CLOSURE}
SELECT DISTINCT r.seed, s.name, s.kind, s.path, s.start_line, s.start_col, s.module_path FROM hit r JOIN symbols s ON s.module_path || '::' || s.name = r.container""",
    "container_symbols": f"""{_GRAPH}
SELECT DISTINCT r.container, s.* FROM (SELECT DISTINCT container FROM refs) r JOIN symbols s ON s.module_path || '::' || s.name = r.container""",
    "envelope_definition": f"""{_GRAPH}
SELECT name, count(*) AS n_results, CASE WHEN count(*) > 1 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN count(*) > 1 THEN '3' ELSE '2' END AS resolution_tier,
       CASE WHEN count(*) > 1 THEN 'Found ' || count(*) || ' definitions for `' || name || '`; disambiguate with module arg or qualified name (e.g. `crate::mcp::' || name || '`).' ELSE '' END AS notes
FROM symbols GROUP BY name""",
    "envelope_references": _reference_envelope(False),
    "envelope_callers": _reference_envelope(True),
    "hash_diff": f"{_DIFF} SELECT * FROM diff",
    "hash_diff_stats": f"""{_DIFF} SELECT count(*) FILTER (outcome = 'changed') AS indexed, count(*) FILTER (outcome = 'skipped') AS skipped,
       count(*) FILTER (outcome = 'removed') AS removed, count(*) FILTER (outcome = 'failed') AS errors FROM diff""",
    "accuracy_prf1": f"""{_R},
gold AS (SELECT DISTINCT m.name, m.path AS from_place, p.path, CAST(p.p_size AS INTEGER) AS start_line FROM made m JOIN parts p ON p.p_partkey = m.l_partkey),
found AS (SELECT DISTINCT 'resolver' AS method, name, from_place, path, start_line FROM good UNION SELECT 'name only', name, from_place, path, start_line FROM top),
tp AS (SELECT f.method, count(*) AS tp FROM found f JOIN gold g USING (name, from_place, path, start_line) GROUP BY ALL),
c AS (SELECT f.method, coalesce(any_value(tp.tp), 0) AS tp, count(*) AS nf, (SELECT count(*) FROM gold) AS ng FROM found f LEFT JOIN tp ON tp.method = f.method GROUP BY f.method)
SELECT method, tp, nf - tp AS fp, ng - tp AS fn, round(CASE WHEN nf = 0 THEN 1.0 ELSE tp / nf END, 6) AS precision,
       round(CASE WHEN ng = 0 THEN 1.0 ELSE tp / ng END, 6) AS recall, round(CASE WHEN nf + ng = 0 THEN 0.0 ELSE 2 * tp / (nf + ng) END, 6) AS f1 FROM c""",
}
