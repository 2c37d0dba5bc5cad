"""SQL for DuckDB that says the same as the operators, over the views of sources.adapters."""

from __future__ import annotations

from ..sources.adapters import duckdb_views
from .registry import AGREEMENT, Heuristic

VIEWS = duckdb_views()
_ROW = "f.address AS ea1, f.name AS name1, df.address AS ea2, df.name AS name2, {0} AS description, f.nodes AS nodes1, df.nodes AS nodes2, f.md AS md1, df.md AS md2, f.id AS id1, df.id AS id2, {1} AS taken"
_FEW_NODES = "(least(f.nodes, df.nodes) * 100) // nullif(greatest(f.nodes, df.nodes), 0) < 50"


def _key(key: str) -> str:
    return f"substr(f.{key[:-4]}, 1, 16) = substr(df.{key[:-4]}, 1, 16)" if key.endswith("[16]") else f"f.{key} = df.{key}"


def heuristic(h: Heuristic) -> str:
    """A heuristic's rows, without the views."""
    taken = {"": "0", "source": "coalesce(CAST(f.source_file = df.source_file AS int), -1)", "agreement": "-(" + " + ".join(f"CASE WHEN f.{c} = df.{c} THEN 1 ELSE 0 END" for c in AGREEMENT) + ")"}[h.order]
    row = _ROW.format("'" + h.name + "'", taken)
    holds = " AND ".join([*map(_key, h.keys), h.where])
    select = f"SELECT {'DISTINCT ' if h.distinct else ''}{row}\nFROM main_functions f, diff_functions df"
    if h.shape == "either":
        arms = (("pseudocode", "Equal pseudo-code", "f.pseudocode_lines >= 5"), ("assembly", "Equal assembly", "f.instructions >= 4 AND df.instructions >= 4"))
        return "\nUNION\n".join(f"SELECT {_ROW.format(repr(d), taken)} FROM main_functions f, diff_functions df WHERE f.{k} = df.{k} AND {w} AND {holds}" for k, d, w in arms)
    if h.shape == "rare":
        rare = " UNION ".join(f"SELECT {h.keys[0]} FROM {s}_functions WHERE {h.keys[0]} <> '0' GROUP BY {h.keys[0]} HAVING count(*) <= 2" for s in ("main", "diff"))
        return f"{select}\nWHERE {holds} AND f.{h.keys[0]} IN ({rare})"
    if h.shape == "constants":
        return f"{select}, main_constants mc, diff_constants dc\nWHERE mc.constant = dc.constant AND mc.func_id = f.id AND dc.func_id = df.id AND {holds}"
    if h.shape in ("units", "unit_links"):
        key = "mu.name = du.name AND mu.name <> ''" if h.shape == "units" else "mu.pseudocode_primes = du.pseudocode_primes"
        return f"{select}, main_compilation_units mu, diff_compilation_units du, main_compilation_unit_functions ml, diff_compilation_unit_functions dl\nWHERE ml.func_id = f.id AND ml.cu_id = mu.id AND dl.func_id = df.id AND dl.cu_id = du.id AND {key} AND {holds}"
    if h.shape == "assembly":
        one = lambda s: f"(SELECT i.disasm, min(x.id) AS func FROM {s}_instructions i JOIN {s}_functions x ON x.id = i.func_id WHERE x.name NOT ILIKE 'nullsub%' AND i.disasm <> '' GROUP BY i.disasm HAVING count(*) = 1)"
        return f"{select}, (SELECT DISTINCT m.func AS a, d.func AS b FROM {one('main')} m JOIN {one('diff')} d ON m.disasm = d.disasm) q\nWHERE f.id = q.a AND df.id = q.b AND {_FEW_NODES} AND {holds}"
    if h.shape == "blocks":
        lists = lambda s: f"(SELECT min(i.func_id) AS func, string_agg(i.mnemonic, ',' ORDER BY b.id) AS list, count(*) AS total FROM {s}_bb_instructions b JOIN {s}_instructions i ON b.instruction_id = i.id GROUP BY b.basic_block_id)"
        return f"{select}, (SELECT list, min(func) AS func FROM {lists('main')} GROUP BY list HAVING count(*) = 1) m, {lists('diff')} d\nWHERE m.list = d.list AND d.total >= 6 AND f.id = m.func AND df.id = d.func AND {_FEW_NODES} AND {holds}"
    return f"{select}\nWHERE {holds}"


#: Matches for the operators on them: some heuristics' rows with a ratio made from the ids.
ITEM_HEURISTICS = (3, 25, 32, 27)


def items(heuristics: tuple[Heuristic, ...]) -> str:
    """items AS (...), to follow the views."""
    rows = " UNION ".join(f"SELECT * FROM ({heuristic(heuristics[n])})" for n in ITEM_HEURISTICS)
    ratio = "CASE WHEN description = 'Bytes hash' THEN 1.0::double ELSE ((id1 * 7 + id2 * 13) % 60 + 40) / 100 END"
    return f""", items AS (
  SELECT CASE WHEN ratio = 1 THEN 'best' WHEN ratio >= 0.5 THEN 'partial' ELSE 'unreliable' END AS category, * EXCLUDE (taken, md1, md2),
    id1 * 100000 + id2 * 10 + length(description) % 9 AS seq
  FROM (SELECT *, {ratio} AS ratio FROM ({rows}))
)"""


_MATCH = "category, ea1, name1, ea2, name2, description, ratio, nodes1, nodes2, id1, id2, seq"
_RANK = "CASE category WHEN 'best' THEN 0 WHEN 'partial' THEN 1 WHEN 'unreliable' THEN 2 ELSE 3 END"
_ORDER = f"{_RANK}, ratio DESC, seq, id1, id2"
_EFFECTIVE = "CASE WHEN name1 = name2 THEN 1.0 ELSE ratio END"
CLEANUP = f"""SELECT {_MATCH} FROM (
  SELECT *, max({_EFFECTIVE}) OVER (PARTITION BY ea1 ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM (SELECT *, row_number() OVER (PARTITION BY name1, name2 ORDER BY {_ORDER}) AS nth FROM items) WHERE nth = 1
) WHERE above IS NULL OR above <= {_EFFECTIVE}"""
FINAL = f"""u AS (
  SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY ea1, ea2 ORDER BY {_ORDER}) AS nth FROM items) WHERE nth = 1
), k AS (
  SELECT * EXCLUDE (top) FROM (SELECT *, max(ratio) OVER (PARTITION BY ea1 ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS top FROM u) WHERE ratio >= top
), kb AS (
  SELECT * EXCLUDE (top) FROM (SELECT *, max(ratio) OVER (PARTITION BY ea2 ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING) AS top FROM k) WHERE ratio >= top
), ma AS (
  SELECT * FROM k WHERE ea1 IN (SELECT ea1 FROM k GROUP BY ea1 HAVING count(*) > 1)
), mb AS (
  SELECT * FROM kb WHERE ea2 IN (SELECT ea2 FROM kb GROUP BY ea2 HAVING count(*) > 1) AND NOT EXISTS (SELECT 1 FROM ma WHERE ma.ea1 = kb.ea1 AND ma.ea2 = kb.ea2)
), final AS (
  SELECT {_MATCH} FROM items i
  WHERE ea1 NOT IN (SELECT ea1 FROM ma) AND ea2 NOT IN (SELECT ea2 FROM mb)
    AND ratio >= (SELECT max(ratio) FROM u WHERE u.ea1 = i.ea1) AND ratio >= coalesce((SELECT max(ratio) FROM k WHERE k.ea2 = i.ea2), 0)
  UNION ALL SELECT 'multimatch', * EXCLUDE (category) FROM (SELECT {_MATCH} FROM ma UNION ALL SELECT {_MATCH} FROM mb)
)"""
_LINES = "SELECT id, k, line, count(*) AS n FROM (SELECT id, unnest(['p', 'a', 'm']) AS k, unnest([string_split(clean_pseudo, chr(10)), string_split(clean_assembly, chr(10)), string_split(clean_microcode, chr(10))]) AS lines FROM {0}_functions), unnest(lines) AS t(line) GROUP BY ALL"
#: pairs AS (...) is what is scored; ratios AS (...) the three line shares.
PAIRS = "pairs AS (SELECT DISTINCT id1, id2 FROM items)"
RATIOS = f"""l1 AS ({_LINES.format("main")}), l2 AS ({_LINES.format("diff")}), t1 AS (SELECT id, k, sum(n) AS n FROM l1 GROUP BY ALL), t2 AS (SELECT id, k, sum(n) AS n FROM l2 GROUP BY ALL),
common AS (SELECT id1, id2, l1.k, sum(least(l1.n, l2.n)) AS n FROM pairs JOIN l1 ON l1.id = id1 JOIN l2 ON l2.id = id2 AND l2.k = l1.k AND l2.line = l1.line GROUP BY ALL),
shares AS (SELECT p.id1, p.id2, t1.k, CAST(printf('%.7f', 2 * coalesce(c.n, 0) / (t1.n + t2.n)) AS double) AS q FROM pairs p JOIN t1 ON t1.id = p.id1 JOIN t2 ON t2.id = p.id2 AND t2.k = t1.k LEFT JOIN common c ON c.id1 = p.id1 AND c.id2 = p.id2 AND c.k = t1.k),
ratios AS (SELECT id1, id2, coalesce(max(q) FILTER (WHERE k = 'p'), 0) AS clean_pseudo, coalesce(max(q) FILTER (WHERE k = 'a'), 0) AS clean_assembly, coalesce(max(q) FILTER (WHERE k = 'm'), 0) AS clean_microcode FROM pairs LEFT JOIN shares USING (id1, id2) GROUP BY ALL)"""
_WORD = lambda c: f"CASE WHEN f.{c} = df.{c} AND f.{c} <> '' THEN 0.001::double ELSE 0 END"
_NUMBER = lambda c: f"CASE WHEN f.{c} = df.{c} AND f.{c} <> 0 THEN 0.001::double ELSE 0 END"
DEEP = f"0.0::double + {_WORD('source_file')} + {_WORD('pseudocode_primes')} + {_NUMBER('indegree')} + {_NUMBER('outdegree')} + CASE WHEN f.switches IS NOT DISTINCT FROM df.switches AND f.switches IS DISTINCT FROM '[]' THEN 0.003::double ELSE 0 END + {_NUMBER('cyclomatic_complexity')} + len(list_intersect(from_json(f.constants, '[\"varchar\"]'), from_json(df.constants, '[\"varchar\"]'))) * 0.006::double"
SCORES = f"""scored AS (
  SELECT r.id1, r.id2, f.bytes_hash = df.bytes_hash AS same, f.md IS NOT DISTINCT FROM df.md AS same_md, {DEEP} AS deep, r.clean_pseudo AS v1, r.clean_assembly AS v2, r.clean_microcode AS v5,
    CASE WHEN f.md = df.md AND f.md > 0 THEN least(1.0, (r.clean_pseudo + r.clean_assembly + 3.0) / 5) ELSE 0 END AS v4
  FROM ratios r JOIN main_functions f ON f.id = r.id1 JOIN diff_functions df ON df.id = r.id2
), topped AS (
  SELECT *, CASE WHEN greatest(v1, v2, v4, v5) = 1 AND NOT same_md THEN greatest(0.0, CASE WHEN v1 <> 1 THEN v1 ELSE 0 END, CASE WHEN v2 <> 1 THEN v2 ELSE 0 END, CASE WHEN v4 <> 1 THEN v4 ELSE 0 END, CASE WHEN v5 <> 1 THEN v5 ELSE 0 END) ELSE greatest(v1, v2, v4, v5) END AS r FROM scored
), scores AS (
  SELECT id1, id2, CASE WHEN same OR v5 = 1 THEN 1.0 WHEN r < 1 AND r + deep < 1 THEN r + deep WHEN r < 1 THEN 0.99 ELSE r END::double AS ratio FROM topped
)"""
PORTABLE = "({0} NOT IN ('', '...', 'DllEntryPoint', 'start') AND NOT starts_with({0}, 'sub_') AND NOT starts_with({0}, 'nullsub') AND NOT starts_with({0}, 'j_') AND NOT starts_with({0}, 'unknown_libname_'))"
FOUND = "{0}address AS ea1, {0}name AS name1, {1}address AS ea2, {1}name AS name2, '{2}' AS description, {0}nodes AS nodes1, {1}nodes AS nodes2, {0}id AS id1, {1}id AS id2"


def found(description: str) -> str:
    return FOUND.format("f.", "df.", description)
