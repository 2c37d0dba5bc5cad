"""Every operator as a query over the test tables, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import materialize
from .functions import names
from .operators import evaluate, graph, port, results, similarity, stages, state
from .operators.candidates import block_mnemonics, candidates, first_rows, united
from .plans import diff as plan
from .plans import twins
from .plans.registry import HEURISTICS, Heuristic
from .schema import FUNCTION_COLUMNS
from .sources.adapters import pair
from .sources.catalogs import Catalog, Pair

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name; sql follows the catalogs' views."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{twins.VIEWS}\n{sql}"
        return f

    return register


def _heuristic(h: Heuristic) -> Query:
    return lambda spark, sf_dir: candidates(pair(spark, sf_dir), h)


for _h in HEURISTICS:
    QUERIES[f"h{_h.number:02}"] = _heuristic(_h)
    SQL[f"h{_h.number:02}"] = f"{twins.VIEWS}\n{twins.heuristic(_h)}"


# Answers about the catalogs


@query("SELECT 'main' AS side, count(*) AS total FROM main_functions UNION ALL SELECT 'diff', count(*) FROM diff_functions")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.totals(pair(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM main_program m JOIN diff_program d ON m.md5sum = d.md5sum) AS same_md5, (SELECT count(*) FROM (SELECT id, address, size, nodes, edges FROM main_functions EXCEPT SELECT id, address, size, nodes, edges FROM diff_functions)) AS different")
def equal_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.equal_catalogs(pair(spark, sf_dir))


@query("SELECT count(*) > 0 AS same FROM main_program m JOIN diff_program d ON m.processor = d.processor")
def same_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.same_processor(pair(spark, sf_dir))


@query("""SELECT sum(abs(coalesce(a, 0) - coalesce(b, 0)))::double AS different, sum(a)::double AS total, sum(abs(coalesce(a, 0) - coalesce(b, 0))) * 100 / sum(a)::double AS percent
FROM (SELECT unnest(map_keys(primes)) AS p, unnest(map_values(primes)) AS a FROM main_program) FULL JOIN (SELECT unnest(map_keys(primes)) AS p, unnest(map_values(primes)) AS b FROM diff_program) USING (p)""")
def callgraph_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.callgraph_difference(pair(spark, sf_dir))


def _share_sql(key: str, test: str) -> str:
    return f"SELECT *, percent {test} AS mode FROM (SELECT pairs, total, pairs * 100.0::double / total AS percent FROM (SELECT (SELECT count(*) FROM main_functions f JOIN diff_functions df ON f.{key} = df.{key}) AS pairs, (SELECT count(*) FROM main_functions) AS total))"


@query(_share_sql("address", ">= 99"))
def mode_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stripped_mode(pair(spark, sf_dir))


@query(_share_sql("mangled_function", "> 90"))
def mode_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.patch_mode(pair(spark, sf_dir))


# Passes

_KEY = ", ".join(stages.EQUAL)


def _renumbered(pair_: Pair) -> Pair:
    """The diff catalog with main's rows of every third id, so that some functions are wholly equal."""
    own = pair_.main.functions.where("id % 3 = 0")
    rest = pair_.diff.functions.where("id % 3 <> 0")
    return Pair(pair_.main, Catalog(own.unionByName(rest), pair_.diff.tables))


@query(f"SELECT address AS ea1, mangled_function AS name1, address AS ea2, mangled_function AS name2, '100% equal' AS description, nodes AS nodes1, nodes AS nodes2, id AS id1, id AS id2 FROM (SELECT {_KEY} FROM main_functions INTERSECT (SELECT {_KEY} FROM main_functions WHERE id % 3 = 0 UNION ALL SELECT {_KEY} FROM diff_functions WHERE id % 3 <> 0))")
def equal_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.equal_matches(_renumbered(pair(spark, sf_dir)))


@query(f"SELECT DISTINCT {twins.found('Same binary with symbols stripped')} FROM main_functions f JOIN diff_functions df ON f.address = df.address")
def stripped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.stripped_matches(pair(spark, sf_dir))


@query(f"SELECT DISTINCT {twins.found('Perfect match, same name')} FROM main_functions f, diff_functions df WHERE (f.mangled_function = df.mangled_function OR f.name = df.name) AND f.name NOT ILIKE 'nullsub_%' AND NOT starts_with(f.mangled_function, 'sub_')")
def same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.same_name(pair(spark, sf_dir))


@query(f"{twins.items(HEURISTICS)} SELECT {twins.found('Renamed or anonymous function match in patch diffing session')} FROM main_functions f, diff_functions df WHERE f.nodes >= 3 AND df.nodes >= 3 AND starts_with(f.name, 'sub_') AND f.name NOT IN (SELECT name1 FROM items) AND df.name NOT IN (SELECT name2 FROM items)")
def remaining_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return stages.remaining_functions(p, items(p))


@query(f"""SELECT {twins.found('Nodes, edges, complexity and mnemonics with small differences')} FROM main_functions f JOIN diff_functions df USING (nodes, edges, mnemonics, cyclomatic_complexity)
WHERE f.names <> '[]' AND len(list_intersect(from_json(f.names, '["varchar"]'), from_json(df.names, '["varchar"]'))) / greatest(len(from_json(f.names, '["varchar"]')), len(from_json(df.names, '["varchar"]'))) >= 0.5""".replace("f.nodes AS nodes1, df.nodes AS nodes2", "nodes AS nodes1, nodes AS nodes2"))
def small_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.small_differences(pair(spark, sf_dir))


def items(p: Pair) -> DataFrame:
    """Matches for the operators on them: some heuristics' rows with a ratio made from the ids.

    What the heuristics read of a function is short; it is written once, so that whoever reads the matches again does not
    go through the texts.
    """
    p = Pair(*[Catalog(materialize(s.functions.select(*ITEM_COLUMNS))) for s in p.sides()])
    rows = united(p, [HEURISTICS[n] for n in twins.ITEM_HEURISTICS], spread=True)
    ratio = F.when(F.col("description") == "Bytes hash", 1.0).otherwise(((F.col("id1") * 7 + F.col("id2") * 13) % 60 + 40) / 100)
    rows = rows.withColumn("ratio", ratio).withColumn("category", F.when(F.col("ratio") == 1, "best").when(F.col("ratio") >= 0.5, "partial").otherwise("unreliable"))
    return rows.withColumn("seq", F.col("id1") * 100000 + F.col("id2") * 10 + F.length("description") % 9).select(*state.MATCH)


#: What they need of functions.
ITEM_COLUMNS = "id address name nodes md_index instructions bytes_hash pseudocode_hash1 pseudocode_hash2 pseudocode_hash3 pseudocode_lines source_file mnemonics_spp".split()
_ITEMS = twins.items(HEURISTICS)


@query(f"""{_ITEMS}, likely AS (SELECT DISTINCT id1, id2 FROM items WHERE category IN ('best', 'partial') AND ratio >= 0.8), shared AS (
  SELECT DISTINCT constant FROM (SELECT unnest(list_intersect(from_json(a.constants, '["varchar"]'), from_json(b.constants, '["varchar"]'))) AS constant FROM likely JOIN main_functions a ON a.id = id1 JOIN diff_functions b ON b.id = id2 WHERE a.constants_count > 0 AND b.constants_count > 0)
  WHERE coalesce(try_cast(nullif(regexp_extract(constant, '^[0-9]+'), '') AS double), 0) = 0)
SELECT DISTINCT {twins.found('Same constants related matches')} FROM shared s JOIN main_constants mc ON mc.constant = s.constant JOIN diff_constants dc ON dc.constant = s.constant JOIN main_functions f ON f.id = mc.func_id JOIN diff_functions df ON df.id = dc.func_id""")
def related_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return stages.related_constants(p, stages.seeds(items(p)))


@query(f"""{_ITEMS}, likely AS (SELECT DISTINCT id1, id2 FROM items WHERE category IN ('best', 'partial') AND ratio >= 0.8), ranges AS (
  SELECT DISTINCT mu.start_ea::double AS l1, mu.end_ea::double AS h1, du.start_ea::double AS l2, du.end_ea::double AS h2
  FROM likely JOIN main_compilation_unit_functions ml ON ml.func_id = id1 JOIN main_compilation_units mu ON mu.id = ml.cu_id JOIN diff_compilation_unit_functions dl ON dl.func_id = id2 JOIN diff_compilation_units du ON du.id = dl.cu_id)
SELECT DISTINCT {twins.found('Related compilation unit')} FROM ranges JOIN main_functions f ON f.ea BETWEEN l1 AND h1 JOIN diff_functions df ON df.ea BETWEEN l2 AND h2""")
def related_cu(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return stages.related_units(p, stages.seeds(items(p)))


@query(f"""{_ITEMS}, ordered AS (
  SELECT ea1 AS b1, ea2 AS b2, lag(ea1) OVER w AS a1, lag(ea2) OVER w AS a2 FROM items WHERE category IN ('best', 'partial') WINDOW w AS (ORDER BY ea1::bigint, ea2::bigint)
), gaps AS (SELECT DISTINCT a1, b1, a2, b2 FROM ordered WHERE a1 IS NOT NULL),
s1 AS (SELECT g.*, f.id FROM gaps g JOIN main_functions f ON f.address > a1 AND f.address < b1), s2 AS (SELECT g.*, f.id FROM gaps g JOIN diff_functions f ON f.address > a2 AND f.address < b2),
n1 AS (SELECT a1, b1, a2, b2 FROM s1 GROUP BY ALL HAVING count(*) <= 100), n2 AS (SELECT a1, b1, a2, b2 FROM s2 GROUP BY ALL HAVING count(*) <= 100)
SELECT DISTINCT {twins.found('Local affinity')} FROM s1 JOIN n1 USING (a1, b1, a2, b2) JOIN n2 USING (a1, b1, a2, b2) JOIN s2 USING (a1, b1, a2, b2) JOIN main_functions f ON f.id = s1.id JOIN diff_functions df ON df.id = s2.id
WHERE NOT starts_with(f.name, 'nullsub_') AND NOT starts_with(df.name, 'nullsub_') AND (starts_with(f.name, 'sub_') OR starts_with(df.name, 'sub_')) AND NOT (f.pseudocode_lines + df.pseudocode_lines <> 0 AND (f.pseudocode_lines = 3 OR df.pseudocode_lines = 3))""")
def local_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return stages.local_affinity(p, items(p))


@query(f"""{_ITEMS}, one AS (SELECT name FROM main_functions GROUP BY name HAVING count(*) = 1), two AS (SELECT name FROM diff_functions GROUP BY name HAVING count(*) = 1)
SELECT DISTINCT {twins.found('Callee found diffing matches assembly')} FROM (SELECT DISTINCT id1, id2 FROM items) JOIN main_functions f ON f.id = id1 + 1 JOIN diff_functions df ON df.id = id2 + 1
WHERE f.name <> df.name AND f.name IN (FROM one) AND df.name IN (FROM two) AND (f.name, df.name) NOT IN (SELECT (name1, name2) FROM items) AND least(f.nodes, df.nodes) >= 3 AND least(f.nodes, df.nodes) * 100 >= greatest(f.nodes, df.nodes) * 25""")
def callee_diffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each function calls the next one, so the callees of a match replace each other in its texts."""
    p = pair(spark, sf_dir)

    def calling(side: Catalog) -> Catalog:
        after = side.functions.select((F.col("id") - 1).alias("id"), F.concat(F.lit("push\ncall "), "name", F.lit("\nret")).alias("assembly"))
        return Catalog(side.functions.drop("assembly").join(after, "id", "left"), side.tables)

    return stages.callee_matches(Pair(calling(p.main), calling(p.diff)), items(p), "assembly")


@query()
def interesting_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return stages.interesting_changes(p, items(p))


# Similarity


@query(f"{_ITEMS}, {twins.PAIRS}, {twins.RATIOS} SELECT * FROM ratios")
def quick_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return similarity.quick_ratios(p, items(p))


@query(f"{_ITEMS}, {twins.PAIRS} SELECT id1, id2, {twins.DEEP} AS deep FROM pairs JOIN main_functions f ON f.id = id1 JOIN diff_functions df ON df.id = id2")
def deep_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    rows = items(p).select("id1", "id2").distinct().join(p.main.functions.alias("f"), F.col("id1") == F.col("f.id")).join(p.diff.functions.alias("df"), F.col("id2") == F.col("df.id"))
    return rows.select("id1", "id2", similarity.deep_score(True).alias("deep"))


@query(f"{_ITEMS}, {twins.PAIRS}, {twins.RATIOS}, {twins.SCORES} SELECT * FROM scores")
def check_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return similarity.scores(p, items(p))


# Matches


@query(f"{_ITEMS} {twins.CLEANUP}")
def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.cleanup(items(pair(spark, sf_dir))).select(*state.MATCH)


@query(f"{_ITEMS}, {twins.FINAL} SELECT * FROM final")
def final_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.final_pass(items(pair(spark, sf_dir)))


@query(f"{_ITEMS}, {twins.FINAL} SELECT ea1, ea2, ratio FROM final WHERE category = 'multimatch'")
def multimatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.final_pass(items(pair(spark, sf_dir))).where("category = 'multimatch'").select("ea1", "ea2", "ratio")


@query(f"{_ITEMS} SELECT 'secondary' AS side, address, name FROM main_functions WHERE name NOT IN (SELECT name1 FROM items) UNION ALL SELECT 'primary', address, name FROM diff_functions WHERE name NOT IN (SELECT name2 FROM items)")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    found = items(p)
    sides = [state.unmatched(s.functions, found, n).select(F.lit(label).alias("side"), "address", "name") for s, n, label in ((p.main, 1, "secondary"), (p.diff, 2, "primary"))]
    return sides[0].unionByName(sides[1])


_ENTRY = "MAP {{{0}: {{'partner': {1}, 'stored': CASE WHEN name1 = name2 THEN 1.0 ELSE ratio END}}}}"
_EMPTY = "MAP([]::varchar[], []::STRUCT(partner varchar, stored double)[])"


@query(f"""{_ITEMS}, numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY seq, id1, id2) AS k FROM items WHERE NOT starts_with(name1, 'nullsub_') AND NOT starts_with(name2, 'nullsub_')
), one_by_one AS (
  WITH RECURSIVE step AS (
    SELECT 0::bigint AS k, false AS stands, {_EMPTY} AS one, {_EMPTY} AS two
    UNION ALL
    SELECT k, stands, CASE WHEN stands THEN map_concat(one, {_ENTRY.format("name1", "name2")}) ELSE one END, CASE WHEN stands THEN map_concat(two, {_ENTRY.format("name2", "name1")}) ELSE two END
    FROM (SELECT n.*, s.one, s.two, coalesce(one[name1].stored, 0) <> 1 AND coalesce(two[name2].stored, 0) <> 1 AND CASE WHEN NOT starts_with(name1, 'sub_') AND NOT starts_with(name2, 'sub_') AND one[name1] IS NOT NULL
      THEN one[name1].partner <> name1 ELSE coalesce(one[name1].stored, 0) <= ratio AND coalesce(two[name2].stored, 0) <= ratio END AS stands FROM step s JOIN numbered n ON n.k = s.k + 1)
  ) SELECT k FROM step WHERE stands
) SELECT {twins._MATCH} FROM numbered WHERE k IN (SELECT k FROM one_by_one)""")
def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.take(items(pair(spark, sf_dir)), None)


@query(f"{_ITEMS} SELECT category, description, count(*) AS n FROM items GROUP BY ALL")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.category_counts(items(pair(spark, sf_dir)))


@query(f"{_ITEMS} SELECT category, count(DISTINCT ea1) AS n, count(DISTINCT ea1) * 100.0::double / (SELECT count(*) FROM main_functions) AS percent FROM items GROUP BY category")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return state.summary(items(p), p.main.functions.count())


@query(f"""{_ITEMS}, ranked AS (
  SELECT *, list_position(['best', 'partial', 'unreliable', 'multimatch'], category) AS place, row_number() OVER (PARTITION BY category ORDER BY ratio DESC, seq, id1, id2) - 1 AS line_number FROM items)
SELECT category AS type, printf('%05d', line_number) AS line, printf('%08x', ea1::bigint) AS address, name1 AS name, printf('%08x', ea2::bigint) AS address2, name2, printf('%.7f', ratio) AS ratio, nodes1::varchar AS nodes1, nodes2::varchar AS nodes2, description
FROM (SELECT *, row_number() OVER (PARTITION BY ea1, ea2 ORDER BY place, line_number) AS nth FROM ranked) WHERE nth = 1""")
def results_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.result_rows(items(pair(spark, sf_dir)))


@query(f"""{_ITEMS} SELECT type, printf('%05d', row_number() OVER (PARTITION BY type ORDER BY address::bigint, address) - 1) AS line, printf('%08x', address::bigint) AS address, name
FROM (SELECT 'secondary' AS type, address, name FROM main_functions WHERE name NOT IN (SELECT name1 FROM items) UNION ALL SELECT 'primary', address, name FROM diff_functions WHERE name NOT IN (SELECT name2 FROM items))""")
def unmatched_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    found = items(p)
    return results.unmatched_rows(state.unmatched(p.main.functions, found, 1), state.unmatched(p.diff.functions, found, 2))


@query(f"""{_ITEMS} SELECT category, ea1, name1, ea2, name2, description, CAST(printf('%.7f', ratio) AS double) AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY ea1, ea2 ORDER BY {twins._ORDER}) AS nth FROM items) WHERE nth = 1""")
def results_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.read_results(results.result_rows(items(pair(spark, sf_dir)))).drop("place")


@query(f"{_ITEMS}, ranked AS {SQL['results_sink'].rpartition('ranked AS')[2].partition('SELECT category AS type')[0]}, written AS (SELECT category AS type, {SQL['results_sink'].rpartition('SELECT category AS type,')[2]}) SELECT * FROM written ORDER BY ratio::double, address, address2 LIMIT 20")
def weakest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.weakest(results.result_rows(items(pair(spark, sf_dir))))


@query(f"SELECT * FROM ({twins.heuristic(HEURISTICS[41])}) ORDER BY taken, id1, id2 LIMIT 500")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(candidates(pair(spark, sf_dir), HEURISTICS[41]), 500)


@query()
def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole diff of the two catalogs, which are made from the test tables first."""
    made = [Catalog(materialize(s.functions), {n: materialize(t) for n, t in s.tables.items()}) for s in pair(spark, sf_dir).sides()]
    return plan.diff(Pair(*made)).results()


# Labels


def _labelled(p: Pair) -> Pair:
    """Main with a portable name for each function, diff with one for every fourth."""
    name = lambda c: F.concat(F.lit("fn_"), (F.col("id") % c).cast("string"))
    main = p.main.functions.withColumn("name", F.when(F.col("id") % 5 == 0, F.col("name")).otherwise(name(180)))
    other = p.diff.functions.withColumn("name", F.when(F.col("id") % 4 == 0, name(200)).otherwise(F.col("name")))
    return Pair(Catalog(main, p.main.tables), Catalog(other, p.diff.tables))


def _decisions(p: Pair) -> DataFrame:
    marked = _labelled(p)
    proposals = items(p).withColumn("place", F.struct(F.col("seq"), F.col("id1"), F.col("id2")))
    origins = marked.main.functions.where("id % 7 = 1").select("address", "name", F.lit("1").alias("origin_address"), F.concat("name", F.lit("_0")).alias("origin_name"), (F.col("id") % 4).alias("hops"), F.lit(0.9).alias("cumulative_ratio"))
    return port.decide(proposals, marked.main.functions, marked.diff.functions, origins, port.Options(min_confidence=0.5, max_hops=3))


def _decisions_sql(rounds: int = 4) -> str:
    """The rules, and as many rounds of taking back names that occur twice as the test tables need."""
    portable = twins.PORTABLE.format
    sql = f"""{_ITEMS}, mains AS (SELECT id, address, mangled_function, CASE WHEN id % 5 = 0 THEN name ELSE concat('fn_', id % 180) END AS name FROM main_functions),
diffs AS (SELECT id, address, mangled_function, CASE WHEN id % 4 = 0 THEN concat('fn_', id % 200) ELSE name END AS name FROM diff_functions),
joined AS (
  SELECT i.category, i.ea1, i.ea2, i.ratio, i.description, i.seq, m.name AS reference_name, m.mangled_function AS reference_mangled, d.name AS name_before, d.mangled_function AS mangled_before,
    CASE WHEN m.id % 7 = 1 THEN m.id % 4 + 1 ELSE 1 END AS hops, CASE WHEN m.id % 7 = 1 THEN 0.9::double ELSE 1 END * i.ratio AS confidence, CASE WHEN m.id % 7 = 1 THEN '1' ELSE i.ea1 END AS origin_address, CASE WHEN m.id % 7 = 1 THEN m.name || '_0' ELSE m.name END AS origin_name,
    i.category IN ('best', 'partial') AS selected, row_number() OVER (PARTITION BY i.ea2, i.category IN ('best', 'partial') ORDER BY i.seq, i.id1, i.id2) AS claim
  FROM items i JOIN mains m ON m.address = i.ea1 JOIN diffs d ON d.address = i.ea2
), r0 AS (
  SELECT *, CASE WHEN NOT selected THEN 'not_selected' WHEN claim > 1 THEN 'skipped_conflict' WHEN NOT {portable('reference_name')} THEN 'skipped_not_portable' WHEN {portable('name_before')} AND reference_name = name_before THEN 'confirmed'
    WHEN hops > 3 THEN 'skipped_hops' WHEN confidence < 0.5 THEN 'skipped_ratio' WHEN {portable('name_before')} THEN 'skipped_existing' ELSE 'applied' END AS action FROM joined
), w0 AS (SELECT *, CASE WHEN action = 'applied' THEN CASE WHEN {portable('reference_mangled')} THEN reference_mangled ELSE reference_name END END AS written_mangled FROM r0)"""
    for k in range(rounds):
        sql += f""", a{k} AS (SELECT coalesce(w.reference_name, d.name) AS name, coalesce(w.written_mangled, d.mangled_function) AS mangled FROM diffs d LEFT JOIN (SELECT * FROM w{k} WHERE action = 'applied') w ON w.ea2 = d.address),
n{k} AS (SELECT name FROM a{k} WHERE {portable('name')} GROUP BY name HAVING count(*) > 1), m{k} AS (SELECT mangled FROM a{k} WHERE {portable('mangled')} GROUP BY mangled HAVING count(*) > 1),
w{k + 1} AS (SELECT * REPLACE (CASE WHEN back THEN 'skipped_duplicate_name' ELSE action END AS action, CASE WHEN back THEN NULL ELSE written_mangled END AS written_mangled) FROM (SELECT w{k}.* EXCLUDE (back), action = 'applied' AND (reference_name IN (FROM n{k}) OR written_mangled IN (FROM m{k})) AS back FROM w{k}))""".replace("w0.* EXCLUDE (back)", "w0.*")
    counted = "action IN ('not_selected', 'skipped_conflict', 'skipped_not_portable', 'confirmed')"
    return f"{sql}, decided AS (SELECT category, ea1, ea2, ratio, description, action, reference_name, reference_mangled, name_before, mangled_before, CASE WHEN {counted} THEN NULL ELSE hops END AS hops, CASE WHEN {counted} THEN NULL ELSE confidence END AS confidence, CASE WHEN {counted} THEN NULL ELSE origin_address END AS origin_address, CASE WHEN {counted} THEN NULL ELSE origin_name END AS origin_name, written_mangled FROM w{rounds})"


_DECIDED = _decisions_sql()


@query(f"{_DECIDED} SELECT * REPLACE (coalesce(hops, 0) AS hops, coalesce(confidence, 0) AS confidence) FROM decided")
def port_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(pair(spark, sf_dir)).drop("place", "first_labelled_at").fillna(0, ["hops"]).fillna(0.0, ["confidence"])


@query(f"{_DECIDED} SELECT action, count(*) AS n FROM decided GROUP BY action")
def port_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return port.action_counts(_decisions(pair(spark, sf_dir)))


@query(f"{_DECIDED} SELECT d.address, coalesce(w.reference_name, d.name) AS name, coalesce(w.written_mangled, d.mangled_function) AS mangled_function FROM diffs d LEFT JOIN (SELECT * FROM decided WHERE action = 'applied') w ON w.ea2 = d.address")
def labelled_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return port.labelled(_labelled(p).diff.functions.select("address", "name", "mangled_function"), _decisions(p))


@query(f"{_DECIDED} SELECT 2::bigint AS hop, 'v2' AS source, 'v1 -> v2 -> v3' AS lineage, count(*) AS proposals, count(*) FILTER (WHERE action = 'applied') AS applied, count(*) FILTER (WHERE action = 'confirmed') AS confirmed FROM decided UNION ALL SELECT 1, 'v1', 'v1 -> v2', 9, 5, 1")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = spark.range(1).select(F.lit(1).cast("long").alias("hop"), F.lit("v1").alias("source"), F.lit("v1 -> v2").alias("lineage"), F.lit(9).cast("long").alias("proposals"), F.lit(5).cast("long").alias("applied"), F.lit(1).cast("long").alias("confirmed"))
    return port.provenance(before, "v2", "v3", _decisions(pair(spark, sf_dir)))


@query(f"{_DECIDED} SELECT hops, count(*) AS names, min(confidence) AS least, round(avg(confidence), 9) AS mean, 0::bigint AS hop FROM decided WHERE action = 'applied' GROUP BY hops")
def catalog_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "hop long")
    return port.inspect(none, port.name_origins(_decisions(pair(spark, sf_dir)))).withColumn("mean", F.round("mean", 9))


# Evaluation


def _two_results(p: Pair) -> tuple[DataFrame, DataFrame]:
    rows = results.result_rows(items(p))
    return rows.where("substr(address, 8, 1) <> '0' OR nodes1 <> nodes2"), rows.where("substr(address2, 7, 1) <> '3'").withColumn("ratio", F.when(F.col("nodes1") == F.col("nodes2"), F.lit("1.0000000")).otherwise(F.col("ratio")))


_RESULTS = SQL["results_sink"].removeprefix(twins.VIEWS)
_RESULTS = _RESULTS[: _RESULTS.rindex("SELECT category AS type")] + ", written AS (" + _RESULTS[_RESULTS.rindex("SELECT category AS type") :] + "), ra AS (SELECT * FROM written WHERE substr(address, 8, 1) <> '0' OR nodes1 <> nodes2), rb AS (SELECT * REPLACE (CASE WHEN nodes1 = nodes2 THEN '1.0000000' ELSE ratio END AS ratio) FROM written WHERE substr(address2, 7, 1) <> '3')"


@query(f"{_RESULTS} SELECT (SELECT count(*) FROM (SELECT address, address2, ratio FROM ra EXCEPT ALL SELECT address, address2, ratio FROM rb)) AS only_a, (SELECT count(*) FROM (SELECT address, address2, ratio FROM rb EXCEPT ALL SELECT address, address2, ratio FROM ra)) AS only_b")
def compare_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.same_rows(*_two_results(pair(spark, sf_dir)), ["address", "address2", "ratio"], numbers=True)


@query(f"{_RESULTS} SELECT coalesce(ra.type, rb.type) AS type, coalesce(ra.description, rb.description) AS description, count(*) FILTER (WHERE ra.type IS NOT NULL AND rb.type IS NOT NULL) AS both, count(*) FILTER (WHERE ra.ratio = rb.ratio) AS same_ratio, count(*) FILTER (WHERE rb.type IS NULL) AS only_a, count(*) FILTER (WHERE ra.type IS NULL) AS only_b FROM ra FULL JOIN rb ON ra.address = rb.address AND ra.address2 = rb.address2 GROUP BY 1, 2")
def results_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.agreement(*_two_results(pair(spark, sf_dir)))


@query("SELECT coalesce(f.address, df.address) AS address, CASE WHEN f.address IS NOT NULL AND df.address IS NOT NULL THEN 'both' WHEN f.address IS NOT NULL THEN 'named_only' ELSE 'stripped_only' END AS status, f.name, f.mangled_function, df.name AS stripped_name FROM main_functions f FULL JOIN diff_functions df ON f.address = df.address")
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    return evaluate.ground_truth(p.main.functions, p.diff.functions)


_TRUTH = f"{_DECIDED}, labels_now AS (SELECT d.address, coalesce(w.reference_name, d.name) AS own FROM diffs d LEFT JOIN (SELECT * FROM decided WHERE action = 'applied') w ON w.ea2 = d.address), judged AS (SELECT CASE WHEN coalesce({twins.PORTABLE.format('name')}, false) AND {twins.PORTABLE.format('own')} THEN CASE WHEN own = name OR own = mangled_function THEN 'correct' ELSE 'wrong' END WHEN coalesce({twins.PORTABLE.format('name')}, false) THEN 'missed' WHEN {twins.PORTABLE.format('own')} THEN 'extra' END AS v FROM labels_now LEFT JOIN mains m USING (address))"


@query(f"{_TRUTH} SELECT *, correct / nullif(correct + wrong, 0) AS precision, correct / nullif(correct + wrong + missed, 0) AS recall FROM (SELECT count(*) FILTER (WHERE v = 'correct') AS correct, count(*) FILTER (WHERE v = 'wrong') AS wrong, count(*) FILTER (WHERE v = 'missed') AS missed, count(*) FILTER (WHERE v = 'extra') AS extra FROM judged)")
def score_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pair(spark, sf_dir)
    marked = _labelled(p)
    truth = evaluate.ground_truth(marked.main.functions, marked.diff.functions)
    return evaluate.label_scores(truth, port.labelled(marked.diff.functions.select("address", "name", "mangled_function"), _decisions(p)))


@query("SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM (SELECT count(*) FILTER (WHERE q = 1 AND p) AS tp, count(*) FILTER (WHERE q <> 1 AND p) AS fp, count(*) FILTER (WHERE q = 1 AND NOT p) AS fn, count(*) FILTER (WHERE q <> 1 AND NOT p) AS tn FROM (SELECT quality AS q, n_chars > 1000 AS p FROM labels JOIN documents USING (doc_id)))")
def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return evaluate.confusion(read("labels").join(read("documents").select("doc_id", "n_chars"), "doc_id"), F.col("quality") == 1, F.col("n_chars") > 1000)


_CENSUS = tuple(FUNCTION_COLUMNS)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, sum(('0x' || substr(md5(concat_ws('=', id::varchar, coalesce({c}::varchar, 'null'))), 1, 8))::bigint)::bigint AS digest FROM main_functions" for c in _CENSUS))
def column_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.census(pair(spark, sf_dir).main.functions.select(*_CENSUS), "id")


@query(f"SELECT name, starts_with(name, 'sub_') AS auto, {twins.PORTABLE.format('name')} AS portable, printf('%08x', address::bigint) AS hex, try_cast(md_index AS double) AS md FROM main_functions")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return pair(spark, sf_dir).main.functions.select("name", names.is_auto(c("name")).alias("auto"), names.is_portable(c("name")).alias("portable"), names.hex8(c("address")).alias("hex"), names.md_value(c("md_index")).alias("md"))


@query("SELECT func, list, total FROM (SELECT b.basic_block_id, min(i.func_id) AS func, string_agg(i.mnemonic, ',' ORDER BY b.id) AS list, count(*) AS total FROM main_bb_instructions b JOIN main_instructions i ON b.instruction_id = i.id GROUP BY 1)")
def block_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_mnemonics(pair(spark, sf_dir).main)


# Graphs: blocks are the line items of an order's customer, edges follow the order of line numbers


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_partkey % 500 AS func_id", "CAST(l_linenumber AS long) AS src", "l_suppkey % 9 AS dst")
    ends = rows.select("func_id", F.col("src").alias("block")).union(rows.select("func_id", "dst")).distinct()
    return ends, rows.distinct()


@query()
def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_features(*_graph(spark, sf_dir))


@query()
def basic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as instructions: the part's number makes the function, the order of their keys the place, the supplier the role and target."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_partkey % 500 AS func_id", "l_orderkey", "l_linenumber", "l_suppkey")
    place = F.row_number().over(Window.partitionBy("func_id").orderBy("l_orderkey", "l_linenumber", "l_suppkey")).cast("long") - 1
    role = "element_at(array('normal', 'call', 'branch', 'normal', 'conditional', 'normal', 'return', 'conditional', 'normal'), CAST(l_suppkey % 9 + 1 AS int))"
    listing = rows.withColumn("offset", place).select("func_id", "offset", F.lit(1).cast("long").alias("size"), F.expr(role).alias("role"), (F.col("l_suppkey") * 7 % 40).alias("target"))
    return graph.basic_blocks(listing)


QUERIES["graph_degrees"] = lambda spark, sf_dir: graph.degrees(_graph(spark, sf_dir)[1])
SQL["graph_degrees"] = """WITH e AS (SELECT DISTINCT l_partkey % 500 AS func_id, l_linenumber::bigint AS src, l_suppkey % 9 AS dst FROM lineitem)
SELECT func_id, block, sum(i)::bigint AS indegree, sum(o)::bigint AS outdegree FROM (SELECT func_id, src AS block, 0 AS i, 1 AS o FROM e UNION ALL SELECT func_id, dst, 1, 0 FROM e) GROUP BY ALL"""
