"""The test tables seen as two catalogs: documents are functions, even ids one version and odd ids the other.

Every tenth function of the odd version is the even one's of the same id, as versions have much in common. Lines of
lineitem give constants, lines of documents instructions. The same expressions make the views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..schema import VERSION
from .catalogs import Catalog, Pair

#: What a function has from its document.
OWN = ("text", "lang", "source", "n_chars")
#: Functions of a compilation unit, instructions of a basic block.
UNIT, BLOCK = 40, 7
#: Primes of each version's call graph.
PRIMES = ((2, 3, 7), (2, 5, 7))
#: What the two engines spell differently.
SPARK = {"lines": r"size(split(text, '\n', -1))", "words": "size(split(text, ' ', -1))", "digits": "regexp_replace({0}, '[0-9]', '#')", "list": "to_json(array_sort(array_distinct(regexp_extract_all(text, '{0}', 0))))", "count": "size(array_distinct(regexp_extract_all(text, '{0}', 0)))", "text": "string", "div": "div"}
DUCKDB = {"lines": "len(string_split(text, chr(10)))", "words": "len(string_split(text, ' '))", "digits": "regexp_replace({0}, '[0-9]', '#', 'g')", "list": "CAST(to_json(list_sort(list_distinct(regexp_extract_all(text, '{0}')))) AS varchar)", "count": "len(list_distinct(regexp_extract_all(text, '{0}')))", "text": "varchar", "div": "//"}
_NAMES, _NUMBERS = "[A-Z][a-z]{4,7}", "[0-9]{2,}|[a-z]{14,}"


def _columns(d: dict[str, str], side: int) -> dict[str, str]:
    """The columns of functions as SQL over documents with id."""
    text = lambda e: f"CAST({e} AS {d['text']})"
    lines, words = d["lines"], d["words"]
    micro, fuzzy = "replace(text, 'a', 'o')", lambda *parts: f"md5(concat(lang, ':', {', '.join(parts)}))"
    integer = lambda e: f"CAST({e} AS bigint)"
    name = f"CASE WHEN id % 2 = 0 THEN concat('sub_', hex(4096 + 16 * id)) ELSE concat(lang, '_', substr(md5(text), 1, 10)) END"
    return {
        "id": "id", "name": name, "address": text(f"4096 + 16 * id + {4 * side} * CAST(id % 10 = 0 AS int)"), "nodes": integer(lines), "edges": integer(f"{lines} + n_chars % 3"), "indegree": integer("id % 5"), "outdegree": integer("n_chars % 4"),
        "size": "n_chars", "instructions": integer(f"{words} % 40 + 4"), "mnemonics": f"concat('[\"m', {text('n_chars % 5')}, '\"]')", "names": d["list"].format(_NAMES), "prototype": "'int()'",
        "cyclomatic_complexity": integer(f"n_chars % 60 + {lines} % 3"), "primes_value": text("n_chars % 9"), "comment": "''", "mangled_function": f"CASE WHEN id % 3 = 0 THEN concat('_Z', substr(md5(text), 1, 12)) ELSE {name} END",
        "bytes_hash": "md5(text)", "pseudocode": "text", "pseudocode_lines": integer(lines), "pseudocode_hash1": fuzzy(f"{words} % 16", "':'", f"{lines} % 6"), "pseudocode_primes": "concat(md5(lower(text)), '0000')",
        "function_flags": "CAST(0 AS bigint)", "assembly": "lower(text)", "prototype2": "CASE WHEN n_chars % 3 = 0 THEN 'int(int)' ELSE 'int()' END", "pseudocode_hash2": fuzzy("n_chars % 12", "':'", f"{lines} % 6"), "pseudocode_hash3": fuzzy(f"{words} % 12", "':'", "n_chars % 9"),
        "strongly_connected": integer("n_chars % 7"), "loops": integer("n_chars % 23"), "rva": text("16 * id"), "tarjan_topological_sort": f"concat('[', {text(lines)}, ', ', {text('n_chars % 11')}, ']')", "strongly_connected_spp": text("n_chars % 7 * 11"),
        "clean_assembly": d["digits"].format("lower(text)"), "clean_pseudo": d["digits"].format("text"), "mnemonics_spp": text(f"{words} * 31 + n_chars % 3"), "switches": f"CASE WHEN n_chars % 8 = 0 THEN concat('[[', {text(lines)}, ']]') ELSE '[]' END",
        "function_hash": "md5(lower(text))", "bytes_sum": "n_chars", "md_index": f"CASE WHEN n_chars % 6 = 0 THEN '0' ELSE concat({text('n_chars % 97')}, '.25') END", "constants": d["list"].format(_NUMBERS), "constants_count": integer(d["count"].format(_NUMBERS)),
        "segment_rva": text("16 * (id % 8)"), "assembly_addrs": "'[]'", "kgh_hash": f"CASE WHEN n_chars % 10 = 0 THEN '0' ELSE {text(f'(n_chars % 101) * {lines}')} END", "source_file": "substr(source, 1, 4)", "userdata": "''",
        "microcode": micro, "clean_microcode": d["digits"].format(micro), "microcode_spp": f"CASE WHEN n_chars % 4 = 0 THEN '1' ELSE {text(f'n_chars % 89 * {lines}')} END", "export_time": "CAST(0 AS double)",
    }


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in columns.items()]


def _side(spark: SparkSession, sf_dir: str, side: int) -> Catalog:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    documents = read("documents").where(F.col("doc_id") % 2 == side).withColumn("id", F.expr("doc_id div 2"))
    if side:
        kept = read("documents").where("doc_id % 2 = 0 AND doc_id div 2 % 10 = 7").select(F.expr("doc_id div 2").alias("id"), F.struct(*OWN).alias("same"))
        taken = documents.where("id % 10 = 7").join(kept, "id", "left").select("doc_id", "id", *[F.when(F.col("same").isNull(), F.col(c)).otherwise(F.col(f"same.{c}")).alias(c) for c in OWN])
        documents = documents.where("id % 10 <> 7").select("doc_id", "id", *OWN).unionByName(taken)  # the texts of the others are not shuffled
    functions = documents.selectExpr(*_select(_columns(SPARK, side)))
    instructions = documents.select(F.col("id").alias("func_id"), F.posexplode(F.split("text", "\n", -1)).alias("k", "disasm"))
    instructions = instructions.select((F.col("func_id") * 1_000_000 + F.col("k")).alias("id"), "func_id", "k", "disasm", F.concat(F.lit("m"), F.char_length("disasm") % 3).alias("mnemonic"))
    blocks = instructions.select("id", F.expr(f"func_id * 1000000 + k div {BLOCK}").alias("basic_block_id"), F.col("id").alias("instruction_id"))
    units = documents.groupBy(F.expr(f"id div {UNIT}").alias("id")).agg(F.count("*").alias("functions"), F.min("id").alias("low"), F.max("id").alias("high"))
    units = units.selectExpr("id", "CASE WHEN id % 4 = 3 THEN '' ELSE concat('unit', id) END AS name", "functions", "CAST(id % 5 AS string) AS primes_value", "CAST(id % 7 AS string) AS pseudocode_primes", "CAST(4096 + 16 * low AS string) AS start_ea", "CAST(4096 + 16 * high AS string) AS end_ea")
    constants = read("lineitem").where(F.col("l_orderkey") % 2 == side).selectExpr("l_orderkey AS id", "l_partkey AS func_id", "concat(CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'k' END, l_suppkey, '_', l_linenumber) AS constant")
    constants = constants.unionByName(functions.select("id", F.col("id").alias("func_id"), F.explode(F.from_json("constants", "array<string>")).alias("constant")))
    primes = ", ".join(f"'{p}', count_if(n_chars % {p} = 0)" for p in PRIMES[side])
    program = documents.selectExpr(f"to_json(map({primes})) AS primes", "concat('cpu', count(DISTINCT lang)) AS cpu", "md5(CAST(sum(n_chars) AS string)) AS md5")
    one = lambda row: program.select(*[F.expr(v).cast(t).alias(k) for k, (v, t) in row.items()])
    return Catalog(functions, {
        "instructions": instructions.drop("k"), "bb_instructions": blocks, "compilation_units": units, "constants": constants,
        "compilation_unit_functions": documents.selectExpr("id", f"id div {UNIT} AS cu_id", "id AS func_id"),
        "program": one({"id": ("1", "long"), "callgraph_primes": ("'210'", "string"), "callgraph_all_primes": ("primes", "string"), "processor": ("cpu", "string"), "md5sum": ("md5", "binary")}),
        "version": spark.range(1).select(F.lit(VERSION).alias("value")),
    })


def pair(spark: SparkSession, sf_dir: str) -> Pair:
    """The two catalogs in the test tables of a folder."""
    return Pair(_side(spark, sf_dir, 0), _side(spark, sf_dir, 1))


def duckdb_views() -> str:
    """WITH clause that defines the same catalogs as main_* and diff_* for DuckDB, without a closing comma."""
    out = []
    for side, name in enumerate(("main", "diff")):
        columns = ",\n    ".join(_select(_columns(DUCKDB, side)))
        same = ", ".join(f"CASE WHEN m.doc_id IS NULL THEN d.{c} ELSE m.{c} END AS {c}" for c in OWN)
        kept = f"SELECT d.doc_id, d.doc_id // 2 AS id, {same} FROM documents d LEFT JOIN documents m ON {side} = 1 AND m.doc_id = d.doc_id - 1 AND d.doc_id // 2 % 10 = 7"
        out.append(f"{name}_documents AS ({kept} WHERE d.doc_id % 2 = {side})")
        primes = ", ".join(f"'{p}': count_if(n_chars % {p} = 0)" for p in PRIMES[side])
        out.append(f"{name}_program AS (SELECT MAP {{{primes}}} AS primes, concat('cpu', count(DISTINCT lang)) AS processor, md5(CAST(sum(n_chars) AS varchar)) AS md5sum FROM {name}_documents)")
        out.append(f"{name}_functions AS (SELECT *, TRY_CAST(md_index AS double) AS md, TRY_CAST(address AS double) AS ea FROM (SELECT {columns}\n  FROM {name}_documents))")
        out.append(f"{name}_instructions AS (SELECT func_id * 1000000 + k AS id, func_id, k, disasm, concat('m', length(disasm) % 3) AS mnemonic FROM (SELECT id AS func_id, unnest(string_split(text, chr(10))) AS disasm, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM {name}_documents))")
        out.append(f"{name}_bb_instructions AS (SELECT id, func_id * 1000000 + k // {BLOCK} AS basic_block_id, id AS instruction_id FROM {name}_instructions)")
        out.append(f"{name}_compilation_units AS (SELECT id // {UNIT} AS id, CASE WHEN id // {UNIT} % 4 = 3 THEN '' ELSE concat('unit', id // {UNIT}) END AS name, CAST(id // {UNIT} % 5 AS varchar) AS primes_value, CAST(id // {UNIT} % 7 AS varchar) AS pseudocode_primes, CAST(4096 + 16 * min(id) AS varchar) AS start_ea, CAST(4096 + 16 * max(id) AS varchar) AS end_ea FROM {name}_documents GROUP BY id // {UNIT})")
        out.append(f"{name}_compilation_unit_functions AS (SELECT id, id // {UNIT} AS cu_id, id AS func_id FROM {name}_documents)")
        out.append(f"{name}_constants AS (SELECT l_partkey AS func_id, concat(CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'k' END, l_suppkey, '_', l_linenumber) AS constant FROM lineitem WHERE l_orderkey % 2 = {side} UNION ALL SELECT id, unnest(list_distinct(regexp_extract_all(text, '{_NUMBERS}'))) FROM {name}_documents)")
    return "WITH " + ",\n".join(out)


