"""The tables of a catalog and what must hold in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = "id nodes edges indegree outdegree size instructions cyclomatic_complexity pseudocode_lines function_flags strongly_connected loops bytes_sum constants_count".split()
#: The columns of functions, in order.
FUNCTION_COLUMNS = (
    "id name address nodes edges indegree outdegree size instructions mnemonics names prototype cyclomatic_complexity primes_value comment mangled_function bytes_hash pseudocode pseudocode_lines "
    "pseudocode_hash1 pseudocode_primes function_flags assembly prototype2 pseudocode_hash2 pseudocode_hash3 strongly_connected loops rva tarjan_topological_sort strongly_connected_spp clean_assembly "
    "clean_pseudo mnemonics_spp switches function_hash bytes_sum md_index constants constants_count segment_rva assembly_addrs kgh_hash source_file userdata microcode clean_microcode microcode_spp export_time"
).split()


def _type(column: str) -> T.DataType:
    return T.LongType() if column in _INTEGERS else T.DoubleType() if column == "export_time" else T.StringType()


FUNCTIONS = T.StructType([T.StructField(c, _type(c)) for c in FUNCTION_COLUMNS])
#: The side tables.
SIDE_TABLES = {
    "program": "id long, callgraph_primes string, callgraph_all_primes string, processor string, md5sum binary",
    "version": "value string",
    "program_data": "id long, name string, type string, value string",
    "instructions": "id long, func_id long, address string, disasm string, mnemonic string, comment1 string, comment2 string, operand_names string, name string, type string, pseudocomment string, pseudoitp long, asm_type string",
    "basic_blocks": "id long, num long, address string, asm_type string",
    "bb_relations": "id long, parent_id long, child_id long",
    "bb_instructions": "id long, basic_block_id long, instruction_id long",
    "function_bblocks": "id long, function_id long, basic_block_id long, asm_type string",
    "callgraph": "id long, func_id long, address string, type string",
    "constants": "id long, func_id long, constant string",
    "compilation_units": "id long, name string, functions long, primes_value string, pseudocode_primes string, start_ea string, end_ea string",
    "compilation_unit_functions": "id long, cu_id long, func_id long",
}
#: What a labelled catalog has besides: where its names come from, its hops, and the decisions of the last one.
PROVENANCE_TABLES = {
    "name_origin": "address string, name string, origin_address string, origin_name string, hops long, cumulative_ratio double, heuristic string, first_labelled_at string",
    "provenance": "hop long, source string, lineage string, proposals long, applied long, confirmed long",
    "port_log": "action string, category string, ea1 string, ea2 string, ratio double, description string, reference_name string, name_before string, hops long, confidence double, origin_address string, origin_name string, written_mangled string",
}
#: Fixed value: the version of the catalogs that this engine reads without a warning.
VERSION = "3.4"
REQUIRED = ("program", "version", "instructions", "constants", "compilation_units", "compilation_unit_functions")


def validate(functions: DataFrame) -> list[str]:
    """What is wrong with a functions table: missing columns, wrong types, addresses that are null or repeat. Empty if sound."""
    kinds = dict(functions.dtypes)
    wrong = [f"column {f.name} is missing" for f in FUNCTIONS if f.name not in kinds]
    wrong += [f"column {f.name} is {kinds[f.name]}, not {f.dataType.simpleString()}" for f in FUNCTIONS if kinds.get(f.name, f.dataType.simpleString()) != f.dataType.simpleString()]
    if "address" in kinds:
        counts = functions.groupBy("address").count().agg(F.sum(F.when(F.col("address").isNull(), F.col("count"))).alias("nulls"), F.sum((F.col("address").isNotNull() & (F.col("count") > 1)).cast("long")).alias("repeated")).first()
        wrong += [f"{counts['nulls']} rows have no address"] * bool(counts["nulls"]) + [f"{counts['repeated']} addresses repeat"] * bool(counts["repeated"])
    return wrong


def encoding_flags(functions: DataFrame) -> DataFrame:
    """address and the text columns of each row that are not valid UTF-8."""
    texts = [f.name for f in FUNCTIONS if isinstance(f.dataType, T.StringType) and f.name in functions.columns]
    bad = F.array_compact(F.array(*[F.when(~F.is_valid_utf8(c), F.lit(c)) for c in texts]))
    return functions.select("address", bad.alias("invalid")).where(F.size("invalid") > 0)


def check_version(version: DataFrame) -> list[str]:
    """What a catalog's version table says against it: no row makes the catalog unusable (ValueError), another version is a warning."""
    found = version.select("value").take(1)
    if not found:
        raise ValueError("not a valid catalog: it has no version")
    return [] if found[0]["value"] == VERSION else [f"the catalog is of version {found[0]['value']}, not {VERSION}"]
