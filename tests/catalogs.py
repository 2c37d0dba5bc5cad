"""Small catalogs from a few columns; what is not given is neutral."""

from pairloom.schema import FUNCTIONS, SIDE_TABLES
from pairloom.sources.catalogs import Catalog

NUMBERS = {f.name for f in FUNCTIONS if f.dataType.simpleString() == "bigint"}


def catalog(spark, functions, **tables):
    rows = []
    for k, given in enumerate(functions):
        row = {f.name: 0 if f.name in NUMBERS else 0.0 if f.name == "export_time" else "" for f in FUNCTIONS}
        row |= {"id": k + 1, "address": str(4096 + 16 * k), "rva": str(16 * k), "segment_rva": str(k), "names": "[]", "constants": "[]", "switches": "[]", "mnemonics": "[]", "bytes_hash": f"hash {k} {id(functions)}", "pseudocode": None, "clean_pseudo": None, "microcode": None, "clean_microcode": None, "md_index": "0", "kgh_hash": "0", "microcode_spp": "1"}
        row |= given
        row.setdefault("mangled_function", row["name"])
        row["mangled_function"] = row["mangled_function"] or row["name"]
        rows.append(tuple(row[f.name] for f in FUNCTIONS))
    sides = {"program": [(1, "1", "{}", "cpu", None)], "version": [("3.4",)]} | tables
    return Catalog(spark.createDataFrame(rows, FUNCTIONS), {n: spark.createDataFrame(r, SIDE_TABLES[n]) for n, r in sides.items()})
