"""The fifty heuristics that propose pairs, as declarations.

A heuristic's rows are pairs of functions, f of the main and df of the diff catalog. keys are columns equal on both
sides; where is what else must hold. Which plan computes a shape is in operators.candidates.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Heuristic:
    number: int
    name: str
    #: best, partial or unreliable: which run it belongs to.
    category: str
    #: all (every row is a match of ratio 1), ratio (at least 0.5), least (at least minimum) or trusted.
    consumer: str
    keys: tuple[str, ...] = ()
    where: str = "true"
    minimum: float = 0.5
    #: How rows are ordered before they are taken: by equal source files, or by how many features agree.
    order: str = ""
    distinct: bool = False
    same_cpu: bool = False
    slow: bool = False
    #: Only run when unreliable heuristics are asked for, though not of the unreliable run.
    unreliable: bool = False
    #: plain, either (pseudocode or assembly), rare (keys that few functions have), constants, units, unit_links, assembly or blocks.
    shape: str = "plain"


#: Columns whose texts are long: they are joined by a digest.
LONG_TEXTS = frozenset("assembly clean_assembly pseudocode clean_pseudo microcode clean_microcode mnemonics names constants switches tarjan_topological_sort".split())
#: Columns whose agreement is counted for the order of the graph heuristic.
AGREEMENT = "size instructions mnemonics names prototype2 primes_value bytes_hash pseudocode_hash1 pseudocode_primes pseudocode_hash2 pseudocode_hash3".split()

_EITHER_AUTO = "(substr(f.name, 1, 4) = 'sub_' OR substr(df.name, 1, 4) = 'sub_')"
_SAME_OR_AUTO = f"((f.name = df.name AND substr(f.name, 1, 4) <> 'sub_') OR {_EITHER_AUTO})"
_NO_STUB = "f.name NOT ILIKE 'nullsub%' AND df.name NOT ILIKE 'nullsub%'"
_LARGE = "((f.nodes > 1 AND df.nodes > 1 AND f.instructions > 5 AND df.instructions > 5) OR (f.instructions > 10 AND df.instructions > 10))"


def _both(condition: str) -> str:
    """A condition on {} for both sides."""
    return f"{condition.format('f.')} AND {condition.format('df.')}"


def _h(number: int, name: str, category: str, consumer: str | float, keys: str, where: str = "true", flags: str = "", shape: str = "plain") -> Heuristic:
    flags_ = set(flags.split())
    return Heuristic(
        number, name, category, consumer if isinstance(consumer, str) else "least", tuple(keys.split()), where, consumer if isinstance(consumer, float) else 0.44 if consumer == "trusted" else 0.5,
        "source" if "source" in flags_ else "agreement" if "agreement" in flags_ else "", "distinct" in flags_, "cpu" in flags_, "slow" in flags_, "unreliable" in flags_, shape,
    )


#: The heuristics' numbers, names, categories, keys, conditions and thresholds.
HEURISTICS: tuple[Heuristic, ...] = (
    _h(0, "Same RVA and hash", "best", "all", "bytes_hash instructions", f"(f.rva = df.rva OR f.segment_rva = df.segment_rva) AND {_SAME_OR_AUTO} AND {_both('{}nodes >= 3')}", "cpu"),
    _h(1, "Same order and hash", "best", "all", "id bytes_hash instructions", f"{_SAME_OR_AUTO} AND {_LARGE}", "cpu"),
    _h(2, "Function Hash", "best", "all", "function_hash", _LARGE, "distinct cpu"),
    _h(3, "Bytes hash", "best", "all", "bytes_hash", _both("{}instructions > 5"), "distinct cpu"),
    _h(4, "Same address and mnemonics", "best", "ratio", "address mnemonics instructions", f"df.instructions > 5 AND {_SAME_OR_AUTO}", "distinct source"),
    _h(5, "Same cleaned assembly", "best", "ratio", "clean_assembly", f"{_both('{}nodes >= 3')} AND {_NO_STUB}", "source cpu"),
    _h(6, "Same cleaned microcode", "best", "ratio", "clean_microcode", f"{_both('{}instructions > 3')} AND {_NO_STUB}", "source cpu"),
    _h(7, "Same cleaned pseudo-code", "best", "ratio", "clean_pseudo", f"{_both('{}pseudocode_lines > 5')} AND {_NO_STUB}", "source"),
    _h(8, "Same address, nodes, edges and mnemonics", "best", "ratio", "rva instructions nodes edges mnemonics", f"{_both('{}instructions > 3')} AND f.nodes > 1", "source"),
    _h(9, "Same RVA", "best", 0.7, "rva", f"{_SAME_OR_AUTO} AND {_both('{}nodes >= 3')}", "distinct source cpu"),
    _h(10, "Equal assembly or pseudo-code", "best", "all", "", _NO_STUB, "distinct", "either"),
    _h(11, "Microcode mnemonics small primes product", "best", "ratio", "microcode_spp", f"{_both("{}microcode_spp <> '1'")} AND {_both('{}instructions > 5')} AND {_both('{}nodes > 2')} AND {_NO_STUB}", "source"),
    _h(12, "Same named compilation unit function match", "partial", "trusted", "primes_value nodes", "f.nodes >= 5", "", "units"),
    _h(13, "Same anonymous compilation unit function match", "partial", 0.449, "pseudocode_primes nodes", "f.nodes >= 5", "source", "units"),
    _h(14, "Same compilation unit", "partial", "ratio", "", f"{_both('{}nodes > 4')} AND {_EITHER_AUTO}", "slow", "unit_links"),
    _h(15, "Same KOKA hash and constants", "partial", "ratio", "kgh_hash", "f.nodes >= 3", "", "constants"),
    _h(16, "Same KOKA hash and MD-Index", "partial", "ratio", "kgh_hash md_index nodes outdegree indegree", f"f.nodes >= 4 AND {_EITHER_AUTO}"),
    _h(17, "Same constants", "partial", 0.5, "constants constants_count", "f.constants_count > 1", "source"),
    _h(18, "Same rare KOKA hash", "partial", 0.45, "kgh_hash", f"f.nodes > 5 AND {_EITHER_AUTO}", "", "rare"),
    _h(19, "Same rare MD Index", "partial", "ratio", "md_index", "f.nodes > 10", "source", "rare"),
    _h(20, "Same address and rare constant", "partial", 0.5, "address", "true", "distinct source", "constants"),
    _h(21, "Same rare constant", "partial", 0.2, "", f"{_both('{}nodes >= 3')} AND f.constants_count > 0", "slow", "constants"),
    _h(22, "Same MD Index and constants", "partial", "ratio", "md_index constants", f"{_both("{}md_index > '0'")} AND {_both('{}nodes >= 3')} AND f.constants_count > 0", "distinct source"),
    _h(23, "Import names hash", "partial", "ratio", "names md_index instructions", f"f.names <> '[]' AND {_both('{}nodes > 5')}", "distinct source"),
    _h(24, "Mnemonics and names", "partial", "ratio", "mnemonics instructions names", f"f.names <> '[]' AND {_both('{}instructions > 5')}", "source"),
    _h(25, "Pseudo-code fuzzy hash", "partial", "ratio", "pseudocode_hash1 pseudocode_hash2 pseudocode_hash3", _both("{}instructions > 5"), "distinct source"),
    _h(26, "Similar pseudo-code and names", "partial", 0.579, "pseudocode_lines names", "df.names <> '[]' AND df.pseudocode_lines > 5 AND f.pseudocode IS NOT NULL AND df.pseudocode IS NOT NULL", "distinct source"),
    _h(27, "Mnemonics small-primes-product", "partial", 0.6, "mnemonics_spp instructions", f"{_both('{}nodes > 1')} AND df.instructions > 5"),
    _h(28, "Same nodes, edges, loops and strongly connected components", "partial", 0.549, "nodes edges strongly_connected loops", f"{_both('{}nodes > 5')} AND f.loops > 0 AND {_EITHER_AUTO}"),
    _h(29, "Same low complexity, prototype and names", "partial", 0.5, "names cyclomatic_complexity prototype2", "f.cyclomatic_complexity < 20 AND df.names <> '[]'", "distinct"),
    _h(30, "Same low complexity and names", "partial", 0.5, "names cyclomatic_complexity", f"f.cyclomatic_complexity < 15 AND df.names <> '[]' AND {_EITHER_AUTO}"),
    _h(31, "Switch structures", "partial", 0.5, "switches", f"f.switches <> '[]' AND {_both('{}nodes > 5')}", "source"),
    _h(32, "Pseudo-code fuzzy (normal)", "partial", 0.5, "pseudocode_hash1", _both("{}pseudocode_lines > 5"), "distinct source"),
    _h(33, "Pseudo-code fuzzy (mixed)", "partial", "ratio", "pseudocode_hash3", _both("{}pseudocode_lines > 5"), "distinct source"),
    _h(34, "Pseudo-code fuzzy (reverse)", "partial", "ratio", "pseudocode_hash2", _both("{}pseudocode_lines > 5"), "distinct source"),
    _h(35, "Pseudo-code fuzzy AST hash", "partial", 0.35, "pseudocode_primes", "f.pseudocode_lines >= 3 AND length(f.pseudocode_primes) >= 35", "distinct source"),
    _h(36, "Partial pseudo-code fuzzy hash (normal)", "partial", 0.5, "pseudocode_hash1[16]", _both("{}nodes > 5"), "distinct source slow unreliable"),
    _h(37, "Partial pseudo-code fuzzy hash (reverse)", "partial", 0.5, "pseudocode_hash2[16]", _both("{}nodes > 5"), "distinct source slow unreliable"),
    _h(38, "Partial pseudo-code fuzzy hash (mixed)", "partial", 0.5, "pseudocode_hash3[16]", _both("{}nodes > 5"), "distinct source slow unreliable"),
    _h(39, "Same rare assembly instruction", "partial", 0.5, "", "f.name <> df.name", "cpu", "assembly"),
    _h(40, "Same rare basic block mnemonics list", "partial", 0.5, "", _both("{}nodes > 3"), "", "blocks"),
    _h(41, "Loop count", "partial", 0.49, "loops", f"df.loops > 1 AND {_both('{}nodes >= 3')}", "source slow"),
    _h(42, "Same graph", "unreliable", 0.5, "nodes edges indegree outdegree cyclomatic_complexity strongly_connected loops tarjan_topological_sort strongly_connected_spp", _both("{}nodes > 5"), "agreement"),
    _h(43, "Strongly connected components", "unreliable", 0.8, "strongly_connected", f"f.strongly_connected > 1 AND {_both('{}nodes > 5')} AND {_both("{}strongly_connected_spp > '1'")}", "source slow"),
    _h(44, "Nodes, edges, complexity and mnemonics", "unreliable", "ratio", "nodes edges mnemonics cyclomatic_complexity", "f.nodes > 1 AND f.edges > 0", "distinct source slow"),
    _h(45, "Nodes, edges, complexity and prototype", "unreliable", "ratio", "nodes edges prototype2 cyclomatic_complexity", "f.prototype2 <> 'int()'", "distinct source slow"),
    _h(46, "Nodes, edges, complexity, in-degree and out-degree", "unreliable", "ratio", "nodes edges cyclomatic_complexity indegree outdegree", "f.nodes >= 3 AND f.edges > 2", "distinct source slow"),
    _h(47, "Nodes, edges and complexity", "unreliable", "ratio", "nodes edges cyclomatic_complexity", "f.nodes > 1 AND f.edges > 0", "distinct source slow"),
    _h(48, "Same high complexity", "unreliable", "ratio", "cyclomatic_complexity", "f.cyclomatic_complexity >= 50", "source slow"),
    _h(49, "Topological sort hash", "unreliable", "ratio", "strongly_connected tarjan_topological_sort", "f.strongly_connected >= 3 AND f.nodes > 10", "source"),
)


def running(category: str, same_processor: bool = True, slow: bool = True, unreliable: bool = False) -> list[Heuristic]:
    """A category's heuristics in the order in which they run: the last declared first."""
    found = [h for h in HEURISTICS if h.category == category and (same_processor or not h.same_cpu) and (slow or not h.slow) and (unreliable or not h.unreliable)]
    return found[::-1]
