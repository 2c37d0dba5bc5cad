"""Control-flow graphs: features of each function's graph, in Arrow batches of whole graphs, and prime products."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import arrow_map, ship


def leaders(instructions: list[tuple[int, int | None, bool]]) -> list[int]:
    """Addresses where basic blocks begin: of instructions (address, jump target, ends a block), the first, every target inside, and what follows an end."""
    there = [a for a, _, _ in instructions]
    inside, out = set(there), set(there[:1])
    for k, (_, target, ends) in enumerate(instructions):
        if target in inside:
            out.add(target)
        if ends and k + 1 < len(there):
            out.add(there[k + 1])
    return sorted(out)


#: Roles of instructions after which the next one is not reached, or only by a jump.
STOPS = frozenset(("branch", "conditional", "indirect", "return", "noreturn", "invalid"))


def partition(instructions: list[tuple[int, int, str, int | None]]) -> list[dict]:
    """The basic blocks that a function's first instruction reaches, by start: instructions are (offset, size, role, target).

    A block has start, size, count (of instructions), ending (its last role, or fallthrough where another block begins,
    or range where the instructions do not go on), and successors and predecessors by number: the target of a jump within
    the function, then what follows a conditional jump or a fall through, each once.
    """
    listing = {at: (size, role, target) for at, size, role, target in instructions}
    starts = {min(listing)} if listing else set()
    waiting = [*starts]

    def ahead(at: int) -> Iterator[tuple[int, int, str, int | None]]:
        """What runs from a start on: (offset, offset after it, role, target), up to a stop or another start."""
        first = at
        while at in listing and (at == first or at not in starts):
            size, role, target = listing[at]
            yield at, at + size, role, target
            if role in STOPS:
                return
            at += size

    while waiting:
        for _, after, role, target in ahead(waiting.pop()):
            reached = [target] * (role in ("branch", "conditional")) + [after] * (role == "conditional")
            fresh = [x for x in dict.fromkeys(reached) if x in listing and x not in starts]
            starts.update(fresh)
            waiting += fresh
    blocks, number = [], {at: k for k, at in enumerate(sorted(starts))}
    for start in number:
        run = [*ahead(start)]
        _, end, role, target = run[-1]
        ending = role if role in STOPS else "fallthrough" if end in number else "range"
        nexts = [target] * (role in ("branch", "conditional")) + [end] * (ending in ("conditional", "fallthrough", "range"))
        blocks.append({"start": start, "size": end - start, "count": len(run), "ending": ending, "successors": [number[x] for x in dict.fromkeys(nexts) if x in number], "predecessors": []})
    for k, block in enumerate(blocks):
        for to in block["successors"]:
            blocks[to]["predecessors"].append(k)
    return blocks


_KINDS = {"start": pa.int64(), "size": pa.int64(), "count": pa.int64(), "ending": pa.string(), "successors": pa.list_(pa.int32()), "predecessors": pa.list_(pa.int32())}


def _function_blocks(listing: pa.Table) -> pa.Table:
    """The rows of one function, from its instructions in any order."""
    order = pc.sort_indices(listing, sort_keys=[(c, "ascending") for c in ("offset", "size", "role", "target")], null_placement="at_start")
    blocks = partition([*zip(*(listing[c].take(order).to_pylist() for c in ("offset", "size", "role", "target")))])
    columns = {name: pa.array([b[name] for b in blocks], kind) for name, kind in _KINDS.items()}
    func = pa.repeat(listing["func_id"][0].cast(pa.int64()), len(blocks))
    return pa.table({"func_id": func, "block": pa.array(range(len(blocks)), pa.int32())} | columns)


def basic_blocks(instructions: DataFrame) -> DataFrame:
    """func_id, block (its number) and what partition() says of it, from instructions (func_id, offset, size, role, target).

    A function's instructions meet in one group; the groups of a task are gone through one after the other.
    """
    ship(instructions.sparkSession)
    own = instructions.select("func_id", "offset", "size", "role", "target").groupBy("func_id")
    return own.applyInArrow(_function_blocks, "func_id long, block int, start long, size long, count long, ending string, successors array<int>, predecessors array<int>")


def strong_components(blocks: list[int], edges: dict[int, list[int]]) -> list[list[int]]:
    """Strongly connected components, without recursion."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    active: set[int] = set()
    path: list[int] = []
    out: list[list[int]] = []
    for root in blocks:
        if root in index:
            continue
        work = [(root, iter(edges.get(root, ())))]
        index[root] = low[root] = len(index)
        path.append(root)
        active.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    path.append(to)
                    active.add(to)
                    work.append((to, iter(edges.get(to, ()))))
                    break
                if to in active:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    found = []
                    while True:
                        found.append(path.pop())
                        active.discard(found[-1])
                        if found[-1] == node:
                            break
                    out.append(sorted(found))
    return out


def weak_components(blocks: list[int], pairs: list[tuple[int, int]]) -> int:
    parent = {b: b for b in blocks}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[top(a)] = top(b)
    return len({top(b) for b in blocks})


@cache
def primes(below: int) -> tuple[int, ...]:
    """All primes below a bound."""
    sieve = bytearray([1]) * below
    sieve[:2] = b"\0\0"[:below]
    for k in range(2, int(below**0.5) + 1):
        if sieve[k]:
            sieve[k * k :: k] = bytes(len(range(k * k, below, k)))
    return tuple(k for k in range(below) if sieve[k])


def prime_product(exponents: dict[int, int]) -> int:
    """The product of the n-th primes to their exponents: a hash that does not depend on order."""
    table, out = primes(2048**2 if any(k >= 564 for k in exponents) else 4096), 1
    for place, exponent in exponents.items():
        out *= table[place] ** exponent
    return out


def features(blocks: list[int], pairs: list[tuple[int, int]]) -> dict:
    """nodes, edges, strongly connected components, loops, weak components, complexity, entries, exits and the graph's prime product.

    Edges count once. A loop is a component of several blocks or a block with an edge to itself. The product takes the
    2nd prime a node, the 3rd an edge, the 4th a component, the 5th a loop, the 6th an entry, the 7th an exit, and from
    the 8th one for each out-degree.
    """
    pairs = sorted({(a, b) for a, b in pairs if a in set(blocks) and b in set(blocks)})
    edges: dict[int, list[int]] = {}
    for a, b in pairs:
        edges.setdefault(a, []).append(b)
    components = strong_components(blocks, edges)
    loops = sum(len(c) > 1 or c[0] in edges.get(c[0], ()) for c in components)
    weak = weak_components(blocks, pairs)
    entries, exits = len(set(blocks) - {b for _, b in pairs}), sum(b not in edges for b in blocks)
    exponents = {1: len(blocks), 2: len(pairs), 3: len(components), 4: loops, 5: entries, 6: exits}
    for b in blocks:
        degree = 7 + len(edges.get(b, ()))
        exponents[degree] = exponents.get(degree, 0) + 1
    return {"nodes": len(blocks), "edges": len(pairs), "strong": len(components), "loops": loops, "weak": weak, "complexity": max(1, len(pairs) - len(blocks) + 2 * weak), "entries": entries, "exits": exits, "product": str(prime_product(exponents))}


_SCHEMA = "nodes long, edges long, strong long, loops long, weak long, complexity long, entries long, exits long, product string"


def graph_features(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """func_id and features() of each function's graph, from blocks (func_id, block) and edges (func_id, src, dst).

    A function's blocks and edges meet in one row: a graph is bounded by its function, not by the catalog.
    """
    own = blocks.groupBy("func_id").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    pairs = edges.groupBy("func_id").agg(F.collect_set(F.struct("src", "dst")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        for batch in batches:
            found = [features(b, [(p["src"], p["dst"]) for p in e or ()]) for b, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([x[n] for x in found], pa.string() if n == "product" else pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["func_id", *names])

    return arrow_map(own.join(pairs, "func_id", "left").select("func_id", "blocks", "pairs"), run, f"func_id long, {_SCHEMA}")


def degrees(edges: DataFrame) -> DataFrame:
    """func_id, block, indegree, outdegree, by distinct edges."""
    once = edges.select("func_id", "src", "dst").distinct()
    ends = once.select("func_id", F.col("src").alias("block"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(once.select("func_id", F.col("dst").alias("block"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("func_id", "block").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
