"""The passes of a diff, each proposing pairs (id1, id2) with a description, or answering a question about the catalogs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import arrow_map, materialize
from ..functions.names import common_share, is_auto, numeric_prefix_is_zero
from ..functions.textdiff import LABEL, RISK_NEW, RISK_OLD, identifiers, jump_marks, replaced_names, risk_marks, risky_marks, swapped_marks
from ..sources.catalogs import Catalog, Pair
from .results import apart, numbered
from .state import SENT, sent

#: Thresholds of the passes.
STRIPPED_PERCENT, PATCH_PERCENT = 99.0, 90.0
PARTIAL, CALLEE, SEED, RENAMED = 0.5, 0.3, 0.8, 0.6
BONUS, GAP_MOST, CALLEE_PERCENT, CALLEE_NODES = 0.01, 100, 25, 3
#: Functions that are numbered together, to place all of them.
BLOCK = 1 << 16
EQUAL = ("id", "address", "mangled_function", "nodes", "edges", "size", "bytes_hash")


# Questions about the catalogs


def totals(pair: Pair) -> DataFrame:
    return pair.main.functions.select(F.lit("main").alias("side")).unionByName(pair.diff.functions.select(F.lit("diff").alias("side"))).groupBy("side").agg(F.count("*").alias("total"))


def equal_catalogs(pair: Pair) -> DataFrame:
    """same_md5: programs with equal md5; different: functions (id, address, size, nodes, edges) of main that diff lacks."""
    md5 = pair.main.table("program").select("md5sum").join(pair.diff.table("program").select("md5sum"), "md5sum").agg(F.count("*").alias("same_md5"))
    keys = ("id", "address", "size", "nodes", "edges")
    other = pair.main.functions.select(*keys).subtract(pair.diff.functions.select(*keys)).agg(F.count("*").alias("different"))
    return md5.join(other, F.lit(True))


def same_processor(pair: Pair) -> DataFrame:
    found = pair.main.table("program").select("processor").join(pair.diff.table("program").select("processor"), "processor")
    return found.agg((F.count("*") > 0).alias("same"))


def callgraph_difference(pair: Pair) -> DataFrame:
    """How much the prime factors of the call graphs differ: the sum of differences, the sum of main, and their percentage."""
    primes = lambda side, n: side.table("program").select(F.explode(F.from_json("callgraph_all_primes", "map<string, double>")).alias("prime", n))
    both = primes(pair.main, "a").join(primes(pair.diff, "b"), "prime", "full_outer").select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    sums = both.agg(F.sum(F.greatest("a", "b") - F.least("a", "b")).alias("different"), F.sum("a").alias("total"))
    return sums.withColumn("percent", F.try_divide(F.col("different") * 100, F.col("total")))


def _share(pair: Pair, key: str) -> DataFrame:
    pairs = pair.main.functions.select(key).join(pair.diff.functions.select(key), key).agg(F.count("*").alias("pairs"))
    total = pair.main.functions.agg(F.count("*").alias("total"))
    return pairs.join(total, F.lit(True)).select("pairs", "total", F.try_divide(F.col("pairs") * 100.0, F.col("total")).alias("percent"))


def stripped_mode(pair: Pair) -> DataFrame:
    """pairs of equal addresses, total and percent; mode: whether they are so many that symbols alone were stripped."""
    return _share(pair, "address").withColumn("mode", F.coalesce(F.col("percent") >= STRIPPED_PERCENT, F.lit(False)))


def patch_mode(pair: Pair) -> DataFrame:
    """The same for equal mangled names: whether the versions differ by a patch."""
    return _share(pair, "mangled_function").withColumn("mode", F.coalesce(F.col("percent") > PATCH_PERCENT, F.lit(False)))


# Passes

_SIDE = ("id", "address", "name", "mangled_function", "nodes")


def _rows(side: Catalog, number: int, *more: str) -> DataFrame:
    """A side's functions with the number after each column's name; address is ea."""
    return side.functions.select(*[F.col(c).alias(f"{'ea' if c == 'address' else c}{number}") for c in (*_SIDE, *more)])


def _found(rows: DataFrame, description: str | Column) -> DataFrame:
    text = F.lit(description) if isinstance(description, str) else description
    return rows.select("ea1", "name1", "ea2", "name2", text.alias("description"), "nodes1", "nodes2", "id1", "id2")


def equal_matches(pair: Pair) -> DataFrame:
    """Functions equal in EQUAL on both sides, by their mangled names."""
    both = pair.main.functions.select(*EQUAL).intersect(pair.diff.functions.select(*EQUAL))
    c = F.col
    return both.select(c("address").alias("ea1"), c("mangled_function").alias("name1"), c("address").alias("ea2"), c("mangled_function").alias("name2"), F.lit("100% equal").alias("description"), c("nodes").alias("nodes1"), c("nodes").alias("nodes2"), c("id").alias("id1"), c("id").alias("id2"))


def stripped_matches(pair: Pair) -> DataFrame:
    """Pairs of equal addresses."""
    rows = _rows(pair.main, 1).join(_rows(pair.diff, 2), F.col("ea1") == F.col("ea2"))
    return _found(rows, "Same binary with symbols stripped").distinct()


def same_name(pair: Pair) -> DataFrame:
    """Pairs with equal names or equal mangled names: a union of two equi joins, as a disjunction could only be a nested loop."""
    left, right = _rows(pair.main, 1), _rows(pair.diff, 2)
    rows = left.join(right, F.col("mangled_function1") == F.col("mangled_function2")).union(left.join(right, F.col("name1") == F.col("name2"))).distinct()
    keep = ~F.coalesce(F.col("name1").ilike("nullsub_%"), F.lit(False)) & ~F.coalesce(is_auto(F.col("mangled_function1")), F.lit(False))
    return _found(rows.where(keep), "Perfect match, same name")


def remaining_functions(pair: Pair, matches: DataFrame) -> DataFrame:
    """Of what a patch leaves over: every unmatched auto-named function of main with every unmatched one of diff of three nodes or more.

    Both sides are what more than 90 percent equal names leave; they are compared block by block, hashed over the shuffle.
    """
    rest = []
    for number, side in enumerate(pair.sides(), 1):
        names = matches.select(F.col(f"name{number}").alias("matched")).distinct()
        rest.append(_rows(side, number).where(F.col(f"nodes{number}") >= 3).join(names, F.col(f"name{number}").eqNullSafe(F.col("matched")), "left_anti"))
    blocks = 8
    left = rest[0].where(is_auto(F.col("name1"))).withColumn("block", F.pmod(F.xxhash64("id1"), F.lit(blocks)).cast("long")).withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rest[1].withColumn("with", F.pmod(F.xxhash64("id2"), F.lit(blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return _found(left.join(right, ["block", "with"]), "Renamed or anonymous function match in patch diffing session")


def small_differences(pair: Pair) -> DataFrame:
    """Pairs equal in nodes, edges, mnemonics and complexity that share half of their names or more."""
    keys = ("edges", "mnemonics", "cyclomatic_complexity")
    left, right = (_rows(s, n, *keys, "names") for n, s in enumerate(pair.sides(), 1))
    on = (F.col("nodes1") == F.col("nodes2")) & (F.col("edges1") == F.col("edges2")) & (F.col("cyclomatic_complexity1") == F.col("cyclomatic_complexity2")) & (F.col("mnemonics1") == F.col("mnemonics2"))
    rows = left.where(F.col("names1") != "[]").join(right, on).withColumn("share", common_share(F.col("names1"), F.col("names2")))
    return _found(rows.where(F.col("share") >= 0.5), "Nodes, edges, complexity and mnemonics with small differences")


def seeds(matches: DataFrame) -> DataFrame:
    """The likely matches from which related ones are sought."""
    return matches.where(F.col("category").isin("best", "partial") & (F.col("ratio") >= SEED)).select("id1", "id2").distinct()


def related_constants(pair: Pair, likely: DataFrame) -> DataFrame:
    """Pairs of functions that have a constant which a likely match has on both sides; constants that are numbers other than 0 do not count."""
    lists = [s.functions.where(F.col("constants_count") > 0).select(F.col("id").alias(f"id{n}"), F.array_distinct(F.from_json("constants", "array<string>")).alias(f"c{n}")) for n, s in enumerate(pair.sides(), 1)]
    shared = likely.join(lists[0], "id1").join(lists[1], "id2").select(F.explode(F.array_intersect("c1", "c2")).alias("constant")).distinct()
    shared = shared.where(numeric_prefix_is_zero(F.col("constant")))
    holders = [s.table("constants").select("constant", F.col("func_id").alias(f"id{n}")).distinct().join(_rows(s, n), f"id{n}") for n, s in enumerate(pair.sides(), 1)]
    rows = shared.join(holders[0], "constant").join(holders[1], "constant")
    return _found(rows, "Same constants related matches").distinct()


def _units(side: Catalog, number: int) -> DataFrame:
    """The first compilation unit of each function: its range of addresses."""
    links = side.table("compilation_unit_functions").groupBy("func_id").agg(F.min_by("cu_id", "id").alias("unit"))
    units = side.table("compilation_units").select(F.col("id").alias("unit"), F.col("start_ea").try_cast("double").alias(f"low{number}"), F.col("end_ea").try_cast("double").alias(f"high{number}"))
    return links.join(units, "unit").select(F.col("func_id").alias(f"id{number}"), f"low{number}", f"high{number}")


def _inside(side: Catalog, ranges: DataFrame, number: int) -> DataFrame:
    """Functions within ranges (low, high), by an equi join: a range is in the one or two cells of its own width, rounded up to a power of two, that it meets, and a function in its cell of each such width."""
    low, high, at = F.col(f"low{number}"), F.col(f"high{number}"), F.col("at")
    cell = lambda c, level: F.floor(c / F.pow(F.lit(2.0), level))
    own = ranges.select(low, high).distinct().where(low <= high)
    own = own.withColumn("level", F.ceil(F.log2(F.greatest(high - low, F.lit(1.0)))).cast("int"))
    cells = own.withColumn("cell", F.explode(F.array_distinct(F.array(cell(low, F.col("level")), cell(high, F.col("level"))))))
    levels = [r["level"] for r in own.select("level").distinct().collect()]  # as many as powers of two
    functions = _rows(side, number).withColumn("at", F.col(f"ea{number}").try_cast("double"))
    functions = functions.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("cell", cell(at, F.col("level")))
    return cells.join(functions, ["level", "cell"]).where(at.between(low, high)).drop("level", "cell", "at")


def related_units(pair: Pair, likely: DataFrame) -> DataFrame:
    """Pairs of functions in the ranges of two compilation units that a likely match links.

    Functions are put together by the ranges they are in: what is linked and made distinct are these classes, and a pair
    of classes gives each of its pairs of functions once.
    """
    ranges = materialize(likely.join(_units(pair.main, 1), "id1").join(_units(pair.diff, 2), "id2").select("low1", "high1", "low2", "high2").distinct())
    links, members = ranges, []
    for n, side in enumerate(pair.sides(), 1):
        keys = [f"{c}{n}" for c in ("ea", "name", "nodes", "id")]
        inside = _inside(side, ranges, n).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(f"low{n}", f"high{n}"))).alias("within"))
        inside = materialize(inside.withColumn(f"class{n}", F.sha2(F.to_json("within").cast("binary"), 256)))
        members.append((inside.count() <= SENT, inside.groupBy(f"class{n}").agg(F.collect_list(F.struct(*keys)).alias(f"members{n}"))))
        classes = inside.groupBy(f"class{n}").agg(F.first("within").alias("within")).select(f"class{n}", F.explode("within").alias("w")).select(f"class{n}", F.col(f"w.low{n}"), F.col(f"w.high{n}"))
        links = links.join(classes, [f"low{n}", f"high{n}"])
    rows = links.select("class1", "class2").distinct()
    for n, (few, own) in enumerate(members, 1):
        rows = rows.join(F.broadcast(own) if few else own, f"class{n}")
    rows = rows.select(F.explode("members1").alias("m1"), "members2").select("m1", F.explode("members2").alias("m2")).select("m1.*", "m2.*")
    return _found(rows, "Related compilation unit")


def gaps(matches: DataFrame) -> DataFrame:
    """Consecutive matches by (address of main, address of diff): a gap's number and its ends a1, b1, a2, b2.

    The order is cut into ranges of addresses; within each, lag gives the match before, and the first of a range gets the
    last of the range before, of which there is one row each.
    """
    number = lambda c: F.col(c).try_cast("decimal(20, 0)")
    rows = matches.where(F.col("category").isin("best", "partial")).select("ea1", "ea2", number("ea1").alias("k1"), number("ea2").alias("k2"))
    rows = materialize(rows)  # read three times
    cuts = rows.select(F.col("k1").cast("double").alias("k")).where("k IS NOT NULL").approxQuantile("k", [i / 64 for i in range(1, 64)], 0.01)
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    rows = rows.withColumn("part", F.size(F.filter(bounds, lambda b: b <= F.coalesce(F.col("k1").cast("double"), F.lit(float("-inf"))))))
    match = F.struct("ea1", "ea2")
    before = F.lag(match).over(Window.partitionBy("part").orderBy("k1", "k2", "ea1", "ea2"))
    rows = rows.withColumn("match", match).withColumn("before", before)
    last = rows.groupBy("part").agg(F.max_by("match", F.struct("k1", "k2", "ea1", "ea2")).alias("last"))
    last = last.select(F.col("part"), F.lag("last").over(Window.orderBy("part")).alias("carried"))  # at most 64 rows
    rows = rows.join(F.broadcast(last), "part").withColumn("before", F.coalesce("before", "carried")).where("before IS NOT NULL")
    return rows.select(F.col("before.ea1").alias("a1"), F.col("ea1").alias("b1"), F.col("before.ea2").alias("a2"), F.col("ea2").alias("b2")).distinct().withColumn("gap", F.xxhash64("a1", "b1", "a2", "b2"))


def _between(side: Catalog, spans: DataFrame, number: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Of gaps with functions whose address lies between the ends as a text, but no more than most: gap, first and last place of them; and all functions by place.

    Places follow the order of addresses, so a gap's functions are counted without being listed.
    """
    ea, a, b = f"ea{number}", f"a{number}", f"b{number}"
    spans = spans.select("gap", a, b).where(F.col(a) < F.col(b))
    rows = _rows(side, number, "pseudocode_lines").where(F.col(ea).isNotNull())
    ends = spans.select(F.explode(F.array(a, b)).alias(ea)).distinct()
    own = rows.withColumn("own", F.lit(1)).unionByName(ends.withColumn("own", F.lit(0)), allowMissingColumns=True)
    placed = materialize(numbered(own.withColumn("all", F.lit(0)), "all", F.asc(ea), F.asc("own"), F.asc(f"id{number}")))
    # an end comes before its functions: so many functions are below it, and so many at it
    before = F.sum("own").over(Window.partitionBy("block").orderBy("line_number"))
    placed = placed.withColumn("block", F.expr(f"line_number div {BLOCK}"))
    sums = placed.groupBy("block").agg(F.sum("own").alias("n"))
    sums = sums.select(F.col("block").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sum"))  # a row for BLOCK functions
    placed = materialize(placed.withColumn("place", before).join(F.broadcast(sums), F.col("block") == F.col("of")).withColumn("place", F.col("place") + F.col("sum")).drop("block", "of", "sum", "all", "line_number"))
    functions = placed.where("own = 1").drop("own")
    at = placed.groupBy(ea).agg(F.min(F.when(F.col("own") == 0, F.col("place"))).alias("below"), F.sum("own").alias("n")).where("below IS NOT NULL")
    first, last = at.select(F.col(ea).alias(a), (F.col("below") + F.col("n") + 1).alias(f"first{number}")), at.select(F.col(ea).alias(b), F.col("below").alias(f"last{number}"))
    few = spans.join(first, a).join(last, b).select("gap", f"first{number}", f"last{number}")
    return few.where((F.col(f"last{number}") >= F.col(f"first{number}")) & (F.col(f"last{number}") - F.col(f"first{number}") < most)), functions


def local_affinity(pair: Pair, matches: DataFrame, most: int = GAP_MOST) -> DataFrame:
    """Pairs of functions in the same gap between consecutive matches, where both sides have few.

    Gaps with the same functions on both sides are one; only places are joined and made distinct before the functions come.
    """
    spans = materialize(gaps(matches).where("a1 < b1 AND a2 < b2"))
    few, functions = zip(*(_between(side, spans, n, most) for n, side in enumerate(pair.sides(), 1)))
    rows = few[0].join(few[1], "gap").select("first1", "last1", "first2", "last2").distinct()
    rows = rows.withColumn("place1", F.explode(F.sequence("first1", "last1"))).select("place1", "first2", "last2").distinct()
    rows = rows.withColumn("place2", F.explode(F.sequence("first2", "last2"))).select("place1", "place2").distinct()
    for n, own in enumerate(functions, 1):
        rows = rows.join(own.withColumnRenamed("place", f"place{n}").withColumnRenamed("pseudocode_lines" + str(n), f"lines{n}"), f"place{n}")
    named = F.coalesce(is_auto(F.col("name1")) | is_auto(F.col("name2")), F.lit(False)) & ~F.coalesce(F.col("name1").startswith("nullsub_") | F.col("name2").startswith("nullsub_"), F.lit(False))
    short = F.coalesce((F.col("lines1") + F.col("lines2") != 0) & ((F.col("lines1") == 3) | (F.col("lines2") == 3)), F.lit(False))
    found = _found(rows.where(named & ~short), "Local affinity")
    return found if pair.main.ids_differ and pair.diff.ids_differ else found.distinct()


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [p for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) if a != b for p in replaced_names(a, b)]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.string()) for k in (0, 1)], names=["name1", "name2"])


#: Lines up to which a text is short: pairs of short texts that differ in one line need no matcher.
SHORT = 8
#: Functions' numbers are below this, so two of them make a key; HARD marks the keys of texts that are left to the matcher.
_PLACES, _HARD = 1 << 31, 1 << 62


def _short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines, and the identifiers of each, of texts of SHORT different lines at most; null for others."""
    for batch in batches:
        cut = [t.splitlines() for t in batch.column(2).to_pylist()]
        cut = [x if len(x) <= SHORT and len(set(x)) == len(x) else None for x in cut]
        names = [x and [identifiers(line) for line in x] for x in cut]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cut, pa.list_(pa.string())), pa.array(names, pa.list_(pa.list_(pa.string())))], names=["id", "digest", "lines", "names"])


def _callees(side: Catalog, placed: bool = True) -> DataFrame:
    """The functions whose name no other of the side has and that may be found as callees, with place, their number."""
    one = side.functions.groupBy("name").agg(F.count("*").alias("n"), F.first(F.struct("id", "address", "nodes")).alias("f")).where("n = 1")
    one = one.where(~F.col("name").startswith("nullsub") & (F.coalesce("f.nodes", F.lit(CALLEE_NODES)) >= CALLEE_NODES)).select("name", "f.*", F.lit(0).alias("all"))
    return numbered(one, "all", F.asc("name")).drop("all").withColumnRenamed("line_number", "place") if placed else one


def _callers(side: Catalog, callees: DataFrame, column: str, number: int) -> DataFrame:
    """id and text number of the functions with a text, its digest and, of a short one, a hash of each line and the callees that it names, null for other names."""
    texts = side.functions.where(F.col(column).isNotNull()).select("id", F.xxhash64(column).alias("digest"), column)
    texts = materialize(arrow_map(texts, _short_texts, "id long, digest long, lines array<string>, names array<array<string>>"))
    texts = materialize(numbered(texts.withColumn("all", F.lit(0)), "all", F.asc("id"), F.asc("digest")).drop("all").withColumnRenamed("line_number", "text"))
    named = texts.select("text", F.explode(F.array_distinct(F.flatten("names"))).alias("name")).join(callees.select("name", F.col("place").cast("int")), "name")
    named = named.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("name", "place"))).alias("known"))
    of = F.transform("names", lambda line: F.transform(line, lambda x: F.try_element_at(F.col("known"), x)))
    rows = texts.join(named, "text", "left").select(F.col("id").alias(f"id{number}"), F.col("text").alias(f"text{number}"), F.col("digest").alias(f"digest{number}"), F.transform("lines", lambda x: F.xxhash64(x)).alias(f"lines{number}"), of.alias(f"names{number}"))
    return sent(rows)


def _by_matcher(pair: Pair, texts: DataFrame, column: str) -> DataFrame:
    """name1, name2: what replaces each other in the texts of both sides' functions with id and digest."""
    for n, side in enumerate(pair.sides(), 1):
        own = side.functions.select(F.col("id").alias(f"id{n}"), F.xxhash64(column).alias(f"digest{n}"), F.col(column).alias(f"is{n}"))
        texts = texts.join(own.distinct(), [f"id{n}", f"digest{n}"])
    return arrow_map(texts.select("id1", "id2", "is1", "is2"), _replaced, "name1 string, name2 string").distinct()


def callee_matches(pair: Pair, matches: DataFrame, column: str, few: bool = False) -> DataFrame:
    """Pairs of functions whose names replace each other where the texts of a match differ; names must be unique on their side.

    Names that a match pairs already are not proposed again. Where two texts of few different lines differ in one line,
    the matcher could only find the other lines equal: such pairs meet as numbers of what their lines name, and only the
    others' texts are compared. Matches are read once; proposed and paired names go over the shuffle as one number each.
    few: matches are so few that the tables this takes cost more than comparing all their texts.
    """
    if few:
        ids = matches.select("id1", "id2").distinct()
        for n, side in enumerate(pair.sides(), 1):
            ids = ids.join(side.functions.where(F.col(column).isNotNull()).select(F.col("id").alias(f"id{n}"), F.xxhash64(column).alias(f"digest{n}")).distinct(), f"id{n}")
        names = _by_matcher(pair, ids, column).join(matches.select("name1", "name2").distinct(), ["name1", "name2"], "left_anti")
        for n, side in enumerate(pair.sides(), 1):
            names = names.join(_callees(side, False).select(*[F.col(k).alias(f"{v}{n}") for k, v in zip(("name", "id", "address", "nodes"), ("name", "id", "ea", "nodes"))]), f"name{n}")
        return _sized(names, column)
    one = [materialize(_callees(s)) for s in pair.sides()]
    rows, callers = matches.select("id1", "id2", "name1", "name2"), []
    for n, (side, own) in enumerate(zip(pair.sides(), one), 1):
        callers.append(_callers(side, own, column, n))
        rows = rows.join(callers[-1], f"id{n}", "left")
        rows = rows.join(sent(own.select(F.col("name").alias(f"name{n}"), F.col("place").alias(f"place{n}"))), f"name{n}", "left")
    c, place = F.col, F.lit(_PLACES)
    differ = [~F.get(c("lines1"), F.lit(k)).eqNullSafe(F.get(c("lines2"), F.lit(k))) for k in range(SHORT)]
    count = reduce(lambda a, b: a + b, [d.cast("int") for d in differ])
    at = F.coalesce(*[F.when(d, k) for k, d in enumerate(differ)])
    rows = rows.withColumn("differ", count).withColumn("at", at)
    texts = c("text1").isNotNull() & c("text2").isNotNull()
    short = c("lines1").isNotNull() & c("lines2").isNotNull()
    simple = short & (F.size("lines1") == F.size("lines2")) & (c("differ") <= 1)
    # a line replaces the other if one follows, and what they name is paired by place; 1 is added as 0 has no sign
    replaced = F.zip_with(F.get(c("names1"), c("at")), F.get(c("names2"), c("at")), lambda a, b: a * place + b + 1)
    none = F.array().cast("array<bigint>")
    proposed = F.when(simple, F.when((c("differ") == 1) & (c("at") < F.size("lines1") - 1), replaced).otherwise(none))
    proposed = F.when(texts & ~(c("digest1") == c("digest2")), F.coalesce(proposed, F.array(F.lit(_HARD) + c("text1") * place + c("text2"))))
    matched = F.array(-(c("place1") * place + c("place2") + 1))
    keys = rows.select(F.explode(F.concat(matched, F.coalesce(proposed, none))).alias("key")).where("key IS NOT NULL")
    keys = keys.withColumn("of", F.abs("key"))
    keys = materialize(apart(keys, "of").groupBy("of").agg(F.min("key").alias("key")).where("key > 0").select("key"))
    names = keys.where(c("key") < _HARD).select(F.expr(f"(key - 1) div {_PLACES}").alias("place1"), ((c("key") - 1) % place).alias("place2"))
    hard = keys.where(c("key") >= _HARD).select(F.expr(f"(key - {_HARD}) div {_PLACES}").alias("text1"), (c("key") % place).alias("text2"))
    if not hard.isEmpty():
        for n, own in enumerate(callers, 1):
            hard = hard.join(own.select(f"text{n}", f"id{n}", f"digest{n}"), f"text{n}")
        found = _by_matcher(pair, hard, column).join(matches.select("name1", "name2").distinct(), ["name1", "name2"], "left_anti")
        for n, own in enumerate(one, 1):
            found = found.join(own.select(F.col("name").alias(f"name{n}"), F.col("place").alias(f"place{n}")), f"name{n}")
        names = names.unionByName(found.select("place1", "place2")).distinct()
    for number, own in enumerate(one, 1):
        names = names.join(sent(own.select(*[F.col(k).alias(f"{v}{number}") for k, v in zip(("place", "name", "id", "address", "nodes"), ("place", "name", "id", "ea", "nodes"))])), f"place{number}")
    return _sized(names, column)


def _sized(names: DataFrame, column: str) -> DataFrame:
    """Those of the pairs whose numbers of nodes are not too far apart."""
    least, most = F.least("nodes1", "nodes2"), F.greatest("nodes1", "nodes2")
    kind = "assembly" if column == "assembly" else "pseudo-code"
    return _found(names.where((least * 100 >= most * CALLEE_PERCENT) & (least >= CALLEE_NODES)), f"Callee found diffing matches {kind}")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of each text's lines in place of the texts, which are the last two columns."""
    for batch in batches:
        marks = [[t if t is None else [of(line) for line in t.split("\n")] for t in batch.column(k).to_pylist()] for k, of in ((5, jump_marks), (6, risk_marks))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(m, pa.list_(pa.int32())) for m in marks]], names=["id", "digest_a", "digest_p", "lines_a", "lines_p", "marks_a", "marks_p"])


def _marked_lines(side: Catalog) -> DataFrame:
    """Each function with a row number, and of its assembly (a) and pseudo-code (p) a digest, and its lines' hashes and marks."""
    hashes = lambda c: F.transform(F.split(c, "\n", -1), lambda x: F.xxhash64(x))
    texts = side.functions.select("id", F.xxhash64("assembly").alias("digest_a"), F.xxhash64("pseudocode").alias("digest_p"), hashes("assembly").alias("lines_a"), hashes("pseudocode").alias("lines_p"), "assembly", "pseudocode")
    many = "array<long>", "array<long>", "array<int>", "array<int>"
    rows = arrow_map(texts, _marked, "id long, digest_a long, digest_p long, " + ", ".join(f"{c} {t}" for c, t in zip(("lines_a", "lines_p", "marks_a", "marks_p"), many)))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def _summed(own: DataFrame, other: DataFrame, number: int) -> DataFrame:
    """What pairs need to know of a side's functions: digests, lines that the other side has too, which jumps there are and which one ends the text, and risky lines, sure ones being those that the other side lacks."""
    lines = lambda rows, *more: rows.select(*more, F.explode(F.array(F.struct(F.lit("a").alias("text"), F.col("lines_a").alias("of")), F.struct(F.lit("p").alias("text"), F.col("lines_p").alias("of")))).alias("t")).select(*more, "t.text", F.explode("t.of").alias("line")).distinct()
    both = lines(own, "row").join(lines(other), ["text", "line"], "left_semi")
    both = both.groupBy("row").agg(*[F.collect_list(F.when(F.col("text") == t, F.col("line"))).alias(f"both_{t}") for t in "ap"])
    bit, c = RISK_OLD if number == 1 else RISK_NEW, F.col
    mask = F.aggregate("marks_a", F.lit(0), lambda s, m: s.bitwiseOR(F.call_function("shiftleft", F.lit(1), m.bitwiseAND(15))))
    stay = F.filter("marks_a", lambda m: m.bitwiseAND(LABEL) == 0)
    risky = F.transform(F.filter(F.arrays_zip("lines_p", "marks_p"), lambda x: x["marks_p"].bitwiseAND(bit) != 0), lambda x: x["lines_p"])
    rows = own.join(both, "row", "left").withColumn("risky", risky)
    found = {"row": c("row"), "has_a": c("marks_a").isNotNull(), "has_p": c("marks_p").isNotNull(), "digest_a": c("digest_a"), "digest_p": c("digest_p"), "jumps": mask, "last": F.coalesce(F.get(stay, F.size(stay) - 1).bitwiseAND(15), F.lit(0)), "risk": F.size("risky") > 0, "sure": F.size(F.array_except("risky", F.coalesce("both_p", F.array().cast("array<bigint>")))) > 0}
    found |= {f"both_{t}": F.when(F.size(f"both_{t}") > 0, c(f"both_{t}")) for t in "ap"}
    return rows.select(c("id").alias(f"id{number}"), *[v.alias(f"{k}{number}") for k, v in found.items()])


def _interesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[2:]]
        flags = [None not in (a1, a2) and swapped_marks((a1, m1), (a2, m2)) or None not in (p1, p2) and risky_marks((p1, n1), (p2, n2)) for a1, p1, m1, n1, a2, p2, m2, n2 in zip(*columns)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(flags, pa.bool_())], names=["id1", "id2", "interesting"])


def interesting_changes(pair: Pair, matches: DataFrame) -> DataFrame:
    """id1, id2 and whether the change of a match short of equality is worth a look: a jump's sign, a risky call, a size check.

    Texts without a common line change as a whole, equal ones not at all, and others by what is marked in them: most
    pairs are decided by what is known of each function. Only where that leaves it open the lines' hashes are compared.
    """
    marked = [_marked_lines(s) for s in pair.sides()]
    rows = apart(matches.where("ratio < 1").select("id1", "id2"), "id1", "id2").distinct()
    for n, (own, other) in enumerate((marked, marked[::-1]), 1):
        rows = rows.join(sent(_summed(own, other, n)), f"id{n}")
    c, no = F.col, F.lit(False)
    meet = lambda t: F.coalesce(F.arrays_overlap(f"both_{t}1", f"both_{t}2"), no)
    bits = lambda m: m.bitwiseAND(0x5554) * 2 + F.shiftright(m.bitwiseAND(0xAAA8), 1)  # noqa: E731  # partners change places, 0 and 1 go
    ends = (c("last1") > 1) & (c("jumps2").bitwiseAND(F.call_function("shiftleft", F.lit(1), c("last1").bitwiseXOR(F.lit(1)))) != 0)
    may = bits(c("jumps1")).bitwiseAND(c("jumps2")) != 0
    swapped = F.when(~(c("has_a1") & c("has_a2")) | (c("digest_a1") == c("digest_a2")) | ~may, no).when(~meet("a"), ends)
    risky = F.when(~(c("has_p1") & c("has_p2")) | (c("digest_p1") == c("digest_p2")) | ~(c("risk1") | c("risk2")), no).when(c("sure1") | c("sure2") | ~meet("p"), True)
    rows = rows.withColumn("interesting", swapped | risky)
    is_open = c("interesting").isNull()
    rows = materialize(rows.select("id1", "id2", "interesting", F.when(is_open, c("row1")).alias("row1"), F.when(is_open, c("row2")).alias("row2")))
    left = rows.where(is_open).select("id1", "id2", "row1", "row2")
    for n, own in enumerate(marked, 1):
        left = left.join(own.select(F.col("row").alias(f"row{n}"), *[F.col(k).alias(f"{k}{n}") for k in ("lines_a", "lines_p", "marks_a", "marks_p")]), f"row{n}")
    left = arrow_map(left.drop("row1", "row2").select("id1", "id2", *[f"{k}{n}" for n in (1, 2) for k in ("lines_a", "lines_p", "marks_a", "marks_p")]), _interesting, "id1 long, id2 long, interesting boolean")
    return rows.where(~is_open).select("id1", "id2", "interesting").unionByName(left)
