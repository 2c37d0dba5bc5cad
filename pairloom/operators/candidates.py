"""Candidate pairs: each heuristic's declaration as joins.

Everything is equi joins on the heuristic's keys, with what else must hold in the join condition; long texts are replaced
by a digest where they are read, before any join, so they are never shuffled. Low-cardinality keys are left to adaptive
execution, which splits skewed partitions of both sides.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import AGREEMENT, LONG_TEXTS, Heuristic
from ..sources.catalogs import Catalog, Pair

#: What a candidate row has; taken orders the rows of a heuristic, with the ids after it.
COLUMNS = ("ea1", "name1", "ea2", "name2", "description", "nodes1", "nodes2", "md1", "md2", "id1", "id2", "taken")
#: The filter for small functions, added on request.
SMALL = "f.instructions > 5 AND df.instructions > 5"
_FEW_COMMON_NODES = "(least(f.nodes, df.nodes) * 100) div nullif(greatest(f.nodes, df.nodes), 0) < 50 AND f.nodes IS NOT NULL AND df.nodes IS NOT NULL"


#: Bytes from which a text is replaced by its digest, which has as many characters: no shorter text equals a digest.
DIGEST = 64


def brief(side: Catalog) -> DataFrame:
    """A side's numbered functions, with digests in place of long texts: equal where the texts are, null where they are."""
    rows = side.numbered()
    short = lambda c: F.when(F.octet_length(c) < DIGEST, F.col(c)).otherwise(F.sha2(F.col(c).cast("binary"), 256)).alias(c)
    return rows.select(*[short(c) if c in LONG_TEXTS else c for c in rows.columns])


def _key(side: str, key: str) -> Column:
    return F.substring(F.col(f"{side}.{key[:-4]}"), 1, 16) if key.endswith("[16]") else F.col(f"{side}.{key}")


def _equal(*keys: str) -> Column:
    return reduce(lambda a, b: a & b, [_key("f", k) == _key("df", k) for k in keys], F.lit(True))


def _taken(order: str) -> Column:
    if order == "source":
        return F.coalesce((F.col("f.source_file") == F.col("df.source_file")).cast("int"), F.lit(-1))
    if order == "agreement":
        return -reduce(lambda a, b: a + b, [F.when(F.col(f"f.{c}") == F.col(f"df.{c}"), 1).otherwise(0) for c in AGREEMENT])
    return F.lit(0)


def _project(joined: DataFrame, description: str, order: str) -> DataFrame:
    c = F.col
    return joined.select(
        c("f.address").alias("ea1"), c("f.name").alias("name1"), c("df.address").alias("ea2"), c("df.name").alias("name2"), F.lit(description).alias("description"),
        c("f.nodes").alias("nodes1"), c("df.nodes").alias("nodes2"), c("f.md").alias("md1"), c("df.md").alias("md2"), c("f.id").alias("id1"), c("df.id").alias("id2"), _taken(order).alias("taken"),
    )


def _rare(side: Catalog, key: str, most: int = 2) -> DataFrame:
    """Values of a key that some functions of a side have, but no more than most."""
    return side.functions.where(F.col(key) != "0").groupBy(key).count().where(F.col("count") <= most).select(key)


def _unique_lines(side: Catalog) -> DataFrame:
    """Disassembly lines that occur once in a side, null subs left out, with the function that has it."""
    named = side.functions.where(~F.col("name").ilike("nullsub%")).select(F.col("id").alias("func"))
    lines = side.table("instructions").where("disasm <> ''").select("func_id", "disasm")
    lines = lines.join(named, lines.func_id == named.func)
    return lines.groupBy("disasm").agg(F.count("*").alias("n"), F.min("func").alias("func")).where("n = 1").drop("n")


def block_mnemonics(side: Catalog) -> DataFrame:
    """func (the smallest of the functions that hold it), list (its mnemonics in order) and total of each basic block."""
    own = side.table("bb_instructions").select(F.col("id").alias("at"), "basic_block_id", "instruction_id")
    rows = own.join(side.table("instructions").select("id", "func_id", "mnemonic"), F.col("instruction_id") == F.col("id"))
    gathered = rows.groupBy("basic_block_id").agg(F.min("func_id").alias("func"), F.array_sort(F.collect_list(F.when(F.col("mnemonic").isNotNull(), F.struct("at", "mnemonic")))).alias("m"), F.count("*").alias("total"))
    return gathered.select("func", F.when(F.size("m") > 0, F.array_join(F.transform("m", lambda x: x["mnemonic"]), ",")).alias("list"), "total")


def first_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first candidates of a heuristic in its order, where only so many shall be looked at."""
    return rows.orderBy("taken", "id1", "id2").limit(most)


#: Parts that the functions of a key are dealt into, where a plain heuristic is spread.
PARTS = 4


def _spread(f: DataFrame, df: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by their keys and a part, into as many tasks as the session has for a shuffle.

    Functions with a common key are few bytes and many pairs, so tasks cannot be put together by what they read.
    """
    tasks = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = f.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int"))
    df = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return tuple(side.repartition(tasks, *keys, "part") for side in (f, df))


def candidates(pair: Pair, h: Heuristic, ignore_small: bool = False, spread: bool = False) -> DataFrame:
    """The rows of a heuristic, with the columns COLUMNS. A pair may come more than once unless the heuristic is distinct.

    Where the ids of both sides differ, a join of functions alone gives a pair once, and nothing is left to be made distinct.
    """
    once = h.shape in ("plain", "either", "rare") and (h.distinct or h.shape == "either") and pair.main.ids_differ and pair.diff.ids_differ
    f, df = map(brief, pair.sides())
    holds = _equal(*h.keys) & F.expr(h.where)
    if spread and h.shape == "plain" and set(h.keys) <= set(f.columns):
        f, df = _spread(f, df, h.keys)
        holds &= F.col("f.part") == F.col("df.part")
    f, df = f.alias("f"), df.alias("df")
    if ignore_small:
        holds &= F.expr(SMALL)
    if h.shape == "plain":
        found = f.join(df, holds)
    elif h.shape == "either":
        arms = (("pseudocode", "Equal pseudo-code", "f.pseudocode_lines >= 5"), ("assembly", "Equal assembly", "f.instructions >= 4 AND df.instructions >= 4"))
        found = reduce(DataFrame.union, [_project(f.join(df, _equal(k) & holds & F.expr(w)), d, h.order) for k, d, w in arms])
        return found if once else found.distinct()
    elif h.shape == "rare":
        (key,) = h.keys
        few = _rare(pair.main, key).union(_rare(pair.diff, key)).distinct()
        found = brief(pair.main).join(few, key, "left_semi").alias("f").join(df, holds)
    elif h.shape == "constants":
        m, d = (s.table("constants").select("func_id", "constant").alias(a) for s, a in zip(pair.sides(), ("mc", "dc")))
        left = m.join(f, F.col("mc.func_id") == F.col("f.id"))
        found = left.join(d.join(df, F.col("dc.func_id") == F.col("df.id")), (F.col("mc.constant") == F.col("dc.constant")) & holds)
    elif h.shape in ("units", "unit_links"):
        key = "name" if h.shape == "units" else "pseudocode_primes"

        def unit(side: Catalog, functions: DataFrame, a: str) -> DataFrame:
            units = side.table("compilation_units").select(F.col("id").alias(f"{a}_unit"), F.col(key).alias(f"{a}_key"))
            units = units.where(F.col(f"{a}_key") != "") if key == "name" else units
            links = side.table("compilation_unit_functions").select(F.col("cu_id").alias(f"{a}_cu"), F.col("func_id").alias(f"{a}_func"))
            return functions.join(links, F.col(f"{a}.id") == F.col(f"{a}_func")).join(units, F.col(f"{a}_cu") == F.col(f"{a}_unit"))

        found = unit(pair.main, f, "f").join(unit(pair.diff, df, "df"), (F.col("f_key") == F.col("df_key")) & holds)
    elif h.shape == "assembly":
        m, d = (_unique_lines(s).select("disasm", F.col("func").alias(a)) for s, a in zip(pair.sides(), ("func1", "func2")))
        links = m.join(d, "disasm").select("func1", "func2").distinct()
        found = links.join(f, F.col("func1") == F.col("f.id")).join(df, (F.col("func2") == F.col("df.id")) & holds & F.expr(_FEW_COMMON_NODES))
    else:
        m = block_mnemonics(pair.main).groupBy("list").agg(F.count("*").alias("n"), F.min("func").alias("func1")).where("n = 1").drop("n")
        d = block_mnemonics(pair.diff).where("total >= 6").select("list", F.col("func").alias("func2"))
        links = m.join(d, "list")
        found = links.join(f, F.col("func1") == F.col("f.id")).join(df, (F.col("func2") == F.col("df.id")) & holds & F.expr(_FEW_COMMON_NODES))
    rows = _project(found, h.name, h.order)
    return rows.distinct() if h.distinct and not once else rows


def united(pair: Pair, heuristics: list[Heuristic], spread: bool = False) -> DataFrame:
    """The rows of several heuristics, each row once: heuristics differ in their descriptions, so each is made distinct by itself."""
    return reduce(DataFrame.union, [candidates(pair, replace(h, distinct=True), spread=spread) for h in heuristics])
