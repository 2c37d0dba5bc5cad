"""What the corpus operators share: connected components, and the library's durable cuts of lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import arrow_column, arrow_map, materialize

__all__ = ["arrow_column", "arrow_map", "components", "every", "materialize", "mixed", "spare", "spread_join"]

#: Parts that spread_join deals a key into; adaptive execution splits large ones further.
SPREAD = 8


def mixed(column: Column, salt: int) -> Column:
    """A hash of a long column, by which to order it anew for each salt."""
    return F.xxhash64(column, F.lit(salt))


def spare(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name in taken:
        name += "_"
    return name


def every(frame: DataFrame) -> list[Column]:
    """All columns of a frame, names with dots or quotes among them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in frame.columns]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", parts: int = SPREAD) -> DataFrame:
    """left.join(right, keys, how), inner or left semi, where a key may hold a third of left: it is dealt by the columns by, and right repeated for each part.

    right has one row a key.
    """
    salt = spare("salt", left, right)
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
    repeated = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(repeated, [*keys, salt], how).drop(salt)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b): long; root is one node of its component.

    Each round, every node hooks to the neighbour (or itself) that comes first in an order drawn afresh for the round,
    and the links are contracted along the hooks. The random order shrinks any graph, long chains and stars alike, by a
    constant factor a round. A round is one partially aggregated minimum and two joins, so a hub's links are never
    gathered in a task. Nothing but emptiness tests reaches the driver.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    left = materialize(both(edges).distinct())
    hooks: list[DataFrame] = []
    while not left.isEmpty():
        order = len(hooks)
        rank = lambda c: F.struct(mixed(F.col(c), order).alias("r"), F.col(c).alias("v"))  # noqa: E731, B023
        hook = materialize(left.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", rank("a")).getField("v").alias("to")))
        hooks.append(hook)
        left = left.join(hook.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = materialize(left.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))

    # each step is written: the planner's work would double with every step of a longer plan
    found = hooks[0].select("node", F.col("to").alias("root"))
    for hook in hooks[1:]:
        step = hook.select(F.col("node").alias("root"), "to")
        found = materialize(found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return found
