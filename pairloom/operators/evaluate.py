"""Comparing results with each other and with the truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_portable
from .results import apart, by, numbered
from .state import sent


def _valued(sides: list[DataFrame], *columns: str) -> DataFrame:
    """The distinct values of columns in both results as of_COLUMN, with their number in their order, from 0; sent where they are few."""
    values = reduce(DataFrame.union, [s.select(*columns).distinct() for s in sides]).distinct()
    placed = numbered(values.withColumn("all", F.lit(0)), "all", *map(F.asc, columns))
    return sent(placed.select(*[F.col(c).alias(f"of_{c}") for c in columns], F.col("line_number").alias("number")))


def _packed(*numbers: str) -> list[Column]:
    """Numbers two to a long."""
    pairs = [numbers[i : i + 2] for i in range(0, len(numbers), 2)]
    return [(F.shiftleft(p[0], 32).bitwiseOR(F.col(p[1])) if len(p) == 2 else F.col(p[0])).alias(f"p{i}") for i, p in enumerate(pairs)]


def same_rows(a: DataFrame, b: DataFrame, columns: list[str], numbers: bool = False) -> DataFrame:
    """only_a, only_b: rows that one multiset has more often than the other; both 0 if the results agree.

    Both go over the shuffle once, where rows count for a and against it. numbers: values recur, so their numbers go there.
    """
    sides, keys = [s.select(*columns) for s in (a, b)], list(columns)
    if numbers:
        for c in columns:
            known = _valued(sides, c).withColumnRenamed("number", f"number_{c}")
            sides = [by(s, known, c) for s in sides]
        packed = _packed(*[f"number_{c}" for c in columns])
        sides, keys = [s.select(*packed) for s in sides], [f"p{i}" for i in range(len(packed))]
    more = "more"
    while more in keys:
        more += "_"
    rows = sides[0].withColumn(more, F.lit(1)).union(sides[1].withColumn(more, F.lit(-1)))
    counts = (apart(rows, *keys) if numbers else rows).groupBy(*keys).agg(F.sum(more).alias(more)).select(F.col(more).alias("n"))
    count = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0).cast("long"))), F.lit(0).cast("long"))
    return counts.agg(count(F.col("n")).alias("only_a"), count(-F.col("n")).alias("only_b"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each type and description: pairs of addresses in both, in both with the same ratio, in a alone and in b alone.

    As in same_rows, numbers go over the shuffle, once; a pair without both addresses is like no other.
    """
    key, what = ("address", "address2"), ("type", "description", "ratio")
    sides = [s.select(*key, *what) for s in (a, b)]
    known = _valued(sides, *what)
    for c in key:
        values = _valued(sides, c).withColumnRenamed("number", f"number_{c}")
        sides = [by(s, values, c) for s in sides]
    sides = [by(s, known, *what) for s in sides]
    lone = F.when(F.col("address").isNull() | F.col("address2").isNull(), 1).otherwise(0)
    # the number's last bits: whether it is b's, and whether the pair is like no other
    rows = reduce(DataFrame.union, [s.select(*_packed("number_address", "number_address2"), (F.col("number") * 4 + 2 * k + lone).alias("n")) for k, s in enumerate(sides)])
    of = F.expr("shiftright(n, 1) & 1")
    least = [F.min(F.when(of == k, F.shiftright("n", 2))).alias(c) for k, c in enumerate("xy")]
    both = apart(rows, "p0").groupBy("p0", F.expr("IF(n & 1 = 1, n & 2, -1)").alias("lone")).agg(*least)
    counts = both.groupBy("x", "y").agg(F.count("*").alias("n"))  # as many as types, descriptions and ratios meet
    for c in "xy":
        own = known.select(F.col("number").alias(c), F.struct(*[F.col(f"of_{w}").alias(w) for w in what]).alias(f"{c}_of"))
        counts = counts.join(own, c, "left")
    counts = counts.withColumn("k", F.coalesce("x_of", "y_of"))
    total = lambda holds: F.sum(F.when(holds, F.col("n")).otherwise(0))
    return counts.groupBy(F.col("k.type").alias("type"), F.col("k.description").alias("description")).agg(
        total(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"),
        total(F.col("x_of.ratio") == F.col("y_of.ratio")).alias("same_ratio"),
        total(F.col("y").isNull()).alias("only_a"),
        total(F.col("x").isNull()).alias("only_b"),
    )


def ground_truth(named: DataFrame, stripped: DataFrame) -> DataFrame:
    """address, status (both, named_only, stripped_only), name, mangled_function, stripped_name of two exports of one program."""
    a = named.select("address", "name", "mangled_function", F.lit(True).alias("a"))
    b = stripped.select("address", F.col("name").alias("stripped_name"), F.lit(True).alias("b"))
    status = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "named_only").otherwise("stripped_only")
    return a.join(b, "address", "full_outer").select("address", status.alias("status"), "name", "mangled_function", "stripped_name")


def label_scores(truth: DataFrame, labelled: DataFrame) -> DataFrame:
    """correct, wrong, missed and extra names of a labelled catalog against the truth, with precision and recall.

    Missed: the truth has a real name and the catalog none; extra: the other way round.
    """
    t = truth.where("status <> 'named_only'").select("address", F.col("name").alias("true_name"), F.col("mangled_function").alias("true_mangled"))
    rows = t.join(labelled.select("address", F.col("name").alias("own")), "address")
    known, named = is_portable(F.col("true_name")), is_portable(F.col("own"))
    right = F.coalesce((F.col("own") == F.col("true_name")) | (F.col("own") == F.col("true_mangled")), F.lit(False))
    verdict = F.when(known & named & right, "correct").when(known & named, "wrong").when(known, "missed").when(named, "extra")
    return _rates(rows.select(verdict.alias("verdict")), "verdict", "extra")


def match_scores(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """The same for matches by category: a match is correct if the name of its main side is the truth's at its diff address."""
    t = truth.select(F.col("address").alias("ea2"), F.col("name").alias("true_name"))
    rows = matches.join(t, "ea2").where(is_portable(F.col("true_name")))
    verdict = F.when(F.col("name1") == F.col("true_name"), "correct").otherwise("wrong")
    return rows.groupBy("category").agg(*[F.count_if(verdict == v).alias(v) for v in ("correct", "wrong")]).withColumn("precision", F.col("correct") / (F.col("correct") + F.col("wrong")))


def _rates(rows: DataFrame, column: str, *more: str) -> DataFrame:
    counts = rows.agg(*[F.count_if(F.col(column) == v).alias(v) for v in ("correct", "wrong", "missed", *more)])
    share: Column = F.col("correct") / F.nullif(F.col("correct") + F.col("wrong"), F.lit(0))
    return counts.withColumn("precision", share).withColumn("recall", F.col("correct") / F.nullif(F.col("correct") + F.col("wrong") + F.col("missed"), F.lit(0)))


def confusion(rows: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, precision and recall of a prediction."""
    cells = {"tp": truth & predicted, "fp": ~truth & predicted, "fn": truth & ~predicted, "tn": ~truth & ~predicted}
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    return counts.withColumn("precision", F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).withColumn("recall", F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)))


def census(table: DataFrame, key: str) -> DataFrame:
    """For each column: its nulls, its distinct values, and a sum of digests of its values with their keys, which is the same in any order of rows."""
    digest = lambda c: F.conv(F.substring(F.md5(F.concat_ws("=", F.col(key).cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("null"))).cast("binary")), 1, 8), 16, 10).cast("long")
    values = table.select(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("null"), F.md5(F.col(c).cast("string").cast("binary")).alias("value"), digest(c).alias("digest")).alias(c) for c in table.columns])
    rows = values.select(F.explode(F.array(*[F.col(c) for c in table.columns])).alias("v"))
    return rows.groupBy(F.col("v.column").alias("column")).agg(F.count_if(F.col("v.null")).alias("nulls"), F.countDistinct("v.value").alias("distinct_values"), F.sum("v.digest").alias("digest"))


def catalogs_equal(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> DataFrame:
    """table, only_a, only_b for every table of two catalogs, rows compared as multisets."""
    rows = [same_rows(a[t], b[t], a[t].columns).select(F.lit(t).alias("table"), "only_a", "only_b") for t in a if t in b]
    return reduce(DataFrame.union, rows)


def compare_traces(one: DataFrame, two: DataFrame) -> DataFrame:
    """seq, id1, id2, decision1, decision2 of the candidates that two traces decide differently, or that only one has (null in the other)."""
    sides = [t.select("seq", "id1", "id2", "description", F.col("decision").alias(f"decision{n}")) for n, t in ((1, one), (2, two))]
    both = sides[0].join(sides[1], ["seq", "id1", "id2", "description"], "full_outer")
    return both.where(~F.col("decision1").eqNullSafe(F.col("decision2"))).orderBy("seq", "id1", "id2")
