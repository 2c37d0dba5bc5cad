"""Matches: how candidates are taken, cleaned up and settled.

A match has category (best, partial, unreliable), ea1, name1, ea2, name2, description, ratio, nodes1, nodes2, id1, id2
and seq, the order in which it was found. The order of everything here is (category, ratio descending, seq, ids).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import arrow_map, materialize
from ..functions.names import is_auto

MATCH = ("category", "ea1", "name1", "ea2", "name2", "description", "ratio", "nodes1", "nodes2", "id1", "id2", "seq")
CATEGORIES = ("best", "partial", "unreliable")
#: Candidates that one task reads at once, one by one; rounds go on as long as one leaves less than this share of them.
STEP, SHRINKS = 500_000, 0.75
_BEFORE = (Window.unboundedPreceding, -1)


def rank(category: str | Column = "category") -> Column:
    column = F.col(category) if isinstance(category, str) else category
    return F.when(column == "best", 0).when(column == "partial", 1).when(column == "unreliable", 2).otherwise(3)


def order() -> list[Column]:
    return [rank(), F.desc("ratio"), F.asc("seq"), F.asc("id1"), F.asc("id2")]


def effective() -> Column:
    """A match of equal names counts as certain."""
    return F.when(F.col("name1") == F.col("name2"), 1.0).otherwise(F.col("ratio"))


def entries(matches: DataFrame, number: int) -> DataFrame:
    """For each name of a side its entry: partner and ratio of the last of its matches in their order."""
    name, other = f"name{number}", f"name{3 - number}"
    entry = F.struct(F.col(other).alias("partner"), F.col("ratio").alias("stored"))
    last = F.max_by(entry, F.struct(rank().alias("r"), (-F.col("ratio")).alias("m"), "seq", "id1", "id2"))
    return matches.where(F.col(name).isNotNull()).groupBy(name).agg(last.alias(f"known{number}"))


def _decision(entry1: Column, entry2: Column) -> Column:
    """accepted if the entries of both names leave a candidate standing, else has_best or has_better.

    A certain entry never does. Where neither name is made up, one of name1 only refuses if it is of two equal names,
    whatever the ratios; else a higher ratio refuses.
    """
    named = ~F.coalesce(is_auto(F.col("name1")) | is_auto(F.col("name2")), F.lit(False))
    certain = (entry1["stored"] == 1.0) | (entry2["stored"] == 1.0)
    higher = F.coalesce(entry1["stored"] > F.col("ratio"), F.lit(False)) | F.coalesce(entry2["stored"] > F.col("ratio"), F.lit(False))
    better = F.when(named & entry1.isNotNull(), entry1["partner"].eqNullSafe(F.col("name1"))).otherwise(higher)
    return F.when(F.coalesce(certain, F.lit(False)), "has_best").when(better, "has_better").otherwise("accepted")


def _open(candidates: DataFrame, matches: DataFrame | None) -> DataFrame:
    """Candidates with the entries that matches leave to their names, known1 and known2, and a number that tells equal ones apart."""
    rows = candidates.select(*MATCH)
    for number in (1, 2):
        kind, known = "struct<partner: string, stored: double>", f"known{number}"
        rows = rows.withColumn(known, F.lit(None).cast(kind)) if matches is None else rows.join(entries(matches, number), f"name{number}", "left")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()))


def _before(number: int) -> Window:
    return Window.partitionBy(f"name{number}").orderBy("seq", "id1", "id2", "row").rowsBetween(*_BEFORE)


def _latest(number: int, taken: Column) -> Column:
    """The entry of a name as a candidate finds it: that of the last one taken before it, else the known one."""
    entry = F.struct(F.col(f"name{3 - number}").alias("partner"), effective().alias("stored"))
    latest = F.last(F.when(taken, entry), ignorenulls=True).over(_before(number))
    return F.when(F.col(f"name{number}").isNotNull(), F.coalesce(latest, F.col(f"known{number}")))


def _null_sub() -> Column:
    return F.coalesce(F.col("name1").startswith("nullsub_") | F.col("name2").startswith("nullsub_"), F.lit(False))


def _settled() -> Column:
    """Whether a candidate is taken, null while that is open, from what is known of the ones before it.

    For each of its names: latest, the entry that those surely taken leave; waits, whether others before it are open; won
    and most, the highest ratio of those surely taken and of all that may be. A certain entry is never replaced, and the
    ratios of a made-up name's entries never fall, as all its candidates go by ratios: so one surely taken refuses all
    later ones below it. A candidate that none before it exceeds stands, whichever of them are taken.
    """
    c, never, auto = F.col, F.lit(False), [F.coalesce(is_auto(F.col(f"name{n}")), F.lit(False)) for n in (1, 2)]
    named = ~auto[0] & ~auto[1]
    certain = F.coalesce(c("won1") == 1.0, never) | F.coalesce(c("won2") == 1.0, never)
    exceeded = [auto[n - 1] & F.coalesce(F.greatest(c(f"won{n}"), c(f"known{n}.stored")) > c("ratio"), never) for n in (1, 2)]
    may = F.greatest("most1", "most2")
    unsure = F.coalesce(may == 1.0, never)
    within = ~F.coalesce(F.greatest(may, c("known1.stored"), c("known2.stored")) > c("ratio"), never)
    stands = F.when(named, c("won1").isNotNull() | (c("latest1").isNull() & ~c("waits1") & within)).otherwise(within)
    exact = _decision(c("latest1"), c("latest2")) == "accepted"
    return F.when(~c("waits1") & ~c("waits2"), exact).when(certain | (~named & (exceeded[0] | exceeded[1])), False).when(~unsure & stands, True)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are taken, of candidates in their order with known1, known2 and what is settled of them."""
    entry: tuple[dict, dict] = ({}, {})
    for batch in batches:
        found = []
        for row, name1, name2, ratio, taken, *known in zip(*[c.to_pylist() for c in batch.columns]):
            at = [None if name is None else e.get(name) or (k and (k["partner"], k["stored"])) for name, e, k in zip((name1, name2), entry, known)]
            if taken is None:
                stored = [x[1] for x in at if x and x[1] is not None]
                auto = (name1 or "").startswith("sub_") or (name2 or "").startswith("sub_")
                better = at[0][0] == name1 if at[0] and not auto else ratio is not None and any(x > ratio for x in stored)
                taken = 1.0 not in stored and not better
            if taken:
                found.append(row)
                own = 1.0 if name1 is not None and name1 == name2 else ratio
                for e, name, partner in zip(entry, (name1, name2), (name2, name1)):
                    if name is not None:
                        e[name] = (partner, own)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["row"])


def _one_by_one(rows: DataFrame, total: int) -> DataFrame:
    """Of open and taken candidates those that are taken: pieces of the order, some STEP rows each, are read one after the other, each with the entries that the ones before it leave."""
    pieces = max(1, -(-total // STEP))
    cuts = rows.approxQuantile("seq", [k / pieces for k in range(1, pieces)], 0.1 / pieces) if pieces > 1 else []
    bounds = [None, *sorted(set(cuts)), None]
    left: list[DataFrame | None] = [None, None]
    done = []
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        piece = rows if low is None else rows.where(F.col("seq") > low)
        piece = piece if high is None else piece.where(F.col("seq") <= high)
        for n, own in enumerate(left, 1):
            if own is not None:
                piece = piece.join(own.select(F.col("name").alias(f"name{n}"), F.col("entry").alias("newer")), f"name{n}", "left").withColumn(f"known{n}", F.coalesce("newer", f"known{n}")).drop("newer")
        piece = materialize(piece)
        read = piece.select("row", "name1", "name2", "ratio", "taken", "known1", "known2", "seq", "id1", "id2").repartition(1).sortWithinPartitions("seq", "id1", "id2", "row")  # a piece is of bounded size
        taken = arrow_map(read.drop("seq", "id1", "id2"), _in_order, "row long")
        done.append(materialize(piece.join(taken, "row").select(*MATCH, "row")))
        for n in (1, 2) if high is not None else ():
            entry = F.struct(F.col(f"name{3 - n}").alias("partner"), effective().alias("stored"))
            now = done[-1].where(F.col(f"name{n}").isNotNull()).groupBy(F.col(f"name{n}").alias("name")).agg(F.max_by(entry, F.struct("seq", "id1", "id2", "row")).alias("entry"))
            before = left[n - 1]
            left[n - 1] = materialize(now if before is None else now.unionByName(before.join(now, "name", "left_anti")))
    return reduce(DataFrame.unionByName, done)


def _accepted(rows: DataFrame) -> DataFrame:
    """Of what _open() gives those that are taken.

    Each round settles what can be told from the candidates already settled, and goes on without the refused, which leave
    nothing behind. Where rounds hardly settle more, as in long chains of candidates that hang on each other, the rest is
    read one by one.
    """
    certain = F.coalesce(F.col("known1.stored") == 1.0, F.lit(False)) | F.coalesce(F.col("known2.stored") == 1.0, F.lit(False))  # such entries stay
    rows = materialize(rows.where(~_null_sub() & ~certain).withColumn("taken", F.lit(None).cast("boolean")))
    columns, before, rounds = rows.columns, None, 0
    while True:
        total, left = rows.agg(F.count("*"), F.count_if(F.col("taken").isNull())).first()
        if not left:
            return rows
        if total <= STEP or rounds > 1 and total > SHRINKS * before:
            return _one_by_one(rows, total)
        for n in (1, 2):
            w, has = _before(n), F.col(f"name{n}").isNotNull()
            sure = F.when(F.col("taken"), effective())
            rows = rows.select("*", _latest(n, F.col("taken")).alias(f"latest{n}"), (has & F.coalesce(F.bool_or(F.col("taken").isNull()).over(w), F.lit(False))).alias(f"waits{n}"), F.when(has, F.max(sure).over(w)).alias(f"won{n}"), F.when(has, F.max(effective()).over(w)).alias(f"most{n}"))
        rows = rows.withColumn("taken", F.coalesce("taken", _settled())).select(*columns)
        rows, before, rounds = materialize(rows.where(F.coalesce("taken", F.lit(True)))), total, rounds + 1


def decisions(candidates: DataFrame, matches: DataFrame | None) -> DataFrame:
    """Scored candidates (with seq, ratio and category by consumer), each with its decision: accepted, nullsub, has_best or has_better.

    Candidates come in the order (seq, id1, id2); one that is taken becomes the entry of both its names. Whether a
    candidate stands thus depends on earlier ones that were taken, not on those that were refused. Null subs are never
    taken; a null name has no entry. Where only what is taken is asked for, take() does without the last reading.
    """
    rows = _open(candidates, matches)
    rows = rows.join(_accepted(rows).select("row", F.lit(True).alias("is_taken")), "row", "left")
    found = rows.select("*", _latest(1, F.col("is_taken")).alias("entry1")).select("*", _latest(2, F.col("is_taken")).alias("entry2"))
    return materialize(found.select(*MATCH, F.when(_null_sub(), "nullsub").otherwise(_decision(F.col("entry1"), F.col("entry2"))).alias("decision")))


def take(candidates: DataFrame, matches: DataFrame | None) -> DataFrame:
    """The candidates that decisions() accepts."""
    return _accepted(_open(candidates, matches)).select(*MATCH)


#: Rows that are sent to all executors, such as one for each address of a side. More of them are joined over the shuffle.
SENT = 1_000_000


def sent(rows: DataFrame) -> DataFrame:
    """rows written once and, if they are no more than SENT, sent to all executors where they are joined."""
    rows = materialize(rows)
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _near(matches: DataFrame, value: Column, names: bool = False) -> DataFrame:
    """matches without those that the first of their ea1 leaves behind: all that cleanup() or final_pass() can keep or goes by.

    The first match of an ea1 in the order always stands, so what has less value than its ratio goes; it is only needed
    where a later category has as much value, as a pair's first match hides the later ones. One bound for each ea1 takes
    the place of windows over all matches. names: a pair is one of names; then an ea1 whose names others have too keeps all.
    """
    ranks = [F.max(F.when(rank() == k, F.coalesce(v, F.lit(float("-inf"))))).alias(f"{n}{k}") for n, v in (("r", F.col("ratio")), ("v", value)) for k in range(4)]
    bounds = matches.groupBy(F.col("ea1").alias("at"), *(["name1"] if names else [])).agg(*ranks)
    if names:
        bounds = materialize(bounds)
        shared = F.max(F.col("ea1s") > 1).alias("shared")
        spread = bounds.groupBy("name1").agg(F.count("*").alias("ea1s")).withColumnRenamed("name1", "of")
        bounds = bounds.join(spread, F.col("name1").eqNullSafe(F.col("of"))).groupBy("at").agg(shared, *[F.max(f"{n}{k}").alias(f"{n}{k}") for n in "rv" for k in range(4)])
    first = F.coalesce(*[F.col(f"r{k}") for k in range(4)])
    first = F.when(F.col("shared"), float("-inf")).otherwise(first) if names else first
    bounds = bounds.select("at", first.alias("first"), *[f"v{k}" for k in range(4)])
    last = F.greatest(*[F.when(F.col(f"v{k}") >= F.col("first"), k).otherwise(-1) for k in range(4)])
    bounds = sent(bounds.select("at", "first", last.alias("last")))
    near = matches.join(bounds, F.col("ea1").eqNullSafe(F.col("at")))
    return materialize(near.where((F.coalesce(value, F.lit(float("-inf"))) >= F.col("first")) | (rank() < F.col("last"))).select(*matches.columns))


def cleanup(matches: DataFrame) -> DataFrame:
    """matches without repeated pairs of names, and without those whose ea1 has a strictly more certain one before them."""
    matches = _near(matches, effective(), names=True)
    first = F.row_number().over(Window.partitionBy("name1", "name2").orderBy(*order()))
    once = matches.withColumn("nth", first).where("nth = 1").drop("nth")
    above = F.max(effective()).over(Window.partitionBy("ea1").orderBy(*order()).rowsBetween(*_BEFORE))
    return once.withColumn("above", above).where(F.col("above").isNull() | (F.col("above") <= effective())).drop("above")


def final_pass(matches: DataFrame) -> DataFrame:
    """The settled matches; those of an address with several equally good partners become multimatch."""
    matches = _near(matches, F.col("ratio"))
    until = (Window.unboundedPreceding, Window.currentRow)
    u = matches.withColumn("nth", F.row_number().over(Window.partitionBy("ea1", "ea2").orderBy(*order()))).where("nth = 1").drop("nth")
    top = F.max("ratio").over(Window.partitionBy("ea1").orderBy(*order()).rowsBetween(*until))
    k = u.withColumn("top", top).where("ratio >= top").drop("top")
    top = F.max("ratio").over(Window.partitionBy("ea2").orderBy(*order()).rowsBetween(*until))
    kb = k.withColumn("top", top).where("ratio >= top").drop("top")
    ma = k.withColumn("n", F.count("*").over(Window.partitionBy("ea1"))).where("n > 1").drop("n")
    mb = kb.withColumn("n", F.count("*").over(Window.partitionBy("ea2"))).where("n > 1").drop("n")
    multi = ma.unionByName(mb.join(ma.select("ea1", "ea2"), ["ea1", "ea2"], "left_anti").select(*ma.columns))
    gone1 = ma.select("ea1").distinct()
    gone2 = mb.join(ma.select("ea1", "ea2"), ["ea1", "ea2"], "left_anti").select("ea2").distinct()
    most1, most2 = u.groupBy("ea1").agg(F.max("ratio").alias("most1")), k.groupBy("ea2").agg(F.max("ratio").alias("most2"))
    kept = matches.join(gone1, "ea1", "left_anti").join(gone2, "ea2", "left_anti").join(most1, "ea1").join(most2, "ea2", "left")
    kept = kept.where((F.col("ratio") >= F.col("most1")) & (F.col("ratio") >= F.coalesce("most2", F.lit(0.0)))).select(*MATCH)
    return kept.unionByName(multi.withColumn("category", F.lit("multimatch")).select(*MATCH))


def unmatched(functions: DataFrame, matches: DataFrame, number: int) -> DataFrame:
    """address and name of the functions of a side whose name no match has; a null name counts as a name."""
    names = matches.select(F.col(f"name{number}").alias("matched")).distinct()
    return functions.select("address", "name").join(names, F.col("name").eqNullSafe(F.col("matched")), "left_anti")


def category_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("category", "description").agg(F.count("*").alias("n"))


def summary(matches: DataFrame, total: int) -> DataFrame:
    """For each category, how many addresses of the main side it has, and their percentage of all."""
    found = matches.groupBy("category").agg(F.countDistinct("ea1").alias("n"))
    return found.withColumn("percent", F.col("n") * 100.0 / total)
