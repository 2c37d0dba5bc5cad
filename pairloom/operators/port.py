"""Carrying labels from a reference catalog to a target, with recorded provenance.

Each proposal gets one decision, by rules in a fixed order; applied names that would occur twice in the target are taken
back until none does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from ..durable import materialize
from ..functions.names import is_portable
from ..schema import PROVENANCE_TABLES
from ..sources.catalogs import Catalog
from .state import sent

#: Matches by address alone; they replace a real name only on special request.
STRIPPED = "Same binary with symbols stripped"


@dataclass(frozen=True)
class Options:
    categories: tuple[str, ...] = ("best", "partial")
    min_confidence: float = 0.0
    #: Negative: any number.
    max_hops: int = -1
    overwrite: bool = False
    overwrite_stripped: bool = False


def check_proposals(proposals: DataFrame, reference: DataFrame, target: DataFrame) -> DataFrame:
    """Proposals whose addresses do not exist, or whose names are neither the name nor the mangled name there, and why."""
    rows = proposals
    for n, side in ((1, reference), (2, target)):
        rows = rows.join(side.select(F.col("address").alias(f"ea{n}"), F.col("name").alias(f"own{n}"), F.col("mangled_function").alias(f"mangled{n}"), F.lit(True).alias(f"there{n}")), f"ea{n}", "left")
    wrong = [F.when(F.col(f"there{n}").isNull(), f"no function at address {n}").when(~F.coalesce((F.col(f"name{n}") == F.col(f"own{n}")) | (F.col(f"name{n}") == F.col(f"mangled{n}")), F.lit(False)), f"another name at address {n}") for n in (1, 2)]
    return rows.select("ea1", "name1", "ea2", "name2", F.coalesce(*wrong).alias("problem")).where("problem IS NOT NULL")


def _lead(rows: DataFrame) -> Column:
    """The first field of place that is a number, by which most proposals of an address are told from its first; else place itself."""
    kind = rows.schema["place"].dataType
    if isinstance(kind, StructType) and isinstance(kind[0].dataType, IntegralType):
        return F.coalesce(F.col(f"place.{kind[0].name}").cast("long"), F.lit(-(1 << 63)))
    return F.col("place")


def _decided(rows: DataFrame, options: Options, action: Column | None = None) -> DataFrame:
    """Proposals with selected, claim and the history of their labels by the rules, or all with the action that is known of them."""
    rows = rows.withColumn("hops", F.coalesce(F.col("before") + 1, F.lit(1).cast("long"))).withColumn("confidence", F.coalesce("cumulative_ratio", F.lit(1.0)) * F.col("ratio"))
    real = is_portable(F.col("label2"))
    may = F.lit(options.overwrite) & ((F.col("description") != STRIPPED) | F.lit(options.overwrite_stripped))
    rules = (
        F.when(~F.col("selected"), "not_selected")
        .when(F.col("claim") > 1, "skipped_conflict")
        .when(~is_portable(F.col("label1")), "skipped_not_portable")
        .when(real & (F.col("label1") == F.col("label2")), "confirmed")
        .when(F.lit(options.max_hops >= 0) & (F.col("hops") > options.max_hops), "skipped_hops")
        .when(F.col("confidence") < options.min_confidence, "skipped_ratio")
        .when(real & ~may, "skipped_existing")
        .otherwise("applied")
    )
    action = rules if action is None else action
    written = F.when(is_portable(F.col("mangled1")), F.col("mangled1")).otherwise(F.col("label1"))
    counted = ~action.isin("not_selected", "skipped_conflict", "skipped_not_portable", "confirmed")
    when = lambda c: F.when(counted, c)
    return rows.select("place", "category", "ea1", "ea2", "ratio", "description", action.alias("action"), F.col("label1").alias("reference_name"), F.col("mangled1").alias("reference_mangled"), F.col("label2").alias("name_before"), F.col("mangled2").alias("mangled_before"), when(F.col("hops")).alias("hops"), when(F.col("confidence")).alias("confidence"), when(F.coalesce("origin_address", "ea1")).alias("origin_address"), when(F.coalesce("origin_name", "label1")).alias("origin_name"), "first_labelled_at", F.when(action == "applied", written).alias("written_mangled"))


def decide(proposals: DataFrame, reference: DataFrame, target: DataFrame, origins: DataFrame | None = None, options: Options = Options()) -> DataFrame:
    """A decision for each proposal (category, ea1, ea2, ratio, description, place): action, hops, confidence and the names before and after.

    origins: name origins of the reference (address, name, origin_address, origin_name, hops, cumulative_ratio); history
    counts only while the reference still has the recorded name. Proposals are taken in the order of place.

    Only the first proposal of an address of the target can be applied: what may be that goes over the shuffle and is
    written, the others are decided where they are.
    """
    spark = proposals.sparkSession
    if origins is None:
        origins = spark.createDataFrame([], PROVENANCE_TABLES["name_origin"])
    if "first_labelled_at" not in origins.columns:
        origins = origins.withColumn("first_labelled_at", F.lit(None).cast("string"))
    side = lambda df, n: sent(df.select(F.col("address").alias(f"ea{n}"), F.col("name").alias(f"label{n}"), F.col("mangled_function").alias(f"mangled{n}")))
    known, own = side(reference, 1), side(target, 2)
    target = own.select(F.col("ea2").alias("address"), F.col("label2").alias("name"), F.col("mangled2").alias("mangled_function"))
    rows = proposals.select("category", "ea1", "ea2", "ratio", "description", "place").join(known, "ea1").join(own, "ea2")
    history = sent(origins.select(F.col("address").alias("ea1"), F.col("name").alias("label1"), "origin_address", "origin_name", F.col("hops").alias("before"), "cumulative_ratio", "first_labelled_at"))
    rows = rows.withColumn("selected", F.col("category").isin(*options.categories)).withColumn("lead", _lead(rows))
    least = sent(rows.where(F.coalesce("selected", F.lit(True))).groupBy(F.col("ea2").alias("of"), F.col("selected").alias("kind")).agg(F.min("lead").alias("least")))
    first = F.coalesce("selected", F.lit(True)) & F.col("lead").eqNullSafe(F.col("least"))
    rows = rows.join(least, (F.col("ea2") == F.col("of")) & F.col("selected").eqNullSafe(F.col("kind")), "left").withColumn("first", F.coalesce(first, F.lit(False))).drop("of", "kind", "least", "lead")
    claim = F.row_number().over(Window.partitionBy("ea2", "selected").orderBy("place", "ea1"))
    later = rows.where(~F.col("first")).drop("first").withColumn("claim", F.lit(2)).join(history, ["ea1", "label1"], "left")
    rows = materialize(rows.where("first").drop("first")).join(history, ["ea1", "label1"], "left").withColumn("claim", claim)
    later = _decided(later, options, F.when(~F.col("selected"), "not_selected").otherwise("skipped_conflict"))
    rows = materialize(_decided(rows, options))
    while True:
        after = labelled(target, rows)
        twice = lambda c: after.where(is_portable(F.col(c))).groupBy(c).count().where("count > 1").select(F.col(c).alias(f"twice_{c}"))  # noqa: B023, E731
        applied = F.col("action") == "applied"
        marked = rows.join(twice("name"), F.col("reference_name") == F.col("twice_name"), "left").join(twice("mangled_function"), F.col("written_mangled") == F.col("twice_mangled_function"), "left")
        back = applied & (F.col("twice_name").isNotNull() | F.col("twice_mangled_function").isNotNull())
        marked = materialize(marked.withColumn("changed", back).withColumn("action", F.when(F.col("changed"), "skipped_duplicate_name").otherwise(F.col("action"))).withColumn("written_mangled", F.when(~F.col("changed"), F.col("written_mangled"))).drop("twice_name", "twice_mangled_function"))
        rows = marked.drop("changed")
        if marked.where("changed").isEmpty():
            return rows.unionByName(later)


def labelled(target: DataFrame, decisions: DataFrame) -> DataFrame:
    """target with the applied names and mangled names."""
    applied = decisions.where("action = 'applied'").select(F.col("ea2").alias("address"), F.col("reference_name").alias("new_name"), F.col("written_mangled").alias("new_mangled"))
    joined = target.join(applied, "address", "left")
    return joined.withColumn("name", F.coalesce("new_name", "name")).withColumn("mangled_function", F.coalesce("new_mangled", "mangled_function")).select(*target.columns)


def name_origins(decisions: DataFrame, target_origins: DataFrame | None = None) -> DataFrame:
    """The origins of the names that were applied, and those the target had elsewhere; a name keeps the time it was first carried."""
    at = F.coalesce("first_labelled_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    new = decisions.where("action = 'applied'").select(F.col("ea2").alias("address"), F.col("reference_name").alias("name"), "origin_address", "origin_name", "hops", F.col("confidence").alias("cumulative_ratio"), F.col("description").alias("heuristic"), at.alias("first_labelled_at"))
    if target_origins is None:
        return new
    return new.unionByName(target_origins.join(new.select("address"), "address", "left_anti"), allowMissingColumns=True)


def provenance(previous: DataFrame, main: str, target: str, decisions: DataFrame) -> DataFrame:
    """previous (hop, source, lineage, proposals, applied, confirmed) and a row for this hop; the lineage is a chain of sources."""
    counts = decisions.agg(F.count("*").alias("proposals"), F.count_if(F.col("action") == "applied").alias("applied"), F.count_if(F.col("action") == "confirmed").alias("confirmed"))
    last = previous.agg(F.coalesce(F.max("hop"), F.lit(0)).alias("hop"), F.max_by("lineage", "hop").alias("lineage"))
    row = counts.join(last, F.lit(True)).select((F.col("hop") + 1).alias("hop"), F.lit(main).alias("source"), F.concat(F.coalesce("lineage", F.lit(main)), F.lit(f" -> {target}")).alias("lineage"), "proposals", "applied", "confirmed")
    return previous.unionByName(row)


def require_proposals(proposals: DataFrame, reference: DataFrame, target: DataFrame) -> None:
    """Raises ValueError with the first proposals that do not describe these two catalogs."""
    wrong = check_proposals(proposals, reference, target).orderBy("ea1", "ea2").limit(5).collect()
    if wrong:
        raise ValueError("the results belong to another pair: " + "; ".join(f"{r.ea1} {r.name1} -> {r.ea2} {r.name2}: {r.problem}" for r in wrong))


def labelled_catalog(reference: Catalog, target: Catalog, decisions: DataFrame, source: str, name: str) -> Catalog:
    """target with the applied names, where they come from, one hop more than the reference has behind it, and the decisions."""
    more = {
        "name_origin": name_origins(decisions, target.table("name_origin")),
        "provenance": provenance(reference.table("provenance"), source, name, decisions),
        "port_log": decisions.select(*[f.split()[0] for f in PROVENANCE_TABLES["port_log"].split(", ")]),
    }
    return Catalog(labelled(target.functions, decisions), target.tables | more)


def action_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action").agg(F.count("*").alias("n"))


def inspect(provenance_rows: DataFrame, origins: DataFrame) -> DataFrame:
    """How many hops a catalog has behind it, and its names by hops, with their least and mean confidence."""
    hops = provenance_rows.agg(F.coalesce(F.max("hop"), F.lit(0)).alias("hop"))
    return origins.groupBy("hops").agg(F.count("*").alias("names"), F.min("cumulative_ratio").alias("least"), F.avg("cumulative_ratio").alias("mean")).join(hops, F.lit(True))


