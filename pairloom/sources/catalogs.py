"""A catalog: one version's functions and side tables; and a pair of them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import md_value
from ..schema import FUNCTIONS, PROVENANCE_TABLES, SIDE_TABLES


@dataclass
class Catalog:
    """functions has the columns of schema.FUNCTIONS; tables the side tables by name, those absent being empty."""

    functions: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.functions.sparkSession.createDataFrame([], (SIDE_TABLES | PROVENANCE_TABLES)[name])
        return self.tables[name]

    @cached_property
    def ids_differ(self) -> bool:
        """Whether each function has an id of its own, as in a catalog that was exported; counted once."""
        return self.functions.groupBy("id").count().where("count > 1").isEmpty()

    def numbered(self) -> DataFrame:
        """functions with md and ea, the doubles of md_index and address."""
        return self.functions.withColumn("md", md_value(F.col("md_index"))).withColumn("ea", md_value(F.col("address")))


@dataclass
class Pair:
    main: Catalog
    diff: Catalog

    def sides(self) -> tuple[Catalog, Catalog]:
        return self.main, self.diff


def read_catalog(spark: SparkSession, folder: str) -> Catalog:
    """A catalog kept as one Parquet table each in a folder; side tables that are not there are empty."""
    found = {}
    for name, schema in (SIDE_TABLES | PROVENANCE_TABLES).items():
        try:
            found[name] = spark.read.schema(schema).parquet(f"{folder}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return Catalog(spark.read.schema(FUNCTIONS).parquet(f"{folder}/functions"), found)


def write_catalog(catalog: Catalog, folder: str, partitions: int | None = None) -> None:
    """functions sorted by address within files, so that ranges of addresses prune; side tables as they are."""
    rows = catalog.functions if partitions is None else catalog.functions.repartitionByRange(partitions, "address")
    rows.sortWithinPartitions("address").write.parquet(f"{folder}/functions")
    for name, table in catalog.tables.items():
        table.write.parquet(f"{folder}/{name}")
