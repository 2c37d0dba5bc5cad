"""Catalogs that arrive one after the other, each getting the labels of the one before.

This is an extension: the engine itself is a batch. A stream of folder names (one a row, column path) drives it; every
new catalog is diffed with the last labelled one, and the labelled copy becomes the next reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import port
from ..plans.diff import Settings, update
from ..sources.catalogs import Pair, read_catalog


def follow(paths: DataFrame, first: str, out: str, checkpoint: str, settings: Settings = Settings(), options: port.Options = port.Options()) -> StreamingQuery:
    """Start following paths: out/<batch>-<n>/{functions,results,decisions} for each catalog, in order of path within a batch.

    A batch that is run again after a failure overwrites what it wrote; where it began from is in out/latest.
    """
    spark = paths.sparkSession
    spark.createDataFrame([(-1, first)], "batch long, path string").write.mode("overwrite").parquet(f"{out}/latest/start")

    def batch(arrived: DataFrame, number: int) -> None:
        done = spark.read.schema("batch long, path string").option("recursiveFileLookup", "true").parquet(f"{out}/latest")
        reference = read_catalog(spark, done.where(f"batch < {number}").orderBy("batch").tail(1)[0]["path"])
        last = ""
        for n, row in enumerate(arrived.select("path").distinct().orderBy("path").toLocalIterator()):
            target = read_catalog(spark, row["path"])
            outcome, decisions, _ = update(Pair(reference, target), options, settings)
            source, last = last or "reference", f"{out}/{number}-{n}"
            made = port.labelled_catalog(reference, target, decisions, source, row["path"])
            made.functions.write.mode("overwrite").parquet(f"{last}/functions")
            for name, table in made.tables.items():
                table.write.mode("overwrite").parquet(f"{last}/{name}")
            outcome.results().write.mode("overwrite").parquet(f"{last}/results")
            decisions.drop("place").write.mode("overwrite").parquet(f"{last}/decisions")
            reference = read_catalog(spark, last)
        if last:
            spark.createDataFrame([(number, last)], "batch long, path string").write.mode("overwrite").parquet(f"{out}/latest/{number}")

    return paths.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
