"""Cuts of lineage that survive lost executors, and getting this package's code to the executors."""

from __future__ import annotations

import tempfile
import warnings
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none, a temporary one, on one machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Whether the files of a query's shuffles go when it has ended, rather than when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, gathered: bool = False, sorted_: bool = False) -> DataFrame:
    """Write df as a table to the shared folder and go on from its files; the shuffles that made it are removed.

    gathered: what a scan's many tasks make is little each; it is dealt into partitions of a good size first.
    sorted_: numbers follow each other closely, so their differences are written.

    Unlike checkpoint(), whose result keeps the estimated size of its plan, a written table has its real size: over many
    rounds of joins the estimates' products grow to numbers that planning does not come to an end with.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.hint("rebalance") if gathered else df).write.options(**{"parquet.block.size": 32 << 20} | ({"parquet.writer.version": "v2"} if sorted_ else {})).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


@contextmanager
def published(spark: SparkSession, out: str) -> Iterator[str]:
    """A folder to write to, which becomes out when all is written: out is whole or not there. It must not exist before."""
    if exists(spark, out):
        raise FileExistsError(f"{out} exists")
    made = f"{out.rstrip('/')}.unfinished-{uuid4().hex}"
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    files = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield made
        if not files.rename(path(made), path(out)):
            raise OSError(f"{out} could not be written")
    except BaseException:
        files.delete(path(made), True)
        raise


#: Rows that a Python function gets at once, so that they and what it makes of them stay small on both sides.
ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once a session: a cluster need not have it installed. Arrow batches of the session have ROWS rows at most."""
    if not 0 < int(spark.conf.get(_BATCH)) <= ROWS:
        spark.conf.set(_BATCH, ROWS)
    context = spark.sparkContext
    if getattr(context, "_package_sent", False):
        return
    package = Path(__file__).parent
    with zipfile.ZipFile(path := f"{tempfile.mkdtemp()}/{package.name}.zip", "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(path)
    context._package_sent = True


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow for functions that live in this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_column(spark: SparkSession, run: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], kind: str) -> Callable[..., Column]:
    """A column function over Arrow arrays; other columns do not pass through Python."""
    ship(spark)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)  # that the kind could be read off type hints
        return F.arrow_udf(run, kind, PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)
