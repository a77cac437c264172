"""Shared-folder tables and session settings for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when a sum over its rows has shown that it has at most this many bytes.
BROADCAST_BYTES = 24 << 20
#: Rows and bytes in one Arrow batch sent to a Python task; texts can be long, so the default of 10,000 rows is too many.
ARROW_ROWS, ARROW_BYTES = 256, 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset a temporary one is made, but only for
    a local master (tests): on a cluster no machine sees another's temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: later jobs neither recompute it nor
    lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def materialize_parts(df: DataFrame, tag: str, by: str, values: Iterable[int]) -> list[DataFrame]:
    """``materialize`` in one pass as a table for each of ``values`` of the integer column ``by``, which they lack; each
    can be discarded by itself."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    out = []
    df.write.partitionBy(by).parquet(path)
    for value in values:
        part = f"{path}/{by}={value}"
        # A part without rows has no folder yet.
        spark.createDataFrame([], df.drop(by).schema).write.mode("append").parquet(part)
        held = spark.read.schema(df.drop(by).schema).parquet(part)
        held.table_path = part
        out.append(held)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        if df is not None:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(df.table_path)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Serve this package to the Python workers, once per Spark context; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_gridspark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="gridspark-")) / "gridspark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._gridspark_shipped = True


def prepare_tasks(spark: SparkSession) -> None:
    """Before Python tasks: serve the package, and keep Arrow batches of texts small (fewer rows stay as the session has
    them)."""
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own: ``names``, with more underscores where ``df`` has them already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _width(name: str, kind: T.DataType) -> Column:
    """About the bytes that a value takes in memory."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * (8 if not isinstance(kind.elementType, (T.StructType, T.StringType)) else 48) + 24
    return F.lit(64 if isinstance(kind, T.StructType) else 8)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if its rows have at most ``limit`` bytes, else as it is, so
    that Spark shuffles both sides."""
    row = F.lit(16).cast("long")
    for f in df.schema:
        row = row + _width(f.name, f.dataType)
    held = df.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(df) if held <= limit else df
