"""Shared plumbing: table access, shared scratch storage, column hygiene."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts can be long, so batches stay small.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``.  Where that is unset a
    temporary folder takes its place on a local master, as in tests; a cluster
    without it is refused, for its executors share no local folder.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if not found:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(own or f"file://{tempfile.mkdtemp(prefix='lakeprofile-')}")
        found = context.getCheckpointDir()
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def scratch(spark: SparkSession) -> str:
    """A fresh path below the shared folder, which is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/lakeprofile-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again.

    Written files outlive the executors that made them, so a lost executor
    costs its running tasks only.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._lakeprofile_scratch = path
    return found


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, once nothing that is still to run reads it."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._lakeprofile_scratch)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Ready a session for Python workers: small batches, and this package on every executor."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    context = spark.sparkContext
    if getattr(context, "_lakeprofile_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = f"{tempfile.mkdtemp()}/{package.name}_code.zip"  # the driver serves it to executors from here
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)
    context._lakeprofile_shipped = True


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, under names that nothing else has."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves ``remainder``; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))
