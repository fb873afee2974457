"""Published profiles: numbered versions of a Parquet table in one folder.

A version exists once its success marker does, which the writer leaves last, so
a reader never meets half a profile and a failed run leaves the one before.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VERSION = re.compile(r"v(\d{8})\.parquet$")


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str, committed: bool) -> list[int]:
    path, files = _file_system(spark, folder)
    if not files.exists(path):
        return []
    found = [(s.getPath(), _VERSION.search(s.getPath().getName())) for s in files.listStatus(path)]
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(m[1]) for p, m in found if m and (not committed or files.exists(marker(p, "_SUCCESS"))))


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions that were published whole."""
    return _numbers(spark, folder, committed=True)


def publish(profile: DataFrame, folder: str) -> int:
    """Write ``profile`` as the next version and return its number; two writers of one number can't both succeed."""
    spark = profile.sparkSession
    number = max(_numbers(spark, folder, committed=False), default=0) + 1
    profile.write.mode("error").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{folder}/v{number:08d}.parquet")
    return number


def load(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A published version, by default the last."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no published version {version or ''} in {folder}")
    return spark.read.parquet(f"{folder}/v{version or known[-1]:08d}.parquet")
