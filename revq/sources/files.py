"""Files of stored tables through Hadoop's file systems, so that any store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of a location."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def committed(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/_SUCCESS")


def committed_parts(spark: SparkSession, root: str, key: str) -> list[int]:
    """Numbers of the ``<key>=<number>`` folders under ``root`` that are committed.

    One glob for all marks: the listing grows with the loads, the calls do not.
    """
    fs, p = file_system(spark, f"{root}/{key}=*/_SUCCESS")
    found = fs.globStatus(p)
    return sorted(int(s.getPath().getParent().getName()[len(key) + 1 :]) for s in found) if found else []


def read_parts(spark: SparkSession, root: str, key: str, parts: list[int] | None = None) -> DataFrame | None:
    """Rows of the committed folders (of ``parts`` only, if given); None where there are none."""
    have = committed_parts(spark, root, key)
    some = have if parts is None else [n for n in have if n in set(parts)]
    return spark.read.option("basePath", root).parquet(*[f"{root}/{key}={n}" for n in some]) if some else None
