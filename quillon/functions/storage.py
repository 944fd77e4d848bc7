"""Tables between the steps of an operator, in a folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder of spark.checkpoint.dir; one of this machine's own only where
    none is set and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"quillon-{os.getpid()}")
    return f"{named.rstrip('/')}/tables-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM, whatever store the path is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


class Scratch:
    """Written tables, which end the lineage: a lost executor costs a reread. Each goes when
    dropped, or when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame, *partition_by: str, compression: str | None = None) -> DataFrame:
        path = shared_folder(self.spark)
        try:
            df.write.parquet(path, partitionBy=list(partition_by), compression=compression)
        finally:
            files, place = hadoop_path(self.spark, path)
            files.deleteOnExit(place)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            files, place = hadoop_path(self.spark, self.paths.pop(name))
            files.delete(place, True)


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """For tasks, which have no JVM: the file system of an address, and the path in it."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")
