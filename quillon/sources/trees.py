"""Folders of projects and plain manuscripts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import located

# Folders that are never looked into.
PRUNED = (".git", "node_modules", "__pycache__", ".venv", "venv", "artifacts")
# Names of a README, best first.
READMES = ("README.md", "README.rst", "README.txt", "README")


def files(spark: SparkSession, root: str, repo_id: str = "repo") -> DataFrame:
    """repo_id, rel_path of a folder's files, hidden and empty ones too; links are not
    followed, nor are they files. Names only are listed, by the driver, folder by folder,
    on any file system that Hadoop knows: Spark's own file index hides names that begin
    with a dot or an underscore. A folder that is not there raises."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    local = fs.getUri().getScheme() == "file"
    fs = fs.getRawFileSystem() if local else fs  # the other one hides checksum files
    found, left = [], [(top, "")]
    while left:
        folder, lead = left.pop()
        for entry in fs.listStatus(folder):
            path, name = entry.getPath(), entry.getPath().getName()
            if os.path.islink(path.toUri().getPath()) if local else entry.isSymlink():
                continue
            if not entry.isDirectory():
                found.append((repo_id, lead + name))
            elif name not in PRUNED:
                left.append((path, f"{lead}{name}/"))
    return spark.createDataFrame(sorted(found), "repo_id string, rel_path string")


def readme(spark: SparkSession, root: str, repo_id: str = "repo") -> DataFrame:
    """repo_id, readme_text: the best README of a folder; no row if there is none."""
    rows = spark.read.format("binaryFile").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*[F.lit(n) for n in READMES]), name)
    text = F.decode("content", "UTF-8")
    return rows.filter(rank > 0).select(F.lit(repo_id).alias("repo_id"), rank.alias("rank"), text.alias("t")).groupBy("repo_id").agg(F.min_by("t", "rank").alias("readme_text"))


def manuscripts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and text of plain files; line ends become \\n."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


#: Bytes of texts that are handed on together.
BYTES = 4 << 20


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed_on(paths: list[str], read: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([r.decode() for r in read], pa.string())], ["path", "text"])

    for batch in batches:
        paths, read, size = [], [], 0
        for path in batch.column(0).to_pylist():
            files, place = located(path)
            with files.open_input_stream(place, compression=None) as source:
                read.append(source.read())
            paths.append(path)
            size += len(read[-1])
            if size >= BYTES:
                yield handed_on(paths, read)
                paths, read, size = [], [], 0
        if paths:
            yield handed_on(paths, read)


def texts(paths: DataFrame) -> DataFrame:
    """path and text of the files that a table names in ``path``, read where its rows are: many small
    files are neither listed by the driver nor a task for every few of them. An empty file is
    an empty text; a null path has no row; a file that is not there, or no UTF-8, raises."""
    return paths.filter("path IS NOT NULL").select("path").mapInArrow(_texts, "path string, text string")
