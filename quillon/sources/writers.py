"""One text file a document, replaced whole or not at all.

1. New texts are written to a table of this run, compressed; Spark commits it. What a lost or
   repeated attempt wrote is not in it.
2. Tasks write the texts of that table beside the files, some at a time, under names of the attempt's
   own, and move them to where they belong. A move replaces a file at once; a task that is run
   again writes the same texts again. Whoever reads a file meanwhile reads the old text or the new one.

Run again after a failure, :func:`replace_texts` writes all that is still to be written. The
folder of the run goes at the end, with what lost attempts left in it.

Defined results: a null path is not written; a null text is an empty file; of rows with the
same path the first by text is written; folders that are missing are made. Texts are shuffled
only where a path has several rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Scratch, hadoop_path, located
from ..operators import numbering

MANIFEST = "path string, staged string, digest string, bytes long"
#: Files of a task that are on their way at a time: they take room beside those they replace.
AT_A_TIME = 256


def _staged(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files, base = located(folder)
    for whole in batches:
        for at in range(0, whole.num_rows, AT_A_TIME):
            batch, rows = whole.slice(at, AT_A_TIME), []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, name = (text.as_py() or "").encode(), uuid.uuid4().hex
                with files.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(data)
                rows.append((path, f"{folder}/{name}", hashlib.sha256(data).hexdigest(), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "staged", "digest", "bytes"])


def _digest(files: pafs.FileSystem, path: str) -> str | None:
    if files.get_file_info(path).type != pafs.FileType.File:
        return None
    got = hashlib.sha256()
    with files.open_input_stream(path, compression=None) as source:
        while part := source.read(1 << 20):
            got.update(part)
    return got.hexdigest()


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            files, source = located(row["staged"])
            target = located(row["path"])[1]
            if files.get_file_info(source).type == pafs.FileType.File:
                files.create_dir(target.rpartition("/")[0], recursive=True)
                files.move(source, target)
            elif _digest(files, target) != row["digest"]:
                raise OSError(f"{row['path']}: neither the staged text nor the new one is there")
        yield batch


def replace_texts(rows: DataFrame, folder: str, path: str = "path", text: str = "text") -> DataFrame:
    """Writes ``text`` to each ``path``; ``folder`` holds files on their way and must be
    on the file system of the paths. The manifest (path, digest, bytes) of what was written."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    stage = f"{folder.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    files, place = hadoop_path(spark, stage)
    files.mkdirs(place)
    try:
        given = rows.filter(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.coalesce(text, F.lit("")).alias("text"))
        texts = scratch.put("texts", given, compression="zstd")
        often = scratch.put("often", texts.groupBy("path").count().filter("count > 1").select("path"))
        first = texts.join(often, "path", "left_semi").groupBy("path").agg(F.min("text").alias("text"))
        one = texts.join(often, "path", "left_anti").unionByName(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _moved(_staged(stage, batches))

        done = scratch.put("done", one.mapInArrow(run, MANIFEST).drop("staged"))
        scratch.drop("texts", "often")
        return done
    finally:
        files.delete(place, True)


def renumber_files(manuscripts: DataFrame, folder: str) -> DataFrame:
    """Renumbers text files in place: manuscripts have ``path`` and ``text``. Files of which
    the renumbered text equals the old one are not touched; Word files, by their suffix, never.
    The manifest of the files that were replaced."""
    rows = manuscripts.filter(~F.lower("path").endswith(".docx"))
    changed = numbering.renumber(rows.select("path", "text")).filter("changed").select("path", F.col("renumbered").alias("text"))
    return replace_texts(changed, folder)
