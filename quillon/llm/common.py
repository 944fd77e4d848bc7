"""Helpers that the corpus operators share: tables, shared storage, word spans."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word, wherever a contract speaks of words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none
    is named and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"quillon-{os.getpid()}")
    return f"{named.rstrip('/')}/quillon-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the JVM, whatever store the path is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """What nobody deleted before, also after an error, goes when the driver ends."""
    files, place = hadoop_path(spark, path)
    files.deleteOnExit(place)


@contextlib.contextmanager
def shuffles_cleared(spark: SparkSession):
    """Shuffle files of what runs here go at its end: a written table is read, not made again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Shelf:
    """Tables between the steps of one operator, in the shared folder. Each ends
    the lineage: a lost executor costs a reread and not a recomputation. A table
    goes as soon as all that read it is stored itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        path = shared_dir(self.spark)
        try:
            with shuffles_cleared(self.spark):
                df.write.parquet(path, partitionBy=list(partition_by))
        finally:
            delete_at_exit(self.spark, path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            files, place = hadoop_path(self.spark, self.paths.pop(name))
            files.delete(place, True)

    def clear(self, *but: str) -> None:
        self.drop(*[n for n in self.paths if n not in but])


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """One table of its own, which stays until the driver ends."""
    return Shelf(df.sparkSession).put("", df, *partition_by)


#: Bits of a hash that tell its range; so many counts a class go to the driver.
RANGES = 14


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, per_class: int, highest: int = 1) -> DataFrame:
    """(id, y, text) of at most ``per_class`` labelled documents a class, lowest
    hash of the id first; classes are 0 to ``highest``, labels beyond count as the nearest. Null labels and null texts do not count; of repeated
    labels the highest holds. The sample is chosen from ids alone: counts by class and
    range of hashes (:data:`RANGES`) tell from which range on no id is in it, the rest is
    put into order, and only the bounded list of ids is broadcast."""
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.least(F.greatest(F.ceil(label), F.lit(0)), F.lit(highest)).cast("int")).alias("y"))
    marks = marks.withColumn("h", F.xxhash64("id", F.lit(label))).withColumn("range", F.shiftright("h", 64 - RANGES))
    last, seen = {}, {}
    for r in sorted(marks.groupBy("y", "range").count().collect()):
        if seen.get(r["y"], 0) < per_class:
            last[r["y"]] = r["range"]
        seen[r["y"]] = seen.get(r["y"], 0) + r["count"]
    near = F.lit(False)
    for y, end in last.items():
        near = near | ((F.col("y") == y) & (F.col("range") <= end))
    rank = W.partitionBy("y").orderBy("h", "id")
    some = marks.filter(near).withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= per_class).select("id", "y")
    return docs.select(docs[key].alias("id"), docs[text].alias("text")).filter("text IS NOT NULL").join(F.broadcast(some), "id").select("id", "y", "text")


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null and empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# --------------------------------------------------------------------------
# Words of Arrow string batches, as numpy arrays over the UTF-8 bytes
# --------------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = _rng.integers(1, 2**63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)

#: Bytes that belong to words: all but space and the controls 9 to 13.
PLAIN = np.ones(256, bool)
PLAIN[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of letters: ASCII letters and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.full(max(n, 256), _BASE, np.uint64)
            _powers[0] = 1
            _powers = np.cumprod(_powers, dtype=np.uint64)
    return _powers


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if texts.buffers()[2] is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray, kind: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 offsets of each row's words."""
    inside = kind[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if len(data):
        before[0] = after[-1] = False
        edges = at[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        before[edges] = False
        after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, exact: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, blind to the case of A-Z unless ``exact``;
    spans are not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(lens.sum()) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        value = (_EXACT if exact else _BYTE)[data[place + np.repeat(starts, lens)]] * _power(int(lens.max()))[place]
        return mix(np.add.reduceat(value, first) + lens.astype(np.uint64))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; the caller drops those that cross rows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * _MIX[15] + words[i : i + n] * _MIX[i]
        return mix(h + np.uint64(k))


def lean(run):
    """``run`` over a task's batches, giving freed memory back when the task ends:
    Python workers live on and would keep each operator's high-water mark."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim is not None:
                trim(0)

    return task


def parts(texts: pa.Array, most: int = 2 << 20):
    """(first row, rows) runs of a batch with about ``most`` bytes each, so that
    the arrays made from them stay small; a longer text is a run of its own."""
    data_at = bytes_of(texts)[1]
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(data_at, data_at[row] + most, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end - row
        row = end
