"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are cut into slices of their components; every slice of a partition's
rows is one list of local scores, and a row's score is the sum over its slices.

1. Every partition sends, per query, the whole scores of the rows that lead its
   local lists. The k-th best of all of them is a safe cutoff: at least k rows
   score as much.
2. The cutoffs go out. A row whose slices all stay below cutoff / slices stays
   below the cutoff in sum, so only entries that reach that share are collected.
3. The sums of what was collected are resolved exactly, and what reaches the
   cutoff is ranked, ties to the smaller id.

Queries are a stated set that is held against all rows in blocks: a wave of at
most :data:`WAVE` queries is broadcast, its size checked beforehand, and rows
stream past it. Memory per task is a batch of scores and k rows per query;
executors that go are replaced by rerunning their partitions.

Defined results: vectors that are null or hold null or non-finite components,
and rows with a null id, take no part; vectors of different lengths have no
score together; rows with the query's own id are not its candidates; repeated
candidate rows count each; a query with fewer than k candidates gets them all;
an empty table gives no rows. A score beyond 64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, stored, table

K, SCALE, SLICES = 10, 1024, 2
#: Queries and bytes of queries in one wave, and scores held at once in a task.
WAVE, WAVE_BYTES, BLOCK = 4096, 64 << 20, 2_000_000


def integers(vectors: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of floor(scale * x)) for each length among the usable vectors."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lens = np.where(np.asarray(vectors.is_null()), -1, vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.cumsum(np.maximum(lens, 0)) - np.maximum(lens, 0)
    for n in np.unique(lens[lens > 0]):
        rows = np.flatnonzero(lens == n)
        matrix = flat[at[rows][:, None] + np.arange(n)]
        good = np.isfinite(matrix).all(1)
        yield rows[good], np.floor(matrix[good] * scale)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a . b' in whole numbers: in doubles while they are exact, else in longs, else in
    Python's numbers; only a score that does not fit itself raises."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return a @ b.T
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    if any(abs(x) >= 2**62 for x in exact.flat):  # leaves room for the sum of the slices
        raise OverflowError("a score does not fit into 64 bits")
    return exact.astype(np.int64)


class Scores:
    """Slice scores of a wave's queries against a batch of rows."""

    def __init__(self, ids: np.ndarray, vectors: dict[int, tuple[np.ndarray, np.ndarray]], slices: int):
        self.ids, self.slices = ids, slices
        self.vectors = vectors  # length -> numbers of the queries, their matrix
        order = np.argsort(ids, kind="stable")
        self.order, self.sorted = order, ids[order]

    def of(self, batch: pa.RecordBatch, scale: int):
        """Yields (query numbers, row ids, list of slice score matrices)."""
        every = batch.column(0)
        known = ~np.asarray(every.is_null())
        ids = every.fill_null(0).to_numpy(zero_copy_only=False)
        for rows, matrix in integers(batch.column(1), scale):
            keep = known[rows]
            rows, matrix = rows[keep], matrix[keep]
            n = matrix.shape[1] if len(rows) else -1
            if n not in self.vectors:
                continue
            numbers, queries = self.vectors[n]
            edges = np.linspace(0, n, min(self.slices, n) + 1).astype(int)
            step = max(1, BLOCK // len(rows))
            for a in range(0, len(numbers), step):
                q = numbers[a : a + step]
                found = [products(queries[a : a + step, lo:hi], matrix[:, lo:hi]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                found = [s.astype(np.float64) if np.abs(s).max(initial=0) < 2**52 else s for s in found]
                yield q, ids[rows], found, self._own(q, ids[rows])

    def _own(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray | None:
        if not np.isin(rows, self.ids[q]).any():
            return None
        return self.ids[q][:, None] == rows[None, :]


def _first(scores: Scores, k: int, scale: int, batches) -> Iterator[pa.RecordBatch]:
    best: dict[int, np.ndarray] = {}
    for batch in batches:
        for q, _, found, own in scores.of(batch, scale):
            total = sum(found[1:], found[0])
            n = total.shape[1]
            lead = np.zeros(total.shape, bool)
            for s in found:  # the local lists
                if n > k:
                    np.put_along_axis(lead, np.argpartition(s, n - k, 1)[:, n - k :], True, 1)
                else:
                    lead[:] = True
            if own is not None:
                lead &= ~own
            low = np.iinfo(np.int64).min
            held = np.where(lead, total, low).astype(np.int64) if total.dtype != np.float64 else np.where(lead, total, -np.inf)
            if n > k:
                held = np.partition(held, n - k, 1)[:, n - k :]
            for i, number in enumerate(q):
                row = held[i]
                row = row[row > (low if row.dtype == np.int64 else -np.inf)].astype(np.int64)
                before = best.get(number)
                best[number] = np.sort(row if before is None else np.concatenate([before, row]))[-k:]
    if best:
        numbers = np.repeat(np.fromiter(best, np.int64, len(best)), [len(x) for x in best.values()])
        yield pa.record_batch([pa.array(numbers), pa.array(np.concatenate(list(best.values())))], ["q", "score"])


def _second(scores: Scores, cutoff: np.ndarray, k: int, scale: int, batches) -> Iterator[pa.RecordBatch]:
    kept = [np.zeros(0, np.int64)] * 3

    def ranked(q, v, s):
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        return [x[place < k] for x in (q, v, s)]

    for batch in batches:
        new = []
        for q, ids, found, own in scores.of(batch, scale):
            share = cutoff[q][:, None] / len(found)
            enough = found[0] >= share
            for s in found[1:]:
                enough |= s >= share
            if own is not None:
                enough &= ~own
            i, j = np.nonzero(enough)
            total = sum((s[i, j].astype(np.int64) for s in found[1:]), found[0][i, j].astype(np.int64))
            good = total >= cutoff[q[i]]
            new.append((q[i[good]], ids[j[good]].astype(np.int64), total[good]))
        if new:
            kept = ranked(*[np.concatenate([a, *b]) for a, b in zip(kept, zip(*new, strict=True), strict=True)])
    if len(kept[0]):
        yield pa.record_batch([pa.array(scores.ids[kept[0]]), pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2])], ["query_id", "q", "vec_id", "score"])


def top_k(rows: DataFrame, query: Column, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, slices: int = SLICES, wave: int = WAVE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that ``query`` selects."""
    spark = rows.sparkSession
    plain = rows.select(rows[key].cast("long").alias("id"), rows[vector].alias("v"))
    asked = stored(rows.filter(query).select(rows[key].cast("long").alias("id"), rows[vector].alias("v")).filter("id IS NOT NULL AND v IS NOT NULL").distinct())
    n, longest = asked.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    most = max(1, min(wave, WAVE_BYTES // (8 * max(longest or 1, 1))))
    waves = max(1, -(-n // most))
    out = None
    for w in range(waves):
        got = asked.filter(F.pmod(F.xxhash64("id", F.lit("wave")), F.lit(waves)) == w).toArrow()
        ids = got.column("id").to_numpy()
        groups = {m.shape[1]: (r, m) for r, m in integers(got.column("v"), scale) if len(r)} if len(ids) else {}
        if not groups:
            continue
        scores = spark.sparkContext.broadcast(Scores(ids, groups, slices))

        def first(batches, scores=scores):
            return _first(scores.value, k, scale, batches)

        leading = plain.mapInArrow(lean(first), "q long, score long")
        best = leading.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") <= k)
        cutoff = np.full(len(ids), -(2.0**63))
        for r in best.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).collect():
            cutoff[r["q"]] = r["s"]
        limits = spark.sparkContext.broadcast(cutoff)

        def second(batches, scores=scores, limits=limits):
            return _second(scores.value, limits.value, k, scale, batches)

        part = plain.mapInArrow(lean(second), "query_id long, q long, vec_id long, score long")
        part = part.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
        part = part.select("query_id", "rank", "vec_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
