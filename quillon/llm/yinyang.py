"""Centroid clustering with Yinyang's group bounds.

The centroids are put into a few groups once, by a short clustering of the first
centroids. Every vector keeps an upper bound of the distance to its own centroid
and one lower bound a group, of the distance to the nearest other centroid in it.
After the centroids moved, the upper bound grows by the own centroid's way and each
lower bound shrinks by the longest way in its group. Then

1. globally: a vector whose upper bound is below all its lower bounds stays; of the
   others the upper bound is made exact and tried again;
2. by group: only groups whose lower bound does not exceed the exact distance can
   hold a centroid as near, or as near and of smaller number;
3. the centroids of these groups are scanned exactly, in whole numbers.

Bounds are rounded outward at each step, so that they never skip a tie.

Each round is one pass without a shuffle: it reads the vectors with their bounds, and
writes both anew, in the shared folder, together with one row of sums for each task and
cluster. Only sums by cluster and component go to the driver (clusters x components
numbers); the centroids go to the tasks by closure. A lost executor costs its tasks of
one round. The table of the round before is deleted. Memory in a task is one batch.

Defined results: vectors that are null, hold null or non-finite components or are not of
``length`` components take no part; a null key takes part and starts no cluster while
others can; repeated rows count each and are clustered alike; equal hashes of first
centroids are ordered by components; equal distances go to the smaller number; an
empty cluster keeps its centroid; fewer vectors than ``k`` make fewer clusters; no
vectors give no rows. Columns of the input beside key and vector are not read, whatever
their names. Numbers beyond 64 bits in a result raise an error; any within are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, lean, table

K, ROUNDS, LENGTH, SCALE = 16, 3, 64, 64
#: Outward rounding of bounds, far above that of doubles.
SLACK = 1e-12
STATE = "id long, v array<long>, cluster int, upper double, lower array<double>, distance long, n long, sums array<long>"
_NAMES = [f.split()[0] for f in STATE.split(", ")]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of ``b``."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    room = 4 * a.shape[1] * most * most
    if room < 2**53:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]).astype(np.int64)
    kind = np.int64 if room < 2**62 else object
    x, y = a.astype(kind), b.astype(kind)
    return np.stack([((x - c) ** 2).sum(1) for c in y], 1)


def _own(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` to the same rows of ``b``."""
    most = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    kind = np.int64 if 4 * a.shape[1] * most * most < 2**62 else object
    return ((a.astype(kind) - b.astype(kind)) ** 2).sum(1)


def _root(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64))


def grouped(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: a short clustering of the centroids themselves,
    from spread first ones. Any grouping gives the same clusters."""
    points = centroids.astype(np.float64)
    heads = points[np.linspace(0, len(points) - 1, groups).astype(int)]
    for _ in range(rounds):
        of = ((points[:, None, :] - heads[None]) ** 2).sum(2).argmin(1)
        heads = np.stack([points[of == g].mean(0) if (of == g).any() else heads[g] for g in range(groups)])
    return of


class Round:
    """Assignment of batches to centroids that moved by ``drift`` since the bounds were made."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, drift: np.ndarray | None):
        self.centroids, self.group = centroids, group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max()) + 1)]
        self.drift = None if drift is None else drift * (1 + SLACK)
        self.scanned = 0

    def _lowest(self, distances: np.ndarray, members: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """A lower bound of the distances to all members but the own centroid."""
        others = np.where(members[None, :] == cluster[:, None], np.inf, _root(distances))
        return others.min(1) * (1 - SLACK)

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        every = squares(v, self.centroids)
        self.scanned += every.size
        cluster = every.argmin(1)  # the first of equal ones
        distance = every[np.arange(len(v)), cluster]
        lower = np.stack([self._lowest(every[:, m], m, cluster) for m in self.members], 1)
        return cluster, _root(distance) * (1 + SLACK), lower, distance

    def move(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New clusters and bounds; the distances are all exact if ``exact``, else -1 where none was made."""
        cluster, lower = cluster.copy(), lower.copy()
        upper = (upper + self.drift[cluster]) * (1 + SLACK)
        far = np.array([self.drift[m].max() for m in self.members])
        finite = np.isfinite(lower)
        lower = np.where(finite, lower - far - (np.abs(np.where(finite, lower, 0)) + far) * SLACK, lower)
        distance = np.full(len(v), -1, object if v.dtype == object else np.int64)
        open_ = np.flatnonzero(upper >= lower.min(1))
        asked = np.arange(len(v)) if exact else open_
        own = _own(v[asked], self.centroids[cluster[asked]])
        distance = distance.astype(own.dtype)
        distance[asked] = own
        upper[asked] = _root(own) * (1 + SLACK)
        self.scanned += len(asked)
        open_ = open_[upper[open_] >= lower[open_].min(1)]
        best, best_at = distance[open_].copy(), cluster[open_].copy()
        scans = []
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(lower[open_, g] <= upper[open_])
            if not len(rows):
                continue
            found = squares(v[open_[rows]], self.centroids[members])
            self.scanned += found.size
            if found.dtype != best.dtype:
                best, distance = best.astype(object), distance.astype(object)
            near = found.argmin(1)
            near_d, near_c = found[np.arange(len(rows)), near], members[near]
            wins = (near_d < best[rows]) | (near_d == best[rows]) & (near_c < best_at[rows])
            best[rows[wins]], best_at[rows[wins]] = near_d[wins], near_c[wins]
            scans.append((g, members, rows, found))
        before = cluster[open_]
        moved = np.flatnonzero(best_at != before)
        # the centroid that was left is now one of the others of its group
        left = self.group[before[moved]]
        lower[open_[moved], left] = np.minimum(lower[open_[moved], left], _root(distance[open_[moved]]) * (1 - SLACK))
        cluster[open_], distance[open_], upper[open_] = best_at, best, _root(best) * (1 + SLACK)
        for g, members, rows, found in scans:
            lower[open_[rows], g] = self._lowest(found, members, cluster[open_[rows]])
        return cluster, upper, lower, distance


def whole(vectors: pa.Array, scale: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix of floor(scale * x)) of the vectors that take part; the matrix
    is of Python's numbers where longs could not hold a component."""
    lens = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lens == length)
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)
    good = np.isfinite(flat).all(1)
    rows, made = rows[good], np.floor(flat[good] * scale)
    if np.abs(made).max(initial=0) < 2.0**62:
        return rows, made.astype(np.int64)
    return rows, np.array([[int(x) for x in r] for r in made], object).reshape(len(rows), length)


def _totals(totals: dict, cluster: np.ndarray, values: np.ndarray) -> None:
    for c in np.unique(cluster):
        mine = values[cluster == c]
        if mine.dtype != object and int(np.abs(mine).max(initial=0)) * len(mine) >= 2**62:
            mine = mine.astype(object)
        n, sums = totals.get(c, (0, 0))
        totals[c] = (n + len(mine), sums + mine.sum(0).astype(object))


def _rows(ids: pa.Array, v: np.ndarray | None, cluster: np.ndarray, upper, lower, distance: np.ndarray) -> pa.RecordBatch:
    m = len(cluster)
    none = pa.nulls(m)
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1), kind))
    columns = [ids, none.cast(pa.list_(pa.int64())) if v is None else lists(v, pa.int64()), pa.array(cluster, pa.int32()), none.cast(pa.float64()) if v is None else pa.array(upper), none.cast(pa.list_(pa.float64())) if v is None else lists(lower, pa.float64()), pa.array(distance, pa.int64()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _sums(totals: dict) -> pa.RecordBatch:
    m, keys = len(totals), sorted(totals)
    none = pa.nulls(m)
    sums = pa.array([[int(x) for x in np.atleast_1d(totals[c][1])] for c in keys], pa.list_(pa.int64()))
    columns = [none.cast(pa.int64()), none.cast(pa.list_(pa.int64())), pa.array(keys, pa.int32()), none.cast(pa.float64()), none.cast(pa.list_(pa.float64())), none.cast(pa.int64()), pa.array([totals[c][0] for c in keys], pa.int64()), sums]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _pass(at: Round, batches: Iterator[pa.RecordBatch], scale: int, length: int, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows with new clusters and bounds, then the task's sums: of the vectors, or
    of the distances in the last pass, whose rows carry no vectors any more."""
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        ids, v = batch.column(0), batch.column(1)
        if first:
            kept, values = whole(v, scale, length)
            if not len(kept):
                continue
            ids = ids.take(pa.array(kept))
            cluster, upper, lower, distance = at.first(values)
        else:
            values = v.flatten().to_numpy().reshape(len(ids), -1)
            lower = batch.column(4).flatten().to_numpy().reshape(len(ids), -1)
            cluster, upper, lower, distance = at.move(values, batch.column(2).to_numpy(), batch.column(3).to_numpy(), lower, exact=last)
        _totals(totals, cluster, distance[:, None] if last else values)
        yield _rows(ids, None if last else values, cluster, upper, lower, distance)
    if totals:
        yield _sums(totals)


def _gathered(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and sums of each cluster: clusters x components numbers."""
    rows = state.filter("n IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    found: dict[int, tuple[int, dict]] = {}
    for r in rows.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        found.setdefault(r["cluster"], (r["n"], {}))[1][r["i"]] = int(r["s"])
    return {c: (n, [sums[i] for i in range(len(sums))]) for c, (n, sums) in found.items()}


def _array(rows: list[list[int]]) -> np.ndarray:
    small = all(-(2**62) < x < 2**62 for r in rows for x in r)
    return np.array(rows, np.int64 if small else object)


def cluster(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: int = 1, groups: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector
    that takes part, the final centroids). First centroids are the ``k`` vectors whose
    SHA-256 of ``seed:key`` is smallest."""
    spark = rows.sparkSession
    plain = rows.select(rows[key].cast("long").alias("id"), rows[vector].cast("array<double>").alias("v"))
    usable = (F.size("v") == length) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    heads = plain.filter(usable).select(mark.alias("mark"), F.transform("v", lambda x: F.floor(x * scale).cast("decimal(38,0)")).alias("c"), "v")
    heads = [[int(x) for x in r["c"]] for r in heads.orderBy(F.col("mark").asc_nulls_last(), "v").limit(k).select("c").collect()]
    schema = f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not heads:
        return spark.createDataFrame([], schema), np.zeros((0, length), np.int64)
    centroids = _array(heads)
    group = grouped(centroids, min(groups or -(-k // 4), len(heads)))
    group = np.unique(group, return_inverse=True)[1]
    shelf, state, drift = Shelf(spark), plain, None
    for r in range(rounds + 1):
        last = r == rounds
        at = Round(centroids, group, drift)

        def run(batches, at=at, first=r == 0, last=last):
            return _pass(at, batches, scale, length, first, last)

        read = state if r == 0 else state.filter("n IS NULL").select("id", "v", "cluster", "upper", "lower")
        state = shelf.put(f"round{r}", read.mapInArrow(lean(run), STATE))
        if r:
            shelf.drop(f"round{r - 1}")
        totals = _gathered(state)
        if last:
            break
        moved = _array([[s // totals[c][0] for s in totals[c][1]] if c in totals else [int(x) for x in old] for c, old in enumerate(centroids)])
        drift, centroids = _root(_own(moved, centroids)), moved
    names = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    inertia = {c: s[0] for c, (_, s) in totals.items()}
    if sum(inertia.values()) >= 2**63:
        raise OverflowError("the inertia does not fit into 64 bits")
    each = [F.struct(F.lit(inertia.get(c, 0)).cast("long").alias("cluster_inertia"), F.lit(name).alias("centroid_sha256")) for c, name in enumerate(names)]
    found = state.filter("n IS NULL").withColumn("_c", F.get(F.array(*each), F.col("cluster")))
    found = found.select(F.col("id").alias(key), "cluster", "distance", "_c.cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "_c.centroid_sha256")
    return found, centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))[0]


def _assigned(n: int) -> str:
    """SQL of one assignment and of the centroids that follow from it."""
    return f"""
a{n} AS (SELECT vec_id, e, list_sort(list_transform(cs, lambda z: {{'d': CAST(list_sum(list_transform(list_zip(e, z.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'k': z.k}}))[1] AS m
  FROM kept, (SELECT list({{'k': k, 'c': c}} ORDER BY k) AS cs FROM c{n - 1}) AS l),
s{n} AS (SELECT m.k AS k, i, sum(e[i]) AS s, count(*) AS n FROM a{n}, (SELECT unnest(range(1, 65)) AS i) AS d GROUP BY 1, 2),
f{n} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY k),
c{n} AS (SELECT c{n - 1}.k, coalesce(f{n}.c, c{n - 1}.c) AS c FROM c{n - 1} LEFT JOIN f{n} ON f{n}.k = c{n - 1}.k),"""


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS INTEGER) AS k, e AS c FROM kept ORDER BY k LIMIT 16),{"".join(_assigned(n) for n in (1, 2, 3))}
{_assigned(4).split("s4 AS")[0].strip()}
t AS (SELECT vec_id, m.k AS cluster, m.d AS distance FROM a4)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM t JOIN c3 ON c3.k = t.cluster
"""
