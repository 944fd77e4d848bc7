"""Mixing sources to target weights by weighted fair queueing.

Every document copy gets a virtual finish time: the source tokens up to and
including it, in shuffled order, divided by the source's target. All copies are
ranged by that time and the range is cut where the total budget is spent.
Only DataFrame operations; the text is read once and never shuffled.

Skew: a running sum within a source would put a hot source into one task. Each
source's shuffled order is therefore cut into slots by the shuffle key; slot
sums are made before any shuffle, a source's offsets are sums over slots, and
rows are ordered only inside (source, slot). The global order is handled the
same way: finish times fall into ranges, range sums are made before the shuffle,
and only the one range in which the budget runs out is put into full order.

Defined results: null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; repeated rows are rows; an empty table gives
an empty result. Other columns may have any names: only those given are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, n_words, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(src, source_size) -> with weight and target. ``src`` is an array: empty
    for a null source, else the source alone; so null is a key like any other.

    A target is min(most * size, level * weight). Sources reach their ceiling in
    the order of ceiling / weight, so the level follows from running sums; rows
    here are sources, which need a weight each and are few.
    """
    order = W.orderBy(F.size("src") == 0, "src")
    by_ratio = W.orderBy("_ratio", "_rank")
    upto = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    listed = F.array(*[F.lit(float(x)) for x in weights])
    return (
        sizes.withColumn("_rank", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(listed, (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("_ceiling", F.col("source_size").cast("double") * most)
        .withColumn("_ratio", F.col("_ceiling") / F.col("weight"))
        .withColumn("_level", (F.sum(F.col("source_size").cast("double")).over(everything) * share - F.coalesce(F.sum("_ceiling").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
        # the first source whose ceiling is not reached fixes the level of all that follow
        .withColumn("_level", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(everything)["_level"])
        .withColumn("target", F.least("_ceiling", F.coalesce(F.col("_level") * F.col("weight"), F.col("_ceiling"))))
        .select("src", "source_size", "weight", "target")
    )


def shuffle_key(key: Column, seed: str) -> Column:
    """A fixed pseudo-random order: rising hexadecimal digests of seed and key."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))


def mix_sizes(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """rows: key, src, size, h. Returns key, src, h, size, source_size, target and
    copies (how often the mix takes the document, 0 to ``most``)."""
    rows = stored(rows.select("key", "src", "size", "h"))
    n, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # slots and ranges grow with the rows and the words, so that none holds many
    slots = 1 << max(10, min(24, (n // 50_000).bit_length() + 4))
    ranges = 1 << max(10, min(30, (words // 2_000_000).bit_length() + 4))
    rows = rows.withColumn("slot", F.floor(F.conv(F.substring("h", 1, 7), 16, 10).cast("long") * slots / (1 << 28)))
    by_slot = rows.groupBy("src", "slot").agg(F.sum("size").alias("_words"))
    in_order = W.partitionBy("src", "_high").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    high = stored(by_slot.withColumn("_high", F.floor(F.col("slot") / 1024)))
    by_high = high.groupBy("src", "_high").agg(F.sum("_words").alias("_all")).withColumn("_base", F.coalesce(F.sum("_all").over(W.partitionBy("src").orderBy("_high").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    goal = stored(targets(high.groupBy("src").agg(F.sum("_words").alias("source_size")), weights, share, most))
    offsets = (
        high.join(by_high.select("src", "_high", "_base"), ["src", "_high"])
        .withColumn("offset", F.col("_base") + F.coalesce(F.sum("_words").over(in_order), F.lit(0)))
        .join(goal, "src")
        .select("src", "slot", "offset", "source_size", "target")
    )
    within = W.partitionBy("src", "slot").orderBy("h", "key", "size").rowsBetween(W.unboundedPreceding, 0)
    offsets = stored(offsets)
    placed = stored(rows.join(offsets, ["src", "slot"]).withColumn("upto", F.col("offset") + F.sum("size").over(within)).drop("offset"))

    budget = F.sum("target")
    total = goal.agg(budget).first()[0] or 0.0
    copies = (
        placed.filter("size > 0")
        .withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(most)])))
        .withColumn("finish", F.try_divide((F.col("copy") * F.col("source_size") + F.col("upto")).cast("double"), F.col("target")))
        .withColumn("range", F.least(F.floor(F.col("finish") * ranges), F.lit(4 * ranges)))
    )
    spent = copies.groupBy("range").agg(F.sum("size").alias("_words"))
    spent = spent.withColumn("_group", F.floor(F.col("range") / 65536))
    sums = spent.groupBy("_group").agg(F.sum("_words").alias("_all")).withColumn("_base", F.coalesce(F.sum("_all").over(W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    running = spent.join(sums, "_group").withColumn("before", F.col("_base") + F.coalesce(F.sum("_words").over(W.partitionBy("_group").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # the range in which the budget runs out: the last that begins within it
    cut = running.filter(F.col("before") <= F.lit(total)).agg(F.max(F.struct("range", "before"))).first()[0]
    if cut is None:
        return placed.select("key", "src", "h", "size", "source_size", "target", F.lit(0).alias("copies"))
    edge = (
        copies.filter(F.col("range") == cut["range"])
        .withColumn("_sum", F.sum("size").over(W.orderBy("finish", F.size("src") == 0, "src", "h", "key", "size", "copy").rowsBetween(W.unboundedPreceding, 0)))
        .filter(F.col("_sum") + cut["before"] <= total)
        .groupBy("src")
        .agg(F.max("finish").alias("_last"))
    )
    # within a source finish times rise with the order, so the last one taken at the edge says all
    # it meets the rows by source and slot, for a source alone can be hot
    last = offsets.join(edge, "src", "left").select("src", "slot", F.col("_last"))
    finish = [F.try_divide((F.lit(i) * F.col("source_size") + F.col("upto")).cast("double"), F.col("target")) for i in range(most)]
    takes = [F.when((F.col("size") > 0) & ((F.floor(f * ranges) < cut["range"]) | (f <= F.col("_last"))), 1).otherwise(0) for f in finish]
    result = placed.join(last, ["src", "slot"]).withColumn("copies", sum(takes[1:], takes[0]))
    return result.select("key", "src", "h", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """The mix plan of a table: one row per document with its size, its source's
    size and target, and ``copies``; ``taken`` is copies * size."""
    rows = docs.select(
        docs[key].alias("key"),
        F.when(docs[source].isNull(), F.array().cast("array<string>")).otherwise(F.array(docs[source].cast("string"))).alias("src"),
        n_words(docs[text]).alias("size"),
        shuffle_key(docs[key], seed).alias("h"),
    )
    return mix_sizes(rows, weights, share, most).withColumn("taken", F.col("copies") * F.col("size"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][rk % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS ceiling FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY ceiling / weight, rk) AS o FROM w),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(weight) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
t AS (SELECT source, source_size, least(ceiling, coalesce((min(CASE WHEN ceiling / weight >= lev THEN {{'o': o, 'lev': lev}} END) OVER ()).lev * weight, ceiling)) AS target, rk FROM l),
p AS (SELECT d.*, t.source_size, t.target, t.rk,
             sum(d.size) OVER (PARTITION BY t.rk ORDER BY h, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT p.*, copy, (copy * source_size + upto)::DOUBLE / target AS finish FROM p, (VALUES (0), (1)) v(copy) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rk, h, doc_id, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM c),
k AS (SELECT rk, max(finish) AS last FROM g WHERE spent <= (SELECT sum(target) FROM t) GROUP BY rk)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 OR last IS NULL THEN 0 ELSE size * ((upto::DOUBLE / target <= last)::INT + ((source_size + upto)::DOUBLE / target <= last)::INT) END AS BIGINT) AS taken
FROM p LEFT JOIN k USING (rk)
"""
