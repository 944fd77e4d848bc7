"""Filter interaction audit by mask histogram.

Five filters judge every text; which of them it fails is one number of five bits. What
any order of the filters keeps and removes follows from how many rows have each mask:
the first failing filter of the order removes a row. So the corpus is read once, and
all 120 orders are worked out on 32 cells a part.

1. Native expressions make the bits of A to D from the text, and a 256-bit digest that
   stands for it from there on: no text is shuffled.
2. Rows are counted by digest and id, joined with their labels by id, and counted by
   digest and part. The smallest id of a digest passes filter E, all others fail it: a
   text is a group, so its bits A to D and this one correction make its cells.
   Counts are combined before each shuffle, so copies that are a third of all rows are
   one row a task; the first count has the id in its key, so no digest is a hot key.
3. Cells are summed to 32 a part, and each part's cells are held against the 600 steps
   of all orders. ``shapley`` needs no order: a mask of b bits is removed by each of
   its filters in 120 / b orders.

Filters (failing): A under 200 words; B distinct words under half of the words; C more
than 2 in 100 code points are A to Z; D holds any of ``#$%&*|``; E equal to the text of
a smaller id. Words are maximal runs of ``[^\\x20\\x09-\\x0D]``, with case.

Defined results: a null text is empty, and equal to other empty ones; a null part is the
empty string's; a row without an id has no label, is no copy of anything and makes
nothing one; rows that repeat an id and a text all pass E, or all fail it; of repeated
labels any that says 1 holds, null labels say nothing, labels without a document are
not used; an empty table gives no rows. Whole texts are used, however long. Only
the named columns are read, whatever others there are.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
GAP = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits 0 to 3: the failures of A to D, of a text that is not null."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda failing, i: F.when(failing, F.lit(1 << i)).otherwise(F.lit(0))
    return bit(n < 200, 0) + bit(100 * distinct.cast("long") < 50 * n.cast("long"), 1) + bit(100 * capitals.cast("long") > 2 * F.length(text).cast("long"), 2) + bit(text.rlike("[#$%&*|]"), 3)


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows a part."""
    t = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].cast("long").alias("id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("digest"), failures(t).alias("low"))
    each = rows.groupBy("digest", "id", "part", "low").agg(F.count(F.lit(1)).alias("n"))
    said = lambda c: F.max(F.when(labels[c] == 1, 1).otherwise(0))
    marks = labels.filter(labels[key].isNotNull()).groupBy(labels[key].cast("string").alias("_k")).agg(said("quality").alias("q"), said("toxic").alias("x"))
    # rows without an id meet no label; their digests keep them from being one key
    each = each.withColumn("_k", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("digest")))).join(marks, "_k", "left")
    good, toxic = (F.when(F.col(c) == 1, F.col("n")).otherwise(F.lit(0).cast("long")) for c in ("q", "x"))
    each = each.select("digest", "part", "low", "id", "n", good.alias("good"), toxic.alias("toxic"))
    # rows without an id pass E; they are no part of the groups of texts
    counts = ("n", "good", "toxic")
    sums = [F.sum(F.when(F.col("id").isNull(), F.col(c)).otherwise(0)).alias(f"no_{c}") for c in counts] + [F.sum(F.when(F.col("id").isNotNull(), F.col(c)).otherwise(0)).alias(c) for c in counts]
    lowest = [F.min_by(c, "id").alias(f"first_{c}") for c in counts]  # one row, as digest, part and id are a key
    groups = each.groupBy("digest", "low", "part").agg(F.min("id").alias("first"), *lowest, *sums)
    groups = groups.withColumn("least", F.min("first").over(W.partitionBy("digest")))  # a row for each part that has the text
    passing = [F.col(f"no_{c}") + F.when(F.col("first") == F.col("least"), F.col(f"first_{c}")).otherwise(0) for c in counts]
    failing = [F.col(c) - F.when(F.col("first") == F.col("least"), F.col(f"first_{c}")).otherwise(0) for c in counts]
    row = lambda mask, values: F.struct(mask.alias("mask"), *[v.cast("long").alias(c) for v, c in zip(values, counts, strict=True)])
    both = groups.select("part", F.explode(F.array(row(F.col("low"), passing), row(F.col("low") + 16, failing))).alias("c")).filter("c.n > 0")
    return both.groupBy("part", F.col("c.mask").alias("mask")).agg(*[F.sum(f"c.{c}").alias(c) for c in counts])


def _bits(letters: Column) -> Column:
    """The bits of the filters that a string names."""
    each = F.filter(F.split(letters, ""), lambda c: c != "")
    return F.aggregate(each, F.lit(0), lambda acc, c: acc + F.power(F.lit(2), F.instr(F.lit(LETTERS), c) - 1).cast("int"))


def orders(found: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the cells of the parts."""
    held = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = held.select("part", "cells", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    rows = rows.withColumn("bit", _bits(F.expr("substring(filter_order, step, 1)"))).withColumn("before", _bits(F.expr("substring(filter_order, 1, step - 1)")))
    bit, before = F.col("bit"), F.col("before")

    def total(field: str, which) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(which(c["mask"]), c[field]).otherwise(0))

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~gone(m)
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(fails(c["mask"]), c["n"] * F.floor(F.lit(len(ORDERS)) / F.bit_count(c["mask"])).cast("long")).otherwise(0))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_W = f"regexp_extract_all(t, '{WORD}')"
_BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
_BIT_OF = "CASE {0} " + " ".join(f"WHEN '{c}' THEN {b}" for c, b in _BIT.items()) + " END"
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, {_W} AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
p AS (SELECT a.c || b.c || x.c || y.c || z.c AS o FROM f a, f b, f x, f y, f z WHERE len(list_distinct([a.c, b.c, x.c, y.c, z.c])) = 5),
s AS (SELECT o, step, {_BIT_OF.format("substr(o, step, 1)")} AS bit, coalesce((SELECT sum({_BIT_OF.format("substr(o, j, 1)")}) FROM (SELECT unnest(range(1, 5)) AS j) AS r WHERE j < step), 0)::BIGINT AS before
      FROM p, (SELECT unnest(range(1, 6)) AS step) AS q),
r AS (SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, bit,
        sum(CASE WHEN mask & bit = 0 AND mask & before = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM h, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
