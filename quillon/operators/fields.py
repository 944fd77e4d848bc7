"""Managed citations of Word documents: items, printed numbers, and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import records


def items(citations: DataFrame) -> DataFrame:
    """doc_id, key, item, numbers, number: keyed items by first appearance; the data of the
    first mention holds. A citation with as many numbers as keyed items maps them by
    place; any other gives all its numbers to each of its items. One shuffle, by document."""
    keyed = F.filter(F.col("items"), lambda i: i["key"] != "")
    rows = citations.select("doc_id", "ord", "numbers", keyed.alias("k")).repartition("doc_id").select("doc_id", "ord", "numbers", F.size("k").alias("n"), F.posexplode("k").alias("i", "x"))
    own = F.when(F.col("n") == F.size("numbers"), F.slice("numbers", F.col("i") + 1, F.lit(1))).otherwise(F.col("numbers"))
    at = F.struct("ord", "i")
    first = rows.groupBy("doc_id", F.col("x.key").alias("key")).agg(F.min(at).alias("at"), F.min_by("x.item", at).alias("item"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("numbers"))
    return first.withColumn("number", F.row_number().over(W.partitionBy("doc_id").orderBy("at"))).drop("at")


def audit(citations: DataFrame, registry: DataFrame, reference) -> tuple[DataFrame, DataFrame]:
    """(references, numbering). ``reference`` turns a table with a JSON column
    ``item`` into reference columns. References carry canonical number, metadata
    status and issues, printed numbers and number_ok; numbering has a row per
    document with missing and extra numbers and the overall status."""
    refs = records.check(reference(items(citations)), registry)
    refs = refs.withColumn("number_ok", (F.size("numbers") == 0) | (F.col("numbers") == F.array("number")))
    refs = refs.select("doc_id", F.col("number").alias("canonical_number"), "item_key", "title", "doi", F.col("status").alias("metadata_status"), F.col("issues").alias("metadata_issues"), "source", F.col("numbers").alias("printed_numbers"), "number_ok")
    docs = refs.groupBy("doc_id").agg(F.max("canonical_number").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("printed_numbers")))).alias("seen"), F.bool_or(F.col("metadata_status").isin("suspect", "broken") | ~F.col("number_ok")).alias("bad"))
    want = F.sequence(F.lit(1), F.col("n"))
    off = F.size("seen") > 0
    docs = docs.withColumn("missing", F.when(off, F.array_except(want, "seen")).otherwise(F.array().cast("array<int>"))).withColumn("extra", F.when(off, F.array_except("seen", want)).otherwise(F.array().cast("array<int>")))
    state = F.when(F.col("bad") | (F.size("missing") + F.size("extra") > 0), "suspect").otherwise("ok")
    return refs, docs.select("doc_id", "missing", "extra", state.alias("status"))
