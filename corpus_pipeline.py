"""From raw documents to token ids, in five stages.

Every stage takes all that its predecessor kept, written as Parquet and read
again. All but the last return the columns of ``documents``.

1. language: texts that no language claims clearly go; ``lang`` becomes the
   language found.
2. near duplicates: of each group of documents that links of similarity 0.8 or
   more connect one stays, the one with the smallest id; of rows that share that id
   and are linked, the one whose text comes first by hash. Ids that repeat with texts
   that are not linked are different documents. A row without an id counts like any
   other and comes last in its group. Texts without words are linked with nothing: all stay.
3. personal data is replaced by its kind in brackets; null texts stay null.
4. sources are mixed to their weights: a document stands as often as the mix
   takes it. Rows that repeat an id and a size are taken alike; rows without an id
   go by their text.
5. SentencePiece ids, and whether they decode to the text again.

Empty tables pass through every stage; null texts are rejected by the first. Whole
texts are used, however long. Columns of the table beyond those of ``documents`` are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.llm import jaccard, langid, mixing, pii, sptokens
from quillon.llm.common import Shelf, n_words, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs.select(*COLUMNS), langid.learn(docs)).filter("lang_ok")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    rows = jaccard.join(docs, links=False).filter("n_shingles > 0")
    order = F.struct(F.col("id").isNull(), "id", "mark")
    first = rows.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.id").alias("id"), F.col("first.mark").alias("mark"))
    stays = stored(first)
    marked = docs.withColumn("_mark", F.xxhash64("text"))
    kept = marked.join(stays, marked["doc_id"].eqNullSafe(stays["id"]) & (marked["_mark"] == stays["mark"]), "left")
    kept = kept.filter(F.col("mark").isNotNull() | (n_words(F.col("text")) == 0))
    if not rows.groupBy("id", "mark").count().filter("count > 1").isEmpty():  # rows that repeat an id and a text
        again = W.partitionBy("doc_id", "_mark").orderBy("lang", "source", "n_chars")
        kept = kept.filter("mark IS NULL").unionByName(kept.filter("mark IS NOT NULL").withColumn("_n", F.row_number().over(again)).filter("_n = 1").drop("_n"))
    return kept.select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(pii.detect(docs.select(*COLUMNS)))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    rows = docs.withColumn("_size", n_words(F.col("text"))).withColumn("_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string"))))
    plan = mixing.mix(rows, key="_key").filter("copies > 0").groupBy("key", "size").agg(F.max("copies").alias("copies"))
    taken = rows.join(plan, (rows["_key"] == plan["key"]) & (rows["_size"] == plan["size"]))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = sptokens.encode(docs.select("doc_id", "lang", "source", "text"), back="round_trip", drop=("text",))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", tokens),
]

#: SQL cannot express compression, boosted trees or piece encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, shelf = spark.read.parquet(f"{sf_dir}/documents.parquet"), Shelf(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shelf.put(f"stage{i}", docs)
            shelf.clear(f"stage{i}")  # the stage before has been read
    return docs
