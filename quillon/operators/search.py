"""Bibliographic search: the record whose title an entry holds best, over a stored index.

A record's score for an entry is the share of the title's telling words that the
entry has. The index keeps, for each word, postings of the records that have it. The words of
a title are ordered from the rarest to the most frequent; a record of n words whose first
word in the entry is the p-th has a score of at most (n - p + 1) / n. That bound is known
when the index is built, and postings are kept by it: in bands of a fifth, in blocks of
about :data:`BLOCK` postings, each with the largest bound in it.

A search goes down the bands. An entry whose best score so far is above all bounds that are
left is answered and reads nothing more; of the blocks of a band only those are read
whose largest bound reaches the entry's best score. A word that every title has is
seldom among the rare ones of a title, so its postings have low bounds, and entries that
are answered by a rarer word never read them. What is found is what scoring all records
would find, ties included.

Titles of the same telling words have the same score for every entry, so the index has one posting
for them all, of the record that wins their tie; entries of the same known words have the same
answer, so each such set is asked once. Bounds of 1 come before the bands: an entry that holds a
whole title reads no posting that cannot reach that.

The vocabulary is numbered in order of frequency by a range sort (no task sees it whole);
blocks are dealt by a hash, so a frequent word is many blocks; words that many
entries ask for are salted by :data:`ASKED`. State between bands is a written table.

Defined results: an entry without a word of any title, a null one and an empty one have no
record; records without a telling word in the title are never found; equal scores go to
the longer title, then to the smaller DOI (null last), then title and author; repeated
records count once; repeated entries each get their answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.storage import Scratch
from .records import doi_key, title_words

BANDS, BLOCK, ASKED = 5, 1024, 50_000
#: The tables, their columns as they are read: an index of no titles has no files to tell them.
TABLES = {
    "words": "word string, df long, id long",
    "records": "doi string, title string, folded string, first string, rec long",
    "blocks": "w long, block int, best double, postings array<struct<rec:bigint,size:int,ids:array<bigint>>>, band int",
    "stats": "w long, band int, at array<struct<best:double,block:int>>",
}


@dataclass
class Index:
    """Four tables: words (word, df, id), records (rec, doi, title, folded, first), blocks
    (band, w, block, best, postings) and stats (w, band, its blocks)."""

    words: DataFrame
    records: DataFrame
    blocks: DataFrame
    stats: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        return cls(*[spark.read.schema(columns).parquet(f"{path}/{name}") for name, columns in TABLES.items()])


def _band(bound: Column) -> Column:
    """-1 for bounds of 1, 0 for others above 1 - 1 / BANDS, and so on; whole numbers decide, not quotients."""
    return F.when(bound["n"] == bound["most"], -1).otherwise(F.least(F.floor((bound["n"] - bound["most"]) * BANDS / bound["n"]), F.lit(BANDS - 1))).cast("int")


def build(registry: DataFrame, path: str) -> Index:
    """Writes the index of a registry's titles to a shared folder."""
    spark = registry.sparkSession

    def put(name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}", partitionBy=list(partition_by))
        return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")

    folded = T.norm(F.coalesce("title", F.lit("")))
    first = T.norm(F.coalesce(F.get("authors", 0), F.lit("")))
    known = registry.select(doi_key(F.col("doi")).alias("doi"), "title", folded.alias("folded"), first.alias("first")).distinct()
    order = [F.col("doi").asc_nulls_last(), "title", "first"]
    records = put("records", known.filter(F.size(title_words(F.col("folded"))) > 0).orderBy(*order).withColumn("rec", F.monotonically_increasing_id()))
    named = records.select("rec", F.length("folded").alias("size"), F.explode(title_words(F.col("folded"))).alias("word"))
    words = put("words", named.groupBy("word").agg(F.count(F.lit(1)).alias("df")).orderBy("df", "word").withColumn("id", F.monotonically_increasing_id()))
    titles = named.join(words.select("word", "id"), "word").groupBy("rec", "size").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # of the titles of a set of words the one that wins a tie: the longest, then the first record
    titles = titles.groupBy("ids").agg(F.max(F.struct("size", (-F.col("rec")).alias("back"))).alias("t")).select((-F.col("t.back")).alias("rec"), "t.size", "ids")
    rows = titles.select(F.struct("rec", "size", "ids").alias("posting"), F.size("ids").alias("n"), F.posexplode("ids").alias("p", "w"))
    rows = rows.withColumn("band", _band(F.struct("n", (F.col("n") - F.col("p")).alias("most")))).withColumn("best", (F.col("n") - F.col("p")) / F.col("n"))
    counts = rows.groupBy("w", "band", "best").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
    dealt = rows.join(counts, ["w", "band", "best"]).withColumn("block", F.pmod(F.xxhash64("posting.rec"), F.col("n_blocks")).cast("int"))
    blocks = dealt.groupBy("w", "band", "best", "block").agg(F.collect_list("posting").alias("postings")).select("w", "block", "best", "postings", "band")
    put("stats", put("blocks", blocks, "band").groupBy("w", "band").agg(F.collect_list(F.struct("best", "block")).alias("at")))
    return Index.open(spark, path)


def _ids(entries: DataFrame, index: Index, keys: list[str], entry: str) -> DataFrame:
    """keys, e (a number of the row), ids of the entry's known words. Rows without any are left out."""
    held = F.array_distinct(F.split(T.norm(F.coalesce(entry, F.lit(""))), " "))
    rows = entries.select(*keys, "e", F.explode(held).alias("word")).join(index.words.select("word", "id"), "word")
    return rows.groupBy("e").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def search(entries: DataFrame, index: Index, keys: tuple[str, ...] = ("doc_id", "ord"), entry: str = "entry") -> DataFrame:
    """keys, share, doi, title, folded, first of the best record of every entry; nulls, and a
    share of 0, where there is none."""
    spark, scratch = entries.sparkSession, Scratch(entries.sparkSession)
    given = scratch.put("given", entries.select(*keys, F.col(entry).alias("_entry")).withColumn("e", F.monotonically_increasing_id()))
    known = scratch.put("known", _ids(given, index, list(keys), "_entry"))
    sets = known.groupBy("ids").agg(F.min("e").alias("e")).select("e", "ids")
    state = scratch.put("state0", sets.withColumn("best", F.lit(None).cast("struct<share:double,size:int,back:bigint>")))
    asked = state.select(F.explode("ids").alias("w")).groupBy("w").count().filter(F.col("count") > ASKED)
    salts = scratch.put("salts", asked.select("w", F.ceil(F.col("count") / ASKED).cast("int").alias("salts")))
    salted = not salts.isEmpty()
    for step, band in enumerate(range(-1, BANDS)):
        limit = (BANDS - band) / BANDS  # no bound of this band or a later one is larger, or 1 behind the first step
        # answered entries have a better score than any that is left could reach
        open_ = state.filter(F.col("best").isNull() | ((F.col("best.share") <= limit) & (F.col("best.share") < 1)))
        if step and open_.isEmpty():
            break
        asks = open_.select("e", "ids", F.col("best.share").alias("share"), F.explode("ids").alias("w"))
        asks = asks.join(index.stats.filter(F.col("band") == band).select("w", "at"), "w").select("e", "ids", "share", "w", F.inline("at").alias("bound", "block"))
        asks = asks.filter(F.col("share").isNull() | (F.col("bound") >= F.col("share")))
        blocks = index.blocks.filter(F.col("band") == band).select("w", "block", F.col("best").alias("bound"), "postings")
        on = ["w", "bound", "block"]
        if salted:
            asks = asks.join(salts, "w", "left").withColumn("salt", F.pmod(F.xxhash64("e"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
            blocks = blocks.join(salts, "w", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
            on.append("salt")
        met = asks.join(blocks, on)
        score = lambda p: F.struct((F.size(F.array_intersect("ids", p["ids"])) / F.size(p["ids"])).alias("share"), p["size"].alias("size"), (-p["rec"]).alias("back"))
        found = met.select("e", F.array_max(F.transform("postings", score)).alias("new")).groupBy("e").agg(F.max("new").alias("new"))
        joined = state.join(found, "e", "left").select("e", "ids", F.greatest("best", "new").alias("best"))
        state = scratch.put(f"state{step + 1}", joined)
        scratch.drop(f"state{step}")
    best = known.join(state.select("ids", "best"), "ids").select("e", "best.share", (-F.col("best.back")).alias("rec"))
    rows = given.join(best, "e", "left").join(index.records.select("rec", "doi", "title", "folded", "first"), "rec", "left")
    return rows.select(*keys, F.coalesce("share", F.lit(0.0)).alias("share"), "doi", "title", "folded", "first")
