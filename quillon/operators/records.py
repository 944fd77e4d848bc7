"""References against registry records.

The registry is a table; a live one can be put behind :func:`fetched`. References
meet it once per distinct DOI, the first registry by priority that knows a DOI
wins, and only pairs of names or titles that neither equality nor their lengths
decide are compared in Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.storage import hadoop_path, shared_folder

RECORD = "source string, priority int, doi string, title string, authors array<string>, year int, volume string, first_page string"
SURNAME, TITLE = 0.85, 0.9

# Frequent words of more than three letters that tell titles apart badly.
STOPWORDS = (
    "about above after again against among based between beyond both does during from "
    "have here into more near over says than that their them then these this those through "
    "toward towards under used using what when where which while with within without exist "
    "also your been were"
).split()


def doi_key(doi: Column) -> Column:
    """DOI names do not depend on case; an empty one is none."""
    return F.nullif(F.lower(F.trim(doi)), F.lit(""))


def fetched(refs: DataFrame, fetch: Callable[[str], dict | None], source: str, priority: int) -> DataFrame:
    """A registry from a function of a DOI, called once for each distinct DOI. What
    it returns None for, or raises on, is unknown."""
    names = ("title", "authors", "year", "volume", "first_page")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doi in batch["doi"]:
                try:
                    got = fetch(doi)
                except Exception:
                    got = None
                if got:
                    rows.append({"source": source, "priority": priority, "doi": doi, **{n: got.get(n) for n in names}})
            if rows:
                out = pd.DataFrame(rows, columns=["source", "priority", "doi", *names])
                out["year"] = out["year"].astype("Int32")
                out["priority"] = out["priority"].astype("int32")
                yield out

    return refs.select(doi_key(F.col("doi")).alias("doi")).filter("doi IS NOT NULL").distinct().mapInPandas(run, RECORD)


def resolve(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``record`` (null if unknown) and ``source`` (empty if unknown). The best
    record of a DOI is a minimum, made before the join and without a sort."""
    fields = ("source", "title", "authors", "year", "volume", "first_page")
    best = registry.withColumn("_k", doi_key(F.col("doi"))).filter("_k IS NOT NULL").groupBy("_k").agg(F.min_by(F.struct(*fields), F.struct("priority", "source", "title")).alias("record"))
    # no DOI begins with a blank: rows without one are spread by their content, and meet nothing
    whole = [f.name for f in refs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]  # types without a hash
    spread = F.concat(F.lit(" "), F.xxhash64(*[F.col(f"`{c}`") for c in whole]).cast("string"))
    rows = refs.withColumn("_k", F.coalesce(doi_key(F.col("doi")), spread)).join(best, "_k", "left").drop("_k")
    return rows.withColumn("source", F.coalesce("record.source", F.lit("")))


@F.pandas_udf(ArrayType(StringType()))
def _author_issues(cited: pd.Series, record: pd.Series, cut: pd.Series) -> pd.Series:
    import difflib
    import functools

    @functools.lru_cache(maxsize=65536)
    def same(a: str, b: str) -> bool:
        if a == b:
            return True
        if 2 * min(len(a), len(b)) < SURNAME * (len(a) + len(b)):
            return False
        return difflib.SequenceMatcher(None, a, b).ratio() >= SURNAME

    def last(name: str) -> str:
        return name.rpartition(" ")[2]

    def letter(name: str) -> str:
        return name[0] if " " in name else ""

    def one(names, truth, short) -> list[str]:
        short = bool(short) or any(n in T.ET_AL for n in names)
        names = [n for n in names if n and n not in T.ET_AL]
        truth = [n for n in truth if n]
        if not names or not truth:
            return []
        issues = []
        strangers = [last(n) for n in names if not any(same(last(n), last(t)) for t in truth)]
        if strangers:
            issues.append("not among the record's authors: " + ", ".join(strangers))
        whole = len(names) >= len(truth) - 2 or len(names) >= 0.7 * len(truth)
        if whole and not short:
            dropped = [last(t) for t in truth if not any(same(last(t), last(n)) for n in names)]
            if dropped:
                issues.append("authors of the record left out: " + ", ".join(dropped))
        for n in names:
            theirs = list(dict.fromkeys(letter(t) for t in truth if letter(t) and same(last(n), last(t))))
            if letter(n) and theirs and letter(n) not in theirs:
                issues.append(f"initial of {last(n)} differs: {letter(n).upper()}, record {'/'.join(theirs).upper()}")
        return issues

    return pd.Series([None if a is None or b is None else one(list(a), list(b), c) for a, b, c in zip(cited, record, cut, strict=True)])


def author_issues(cited: Column, record: Column, truncated: Column) -> Column:
    """Issues of two author lists; lists that are equal once folded need no look."""
    return _name_issues(T.norm_each(F.coalesce(cited, F.array().cast("array<string>"))), T.norm_each(F.coalesce(record, F.array().cast("array<string>"))), truncated)


def _name_issues(a: Column, b: Column, truncated: Column) -> Column:
    """:func:`author_issues` of lists that are folded already."""
    open_ = a != b
    return F.coalesce(_author_issues(F.when(open_, a), F.when(open_, b), F.coalesce(truncated, F.lit(False))), F.array().cast("array<string>"))


def some(c: Column, none) -> Column:
    return F.nullif(c, F.lit(none))


def field_issues(same_title: Column) -> Column:
    """Title, which is the record's or not, year, volume and first page of columns beside ``record``."""
    r = lambda f: F.col(f"record.{f}")
    year, theirs = some(F.col("year"), 0), some(r("year"), 0)
    volume, vol = some(F.col("volume"), ""), some(r("volume"), "")
    page, first = some(F.col("first_page"), ""), some(r("first_page"), "")
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    return F.array_compact(
        F.array(
            F.when(~same_title, text('title of the record: "', T.plain(r("title")), '"')),
            F.when(F.abs(year - theirs) > 1, text("year ", year, ", record ", theirs)),
            F.when(T.volume_key(volume) != T.volume_key(vol), F.when(volume.isNotNull() & vol.isNotNull(), text("volume ", volume, ", record ", vol))),
            F.when(T.first_page(page) != T.first_page(first), F.when(page.isNotNull() & first.isNotNull(), text("first page ", page, ", record ", first))),
        )
    )


def verify(resolved: DataFrame, title_threshold: float = TITLE) -> DataFrame:
    """Adds ``issues`` and ``status`` (ok, suspect) to rows that have a record."""
    # folded once, as columns: each is used several times
    known, none = F.col("record").isNotNull(), F.array().cast("array<string>")
    rows = resolved.withColumns({"_title": T.norm(F.when(known, F.col("title"))), "_theirs": T.norm(F.col("record.title"))})
    rows = rows.withColumns({"_cited": T.norm_each(F.coalesce(F.when(known, F.col("authors")), none)), "_listed": T.norm_each(F.coalesce("record.authors", none))})
    rows = rows.withColumn("_same", T.similar(F.col("_title"), F.col("_theirs"), title_threshold))
    rows = rows.withColumn("_fields", field_issues(F.col("_same"))).withColumn("_names", _name_issues(F.col("_cited"), F.col("_listed"), F.col("truncated")))
    rows = rows.withColumn("issues", F.concat("_fields", "_names")).drop("_fields", "_names", "_title", "_theirs", "_cited", "_listed", "_same")
    return rows.withColumn("status", F.when(F.size("issues") == 0, "ok").otherwise("suspect"))


def check(refs: DataFrame, registry: DataFrame, title_threshold: float = TITLE) -> DataFrame:
    """Every reference with source, issues and status: ok, suspect, broken (unknown
    DOI) or no-doi."""
    out = verify(resolve(refs, registry), title_threshold)
    none = doi_key(F.col("doi")).isNull()
    state = F.when(none, "no-doi").when(F.col("record").isNull(), "broken").otherwise(F.col("status"))
    issues = F.when(F.col("record").isNotNull(), F.col("issues")).when(none, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("no registry knows "), F.col("doi"))))
    return out.withColumn("issues", issues).withColumn("status", state)


# -- free-text entries -----------------------------------------------------------

DOI = r"(?U)\b10\.\d{4,9}/\S+"


def entry_doi(entry: Column) -> Column:
    return F.regexp_replace(F.regexp_substr(entry, F.lit(DOI)), r"[.,;)>]+$", "")


def title_words(folded: Column) -> Column:
    return F.array_distinct(F.filter(F.split(folded, " "), lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS)))


def overlap(entry: Column, title: Column) -> Column:
    """Share of a title's telling words that an entry holds; both folded."""
    words = title_words(title)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, F.split(entry, " "))) / F.size(words)).otherwise(0.0)


def verdict(entry: Column, title: Column, first_author: Column) -> Column:
    """match, check (first author not in the entry) or no-match; all folded."""
    name = some(T.surname(F.coalesce(first_author, F.lit(""))), "")
    return F.when(overlap(entry, title) < 0.6, "no-match").when(~F.array_contains(F.split(entry, " "), name), "check").otherwise("match")


def audit_entries(entries: DataFrame, registry: DataFrame, most: int | None = None, index=None) -> DataFrame:
    """entries: doc_id, ord, entry. All entries of a document, or its first ``most``, get doc_id,
    ord, doi, title of a record and verdict: by their DOI, else by the record that
    ``search`` finds, in an ``index`` that was built before or in one of the registry."""
    from . import search  # reads this module

    spark = entries.sparkSession
    rows = (entries if most is None else entries.filter(F.col("ord") < most)).withColumn("doi", doi_key(entry_doi(F.col("entry")))).withColumn("folded", T.norm(F.col("entry")))
    known = registry.select(doi_key(F.col("doi")).alias("doi"), F.col("title").alias("r_title"), T.norm(F.col("title")).alias("r_folded"), T.norm(F.coalesce(F.get("authors", 0), F.lit(""))).alias("r_first"))
    best = known.filter("doi IS NOT NULL").groupBy("doi").agg(F.min(F.struct("r_title", "r_folded", "r_first")).alias("r"))
    direct = rows.filter("doi IS NOT NULL").join(best, "doi", "left")
    bare = F.length(F.trim(F.regexp_replace("entry", DOI, ""))) < 15
    direct = direct.select("doc_id", "ord", "doi", F.col("r.r_title").alias("title"), F.when(F.col("r").isNull(), "no-match").when(bare, "match").otherwise(verdict(F.col("folded"), F.col("r.r_folded"), F.col("r.r_first"))).alias("verdict"))
    if index is None:
        folder = shared_folder(spark)
        index = search.build(registry, folder)
        files, place = hadoop_path(spark, folder)
        files.deleteOnExit(place)
    sought = search.search(rows.filter("doi IS NULL").withColumn("_words", F.col("folded")), index, ("doc_id", "ord", "_words"))
    judged = F.when(F.col("title").isNull(), "no-match").otherwise(verdict(F.col("_words"), F.col("folded"), F.col("first")))
    return direct.unionByName(sought.select("doc_id", "ord", F.lit(None).cast("string").alias("doi"), "title", judged.alias("verdict")))
