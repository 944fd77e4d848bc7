"""Normalisation and similarity of names and titles."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Phrases that stand for omitted authors (fixed values).
ET_AL = ("et al", "et alii", "and others", "others")


def fold(text: str | None) -> str:
    """Plain lower-case letters and digits with single spaces; tags and accents go."""
    apart = unicodedata.normalize("NFKD", re.sub(r"<[^>]+>", " ", text or ""))
    low = "".join(c for c in apart if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^a-z0-9 ]", " ", low).split())


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold(t))


@F.pandas_udf(ArrayType(StringType()))
def _fold_each(names: pd.Series) -> pd.Series:
    return names.map(lambda row: None if row is None else [fold(t) for t in row])


def _ascii(text: Column) -> Column:
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9 ]", " "), " +", " "))


def norm(text: Column) -> Column:
    """:func:`fold` of a column. ASCII text stays in the JVM; only the rest goes to Python."""
    foreign = F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7f]")
    return F.coalesce(_fold(F.when(foreign, text)), _ascii(text))


def norm_each(names: Column) -> Column:
    """:func:`fold` of every name of an array."""
    foreign = F.exists(names, lambda n: F.coalesce(n, F.lit("")).rlike(r"[^\x00-\x7f]"))
    return F.coalesce(_fold_each(F.when(foreign, names)), F.transform(names, _ascii))


def surname(folded: Column) -> Column:
    return F.element_at(F.split(folded, " "), -1)


def initial(folded: Column) -> Column:
    """First letter of the given name; empty for a lone surname."""
    return F.when(F.contains(folded, F.lit(" ")), F.substring(folded, 1, 1)).otherwise("")


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similar(a: Column, b: Column, least: float) -> Column:
    """Whether the matching-blocks ratio of a and b is at least ``least``. Equal
    strings, and those whose lengths alone rule it out, never leave the JVM."""
    total = F.length(a) + F.length(b)
    bound = F.when(total == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / total)
    open_ = (a != b) & (bound >= least)
    return F.when(a == b, True).when(bound < least, False).otherwise(F.coalesce(_ratio(F.when(open_, a), F.when(open_, b)) >= least, F.lit(False)))


def plain(text: Column) -> Column:
    """Without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", ""), r"(?U)\s+", " "))


def first_page(pages: Column) -> Column:
    """What stands before the first dash of a page range."""
    return F.trim(F.split(F.coalesce(pages, F.lit("")), "[-‒–—]")[0])


def volume_key(volume: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(volume, F.lit("")), r"(?U)\s+", ""))


# The entities of XML.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"))


def unescape(text: Column) -> Column:
    """The five XML entities, one after the other."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
