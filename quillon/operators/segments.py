"""Where a manuscript's parts begin: front matter, main text, reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import BIG, before

# Each optional marker needs its own character, so that a run of blanks matches in
# one way only and a failing line costs linear time.
_LEAD = r"^[ \t]*+(?:#{1,6}[ \t]*+)?(?:\*{1,2}[ \t]*+)?"
INTRODUCTION = rf"(?imd){_LEAD}(?:\d++\.?+[ \t]*+)?introduction\b"
LIST_HEADING = rf"(?imd){_LEAD}(?:(?:supplementary|supporting)[ \t]++)?(?:references|bibliography|works cited|literature cited)[ \t]*+\*{{0,2}}[ \t]*+:?[ \t]*$"
LIST_END = rf"(?imdU){_LEAD}(?:appendix|supplement\w*|supporting information|acknowledg\w*)\b"
_MARK = r"[\[(]?\d{1,3}[\]).]\s++"


def main_start(text: Column) -> Column:
    """Code points before the Introduction heading; 0 if there is none."""
    return F.coalesce(before(text, INTRODUCTION), F.lit(0))


def reference_list(text: Column) -> Column:
    """From the last heading of a reference list to the next back-matter heading;
    the whole text if it has no such heading."""
    rest = F.element_at(F.split(text, LIST_HEADING, -1), -1)
    return F.when(text.rlike(LIST_HEADING), F.split(rest, LIST_END, 2)[0]).otherwise(text)


def split_manuscript(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds start, section, list_at (null without a list), front, body (main text up
    to the list), prose (all before the list) and tail. A null text is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("start", main_start(t)).withColumn("section", reference_list(t))
    listed = (F.col("section") != "") & (F.col("section") != t)
    out = out.withColumn("list_at", F.when(listed, F.instr(t, F.col("section")) - 1))
    stop = F.coalesce(F.col("list_at"), F.length(t))
    return (
        out.withColumn("front", F.substring(t, F.lit(1), F.col("start")))
        .withColumn("body", F.substring(t, F.col("start") + 1, F.greatest(stop - F.col("start"), F.lit(0))))
        .withColumn("prose", F.substring(t, F.lit(1), stop))
        .withColumn("tail", F.substring(t, stop + 1, BIG))
    )


def entries(section: Column) -> Column:
    """The entries of a reference list: cut at leading numbers where three or more
    lines have them, else at blank lines, else at line ends; short ones go."""
    mark = rf"(?mdU)^\s*+({_MARK})"
    by_mark = F.slice(F.split(F.regexp_replace(F.translate(section, "\x01", " "), mark, "\x01$1"), "\x01", -1), 2, BIG)
    by_gap = F.split(section, r"(?U)\n\s*\n", -1)
    parts = F.when(F.size(by_mark) >= 3, by_mark).when(F.size(by_gap) >= 3, by_gap).otherwise(F.split(section, "\n", -1))
    clean = F.transform(parts, lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"(?U)\s+", " ")), rf"(?U)^{_MARK}", ""))
    return F.filter(clean, lambda e: F.length(e) >= 25)
