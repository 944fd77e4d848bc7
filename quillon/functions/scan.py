"""Regular-expression scans that keep positions, as Catalyst expressions.

Spark can extract matches but not where they stand. A text is therefore cut at
the matches once: pieces and matches alternate, and a match's position is the sum
of the lengths before it. Positions are in code points, ends exclusive. Patterns
are Java's; ``(?U)`` gives them Unicode classes. Positions of n matches are made in
blocks of about the root of n, because an array that grows match by match is copied
each time: a text of ten thousands of matches takes a few times what its scan does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,m:string>>"
BIG = 2**30
#: The line ends that Python's ``splitlines`` knows.
LINE_END = "\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, wherever and however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def cut(text: Column, pattern: str) -> Column:
    """Pieces g and matches m in turn: array<struct<g, m>>; the last m is null."""
    return F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def _length(x: Column) -> Column:
    return F.coalesce(F.length(x["g"]), F.lit(0)) + F.coalesce(F.length(x["m"]), F.lit(0))


def _placed(rows: Column, at: Column) -> Column:
    """The matches among ``rows``, the first of which begins at ``at``."""
    first = F.struct(at.alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + F.length(x["g"]), acc["at"] + _length(x)
        own = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull(), F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, first, step, lambda acc: acc["out"])


def _in_blocks(rows: Column) -> Column:
    width = F.ceil(F.sqrt(F.size(rows))).cast("int")
    blocks = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / w).cast("int")), lambda i: F.slice(rows, i * w + 1, w)))

    def joined(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + _length(x)))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, starts, _placed))

    return let(blocks, joined)


#: Matches of which the positions are made in one go.
FEW = 64


def positions(rows: Column) -> Column:
    """The matches of a text that :func:`cut` has cut, with their places; ``rows`` is used often, so let it be a name."""
    return F.when(F.size(rows) <= FEW, _placed(rows, F.lit(0))).otherwise(_in_blocks(rows))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array<struct<start, end, m>>; empty for null."""
    found = let(cut(text, pattern), positions)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPANS))


def sums(values: Column) -> Column:
    """For each whole number of an array the sum of those before it, in blocks of about the
    root of its length, so that no array grows by more than that."""
    first = lambda start: F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def folded(part: Column, start: Column) -> Column:
        return F.aggregate(part, first(start), step, lambda acc: acc["out"])

    def cut(bound: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(bound))), F.lit(1)).cast("int")
        last = F.greatest(F.floor((F.size(bound) - 1) / F.greatest(F.ceil(F.sqrt(F.size(bound))), F.lit(1))), F.lit(0)).cast("int")
        return let(F.struct(width.alias("w"), last.alias("n")), lambda s: F.transform(F.sequence(F.lit(0), s["n"]), lambda i: F.slice(bound, i * s["w"] + 1, s["w"])))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda acc, n: acc + n))
        return F.flatten(F.zip_with(parts, folded(totals, F.lit(0)), folded))

    return let(values, lambda bound: let(cut(bound), joined))


def blanked(text: Column, pattern: str) -> Column:
    """The text with every match replaced by as many spaces."""
    rows = cut(text, pattern)
    out = F.array_join(F.transform(rows, lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.repeat(F.lit(" "), F.coalesce(F.length(x["m"]), F.lit(0))))), "")
    return F.when(text.rlike(pattern), out).otherwise(text)


def replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """The text with every match m replaced by ``by(m)``."""
    rows = cut(text, pattern)
    out = F.array_join(F.transform(rows, lambda x: F.concat(F.coalesce(x["g"], F.lit("")), F.when(x["m"].isNotNull(), by(x["m"])).otherwise(F.lit("")))), "")
    return F.when(text.rlike(pattern), out).otherwise(text)


def lines(text: Column) -> Column:
    """Lines as Python's ``splitlines`` cuts them: no line after a final line end."""
    each = F.split(text, LINE_END, -1)
    return F.when(F.element_at(each, -1) == "", F.slice(each, 1, F.size(each) - 1)).otherwise(each)


def before(text: Column, pattern: str) -> Column:
    """Code points before the first match, null without a match."""
    return F.when(text.rlike(pattern), F.length(F.split(text, pattern, 2)[0]))


def snippet(line: Column, start: Column, end: Column, pad: int) -> Column:
    low = F.greatest(start - pad, F.lit(0))
    return F.regexp_replace(F.substring(line, low + 1, end + pad - low), r"(?U)^\s+|\s+$", "")


def inside(position: Column, held: Column) -> Column:
    """Whether a position lies in one of the spans ``held``."""
    return F.exists(held, lambda s: (s["start"] <= position) & (position < s["end"]))


def join_ints(numbers: Column, sep: str = ", ") -> Column:
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), sep)
