"""Rules of wording as data: thousands of terms from a table, found in one pass.

A rule is a row: ``rule`` (its number), ``term``, ``mode``, ``kind``, ``severity`` and
``suggestion``. Modes: ``word`` (no word character on either side), ``stem`` (none before; the
token goes on to the end of the word, and the suggestion takes over what follows the term) and
``within`` (anywhere). Case does not count. Each rule finds its leftmost matches that do
not overlap each other; matches of different rules may overlap.

All terms are one Aho-Corasick automaton, so the pass over a text costs its length and its
matches and not the number of rules. The automaton is built from the table on each worker;
the table goes there only after its size was measured. A table beyond
:data:`LEXICON_BYTES` is cut by a hash of its rules into slices below it, and each slice is a
pass of its own: no rule is left out, and no worker holds more than one slice.

Defined results: null and empty terms find nothing; equal rules find each their own; a term
that holds a line end is found across it, on the line where it begins; a null text has no
lines. Lines are Python's; positions are code points in the line.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scan import LINE_END
from .segments import split_manuscript
from .wording import PHRASES, SPELLINGS

RULES = "rule long, term string, mode string, kind string, severity string, suggestion string"
#: Bytes of terms, with :data:`OVERHEAD` for each, that one automaton may have.
LEXICON_BYTES, OVERHEAD = 64 << 20, 64
PAD = 16


class _Folding(dict):
    """Code points to lower case by way of upper case, one for one."""

    def __missing__(self, point: int) -> int:
        low = chr(point).upper().lower()
        self[point] = ord(low) if len(low) == 1 else point
        return self[point]


_FOLD = _Folding()


def folded(text: str) -> str:
    """Case folded without a change of length, so that positions hold."""
    return text.lower() if text.isascii() else text.translate(_FOLD)


@functools.lru_cache(maxsize=65536)
def is_word(character: str) -> bool:
    """Whether a character counts as part of a word: letters, marks, digits, joiners."""
    kind = unicodedata.category(character)
    return kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or character in "‌‍"


class Lexicon:
    """Terms by number, compiled when first used; what is shipped are the terms."""

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.rows = rows
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "_automaton": None}

    def _compiled(self):
        if self._automaton is None:
            import ahocorasick

            by_term: dict[str, list] = {}
            for number, term, mode in sorted(self.rows):
                by_term.setdefault(folded(term), []).append((number, mode, len(term)))
            made = ahocorasick.Automaton()
            for term, of in by_term.items():
                made.add_word(term, tuple(of))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(number, start, end) of all matches, in order of where the terms end."""
        made = self._compiled()
        if not len(made) or not text:
            return
        low, past, size = folded(text), {}, len(text)
        for last, of in made.iter(low):
            for number, mode, length in of:
                start, end = last + 1 - length, last + 1
                if start < past.get(number, 0) or mode != "within" and start and is_word(low[start - 1]):
                    continue
                if mode == "word" and end < size and is_word(low[end]):
                    continue
                if mode == "stem":
                    while end < size and is_word(low[end]):
                        end += 1
                past[number] = end
                yield number, start, end


def lexicons(rules: DataFrame, most: int = LEXICON_BYTES) -> Iterator[Lexicon]:
    """The table's terms (rule, term, mode), in as many slices as its measured size needs;
    the driver holds one at a time."""
    rows = rules.select("rule", "term", "mode").filter("rule IS NOT NULL AND term IS NOT NULL AND term <> ''")
    size = rows.agg(F.sum(F.octet_length("term") + OVERHEAD)).first()[0] or 0
    slices = -(-int(size) // most)
    for i in range(slices):
        part = rows if slices == 1 else rows.filter(F.pmod(F.xxhash64("rule", "term", "mode"), F.lit(slices)) == i)
        yield Lexicon([(r["rule"], sys.intern(r["term"]), r["mode"]) for r in part.collect()])


def _lines(text: str) -> list[int]:
    return [0, *[m.end() for m in re.finditer(LINE_END, text)]]


def matches(df: DataFrame, rules: DataFrame, text: str, keys: Sequence[str] = ("doc_id",), most: int = LEXICON_BYTES) -> DataFrame:
    """keys, rule, line, pos, token, snippet, more (characters of the token behind the term)."""
    rows = df.select(*keys, F.col(text).alias("_text"))
    schema = df.select(*keys).schema.add("rule", "long").add("line", "integer").add("pos", "integer").add("token", "string").add("snippet", "string").add("more", "integer")
    names, n = [f.name for f in schema.fields], len(keys)
    spark, out = df.sparkSession, None
    for lexicon in lexicons(rules, most):
        held = spark.sparkContext.broadcast(lexicon)  # below the measured bound
        lengths = spark.sparkContext.broadcast({number: len(term) for number, term, _ in lexicon.rows})

        def run(batches: Iterator[pa.RecordBatch], held=held, lengths=lengths) -> Iterator[pa.RecordBatch]:
            length = lengths.value
            for batch in batches:
                at, found = [], []
                for row, value in enumerate(batch.column(n)):
                    whole, starts = value.as_py() or "", None
                    for number, start, end in held.value.find(whole):
                        starts = starts or _lines(whole)
                        line = bisect_right(starts, start) - 1
                        stop = starts[line + 1] if line + 1 < len(starts) else len(whole)
                        shown = whole[max(start - PAD, starts[line]) : max(min(end + PAD, stop), end)].strip()
                        at.append(row)
                        found.append((number, line + 1, start - starts[line], whole[start:end], shown, end - start - length[number]))
                if at:
                    own = [batch.column(i).take(pa.array(at)) for i in range(n)]
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]], names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def check_rules(df: DataFrame, rules: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",), whole: bool = False, most: int = LEXICON_BYTES) -> DataFrame:
    """keys, line, rule, pos, kind, token, suggestion, snippet, severity: what the rules find
    before the reference list, or in the ``whole`` text."""
    place = df.select(*keys, F.col(text).alias("_part")) if whole else split_manuscript(df, text).select(*keys, F.col("prose").alias("_part"))
    found = matches(place, rules, "_part", keys, most)
    said = rules.filter("rule IS NOT NULL").groupBy("rule").agg(F.min(F.struct("kind", "severity", "suggestion")).alias("_r"))
    rest = F.when(F.col("more") > 0, F.right("token", F.col("more"))).otherwise("")
    rows = found.join(said, "rule")
    return rows.select(*keys, "line", "rule", "pos", "_r.kind", "token", F.concat("_r.suggestion", rest).alias("suggestion"), "snippet", "_r.severity")


def editorial_rules(spark: SparkSession, variant: str = "American") -> DataFrame:
    """The fixed phrases and spellings as a table of rules."""
    rows = [(i, phrase, "word", "banned-phrase", "warning", better) for i, (phrase, better) in enumerate(PHRASES)]
    for i, (american, british) in enumerate(SPELLINGS):
        wrong, right = (british, american) if variant == "American" else (american, british)
        rows.append((len(PHRASES) + i, wrong, "stem", f"spelling-{variant.lower()}", "warning", right))
    return spark.createDataFrame(rows, RULES)
